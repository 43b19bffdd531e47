"""Operations queries over events and products: alerts, deliveries, retries, circuits, queues, logs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.operators import offers as O
from pricelake.operators import operations as P
from pricelake.sources.tables import EVENTS_NOW, SQL_CUR, SQL_OBS, current_offers, observations, products, read

_CLASSES = ("SECURITY_CHALLENGE", "TIMEOUT", "SCRAPE_ERROR", "PRICE_READ_ERROR", "NO_BUYABLE_OFFER", "NO_CANDIDATE", "IDENTITY_REJECT", "STRANGE")


def _now():
    return F.lit(EVENTS_NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of 20 stores: an error is a failure of a class, by the event's id."""
    e = read(spark, sf_dir, "events")
    failure = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 20).alias("store_id"), (F.col("event_type") != "error").alias("ok"), failure.alias("failure"), (F.col("user_id") % 7).cast("string").alias("context"),
    )


def alert_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a product, its kind by the key, on the signals of its offers."""
    o = current_offers(spark, sf_dir).where(O.serving()).groupBy("product_id").agg(F.min("total").alias("price"), F.count(F.lit(1)).alias("offers"), F.max("match_score").alias("match"))
    rows = products(spark, sf_dir).join(o, "product_id")
    kinds = ("price_target", "discount_percent", "stock_back", "coupon_available", "campaign_available", "new_seller", "official_seller", "value_score", "unknown")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("product_id") % 9 + 1).cast("int"))
    threshold = F.when(F.col("product_id") % 9 == 0, F.col("list_price") * 2).otherwise(60.0)
    signals = F.struct(
        F.col("price").alias("current_price"), (F.col("offers") * 10).cast("double").alias("discount_percent"), (F.col("offers") > 1).alias("in_stock"), (F.col("offers") > 2).alias("coupon"), (F.col("offers") > 3).alias("campaign"),
        (F.col("offers") > 4).alias("new_seller"), (F.col("offers") > 5).alias("official_seller"), F.col("match").alias("value_score"),
    )
    return rows.select("product_id", kind.alias("kind"), P.alert_triggered(kind, threshold, signals).alias("triggered"))


def alert_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on every product at twice its list price: when they fired, once for each price in a row."""
    prices = observations(spark, sf_dir).select("product_id", F.concat_ws("-", F.date_format("seen_at", "yyyy-MM-dd"), F.lpad(F.col("order_id").cast("string"), F.lit(12), F.lit("0")), F.col("line")).alias("at"), "price")
    targets = products(spark, sf_dir).select((F.col("product_id") + 1_000_000).alias("alert_id"), "product_id", (F.col("list_price") * 2).alias("target"))
    return P.fired_once(prices, targets)


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("notification_id"), "user_id", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("at"), (F.col("event_id") % 3).alias("event_key"))


def delivery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications to the channels that users take, after their quiet hours; every fourth one is queued by mail already."""
    u = F.col("user_id")
    start = F.when(u % 3 == 0, "22:00").when(u % 3 == 1, "09:30").otherwise("12:00")
    end = F.when(u % 3 == 0, "08:00").when(u % 3 == 1, "17:45").otherwise("12:00")
    n = _notifications(spark, sf_dir)
    prefs = n.select("user_id").distinct().select("user_id", (u % 2 == 0).alias("browser"), (u % 5 != 0).alias("email"), (u % 4 != 3).alias("quiet"), start.alias("quiet_start"), end.alias("quiet_end"))
    return P.delivery_queue(n, prefs, n.where("notification_id % 4 = 0").select("notification_id", F.lit("email").alias("channel")))


def notification_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_notifications(_notifications(spark, sf_dir)).select("user_id", "event_key", "notification_id")


def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each store may be asked again in each context, an hour before the events end."""
    e = _events(spark, sf_dir).select("store_id", "context", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("seq"), F.col("ok").alias("success"), "failure")
    return P.retry_decisions(e.where(F.col("at") <= _now()), _now())


def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by what their last run calls for."""
    last = P.last_runs(_events(spark, sf_dir), ["store_id"], ["ts", "event_id"], 1)
    return P.retry_summary(last.select("store_id", P.retry_policy(F.col("ok"), F.col("failure")).alias("policy")))


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("store_id", F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("seq"), "ok")
    return P.circuit(e, _now(), failures=1, cooldown_minutes=60 * 24).select("store_id", "runs", "consecutive", "health", "open")


def running_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's mean value so far, in whole hundredths."""
    e = read(spark, sf_dir, "events").withColumn("hundredths", F.rint(F.col("value") * 100).cast("bigint"))
    rows = P.running_mean(e, "user_id", ["ts", "event_id"], "hundredths")
    return rows.select("event_id", F.floor(F.col("running_mean") + 0.5).alias("running_mean"))


def due_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by stores' keys: some without a next run, some with an unreadable or a future one."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    at = F.when(F.col("plan_id") % 4 == 0, None).when(F.col("plan_id") % 4 == 1, "soon").when(F.col("plan_id") % 4 == 2, "2024-01-01 00:00:00").otherwise("2030-01-01 00:00:00")
    return P.due_plans(s.withColumn("next_run_at", at), _now()).select("plan_id")


def match_queue_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match queue after one run over its first 250 open items."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_orderkey") % 3).cast("int").alias("attempts"))
    q = o.withColumn("status", F.when(F.col("item_id") % 5 == 0, "DONE").when(F.col("attempts") > 0, "RETRY").otherwise("PENDING"))
    out = P.queue_step(q, q.select("item_id", (F.col("item_id") % 2 == 0).alias("ok")), 250)
    return out.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("items"), F.sum("item_id").alias("ids"))


def soak_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's last 50 runs (the feature is the limit): success, latency, failures by class, and alarms on the last, the last five, and any."""
    rows = P.last_runs(_events(spark, sf_dir), ["store_id"], ["ts", "event_id"], 50)
    bad = ~F.col("ok")
    return rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.count_if("ok") / F.count(F.lit(1)) * 100, 2).alias("success_percent"), F.round(F.avg("value"), 2).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count_if(bad & (F.col("failure") == "TIMEOUT")).alias("timeouts"), F.max(bad & (F.col("back") == 1)).alias("alarm_last"), F.max(bad & (F.col("back") <= 5)).alias("alarm_last_5"), F.max(bad).alias("alarm_any"),
    )


def repeated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as log entries, those that occur twice or more (the feature is a top ten)."""
    e = _events(spark, sf_dir)
    log = e.select(F.col("ts").alias("timestamp"), F.when(F.col("ok"), "INFO").otherwise("ERROR").alias("level"), F.concat(F.lit("store "), F.col("store_id")).alias("source"), "event_type", F.col("failure").alias("message"))
    return P.repeated_errors(log)


def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingestion tasks, and how ready that makes the catalog."""
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING").alias("status"), F.floor("o_totalprice").alias("duration"))
    one = P.ingestion_summary(o)
    r = P.readiness(F.col("success_percent"), F.lit(90.0), F.lit(80.0), F.lit(70.0), F.lit(100.0))
    return one.withColumn("r", r).select("tasks", "completed", "failed", "success_percent", "mean_duration", F.col("longest").cast("double").alias("longest"), F.col("r.score").alias("readiness"), F.col("r.status").alias("status"))


def event_top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent users, hours, values and properties, in one pass (the feature is a top ten), ties by key."""
    e = read(spark, sf_dir, "events")
    lists = {"user": F.col("user_id").cast("string"), "hour": F.lpad(F.hour("ts").cast("string"), F.lit(2), F.lit("0")), "value": F.floor("value").cast("bigint").cast("string"), "props": F.col("props")}
    keys = F.array(*[F.struct(F.lit(name).alias("list"), key.alias("key")) for name, key in lists.items()])
    n = e.select(F.explode(keys).alias("k")).groupBy("k.list", "k.key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("list").orderBy(F.desc("n"), "key")
    return n.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in: known types, clamped values, metadata without personal keys."""
    e = read(spark, sf_dir, "events")
    meta = F.to_json(F.struct(F.col("user_id").alias("user_id"), F.lit("a@b.c").alias("Email"), F.struct(F.col("event_id").alias("n"), F.lit("s").alias("session")).alias("page")))
    return e.where(F.col("event_type").isin("click", "purchase", "view")).select("event_id", F.least(F.lit(50.0), F.greatest(F.lit(0.0), "value")).alias("value"), P.sanitized(meta).alias("metadata"))


QUERIES = {f.__name__: f for f in (
    alert_evaluation, alert_fires, delivery_queue, notification_dedupe, retry_decisions, retry_summary, circuits, running_latency, due_plans, match_queue_step, soak_last50, repeated_errors, ingestion_summary,
    event_top_lists, clean_events,
)}

_CLASS = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END"
_EV = f"ev AS (SELECT *, user_id % 20 AS store_id, event_type <> 'error' AS ok, {_CLASS} AS failure, (user_id % 7)::VARCHAR AS context, date_trunc('second', ts) AS ts0 FROM events)"
_POLICY = "CASE WHEN ok THEN {0} ELSE CASE failure " + " ".join(f"WHEN '{k}' THEN {{{i + 1}}}" for i, k in enumerate(list(P.RETRY)[:-1])) + " ELSE {8} END END"


def _policy(field: int, success: str) -> str:
    values = [v[field] for v in P.RETRY.values()]
    return _POLICY.format(success, *["NULL" if v is None else f"'{v}'" if isinstance(v, str) else v for v in values])


_SERVING = "lifecycle = 'ACTIVE' AND NOT hidden AND price > 0"
SQL = {
    "alert_evaluation": f"""WITH {SQL_CUR}, o AS (SELECT product_id, min(total) AS price, count(*) AS n, max(match_score) AS m FROM cur WHERE {_SERVING} GROUP BY product_id)
        SELECT product_id, CASE p_partkey % 9 WHEN 0 THEN 'price_target' WHEN 1 THEN 'discount_percent' WHEN 2 THEN 'stock_back' WHEN 3 THEN 'coupon_available' WHEN 4 THEN 'campaign_available' WHEN 5 THEN 'new_seller' WHEN 6 THEN 'official_seller' WHEN 7 THEN 'value_score' ELSE 'unknown' END AS kind,
               CASE p_partkey % 9 WHEN 0 THEN price <= p_retailprice * 2 WHEN 1 THEN n * 10 >= 60 WHEN 2 THEN n > 1 WHEN 3 THEN n > 2 WHEN 4 THEN n > 3 WHEN 5 THEN n > 4 WHEN 6 THEN n > 5 WHEN 7 THEN m >= 60 ELSE false END AS triggered FROM part JOIN o ON product_id = p_partkey""",
    "alert_fires": f"""WITH {SQL_OBS}, hit AS (SELECT product_id + 1000000 AS alert_id, strftime(seen_at, '%Y-%m-%d') || '-' || lpad(order_id::VARCHAR, 12, '0') || '-' || line AS "at", price, round_even(price * 100, 0)::BIGINT AS price_key FROM obs JOIN part ON p_partkey = product_id WHERE price <= p_retailprice * 2)
        SELECT * FROM hit QUALIFY price_key IS DISTINCT FROM lag(price_key) OVER (PARTITION BY alert_id ORDER BY "at", price_key)""",
    "delivery_queue": """WITH n AS (SELECT event_id AS notification_id, user_id, date_trunc('second', ts) AS ts0, user_id % 4 <> 3 AS quiet, (hour(ts) * 60 + minute(ts)) AS m FROM events WHERE event_type = 'purchase'),
        q AS (SELECT *, CASE user_id % 3 WHEN 0 THEN m >= 1320 OR m < 480 WHEN 1 THEN m >= 570 AND m < 1065 ELSE true END AND quiet AS held, date_trunc('day', ts0) + CASE user_id % 3 WHEN 0 THEN INTERVAL 480 MINUTES WHEN 1 THEN INTERVAL 1065 MINUTES ELSE INTERVAL 720 MINUTES END AS until FROM n),
        s AS (SELECT *, CASE WHEN NOT held THEN ts0 WHEN until <= ts0 THEN until + INTERVAL 1 DAY ELSE until END AS scheduled_at FROM q)
        SELECT notification_id, user_id, 'browser' AS channel, scheduled_at FROM s WHERE user_id % 2 = 0 UNION ALL SELECT notification_id, user_id, 'email', scheduled_at FROM s WHERE user_id % 5 <> 0 AND notification_id % 4 <> 0""",
    "notification_dedupe": "SELECT user_id, event_id % 3 AS event_key, event_id AS notification_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY date_trunc('second', ts), event_id) = 1",
    "retry_decisions": f"""WITH {_EV}, a AS (SELECT * FROM ev WHERE ts0 <= TIMESTAMP '{EVENTS_NOW}'), k AS (SELECT *, NOT ok AND failure = 'SECURITY_CHALLENGE' AS wide FROM a),
        own AS (SELECT store_id, context, ok, failure, ts0 FROM k WHERE NOT wide QUALIFY row_number() OVER (PARTITION BY store_id, context ORDER BY ts0 DESC, event_id DESC) = 1),
        w AS (SELECT * FROM (SELECT store_id, ok, failure, ts0 FROM k WHERE wide OR ok QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY ts0 DESC, event_id DESC) = 1) WHERE NOT ok),
        r AS (SELECT d.store_id, d.context, w.store_id IS NOT NULL AS is_wide, own.store_id IS NOT NULL AND NOT own.ok AS is_own, CASE WHEN w.store_id IS NOT NULL THEN w.failure WHEN NOT own.ok THEN own.failure END AS failure, CASE WHEN w.store_id IS NOT NULL THEN w.ts0 WHEN NOT own.ok THEN own.ts0 END AS ts0, false AS ok
              FROM (SELECT DISTINCT store_id, context FROM a) d LEFT JOIN own USING (store_id, context) LEFT JOIN w ON w.store_id = d.store_id),
        p AS (SELECT *, {_policy(1, "'NONE'")} AS mode, {_policy(2, 'NULL')} - date_diff('second', ts0, TIMESTAMP '{EVENTS_NOW}') AS left_ FROM r)
        SELECT store_id, context, CASE WHEN is_wide THEN 'STORE' WHEN is_own THEN 'CONTEXT' ELSE 'NONE' END AS scope, NOT (failure IS NOT NULL AND (mode = 'CONTEXT_CHANGE_ONLY' OR coalesce(left_ > 0, false))) AS allow,
               CASE WHEN failure IS NOT NULL THEN mode END AS mode, CASE WHEN failure IS NOT NULL AND left_ > 0 THEN left_ END::BIGINT AS remaining_seconds FROM p""",
    "retry_summary": f"""WITH {_EV}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY ts DESC, event_id DESC) = 1), p AS (SELECT store_id, {_policy(1, "'NONE'")} AS mode, {_policy(0, '100')} AS rel FROM l)
        SELECT count_if(mode IN ('TRANSIENT', 'DEFERRED'))::BIGINT AS retryable, count_if(mode = 'TRANSIENT')::BIGINT AS transient, count_if(mode = 'DEFERRED')::BIGINT AS deferred, count_if(mode = 'CONTEXT_CHANGE_ONLY')::BIGINT AS context_only,
               round(avg(rel), 2) AS average_reliability, arg_min(store_id, (rel, store_id)) AS least_reliable FROM p""",
    "circuits": f"""WITH {_EV}, x AS (SELECT *, count_if(ok) OVER (PARTITION BY store_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS later FROM ev),
        g AS (SELECT store_id, count(*) AS runs, count_if(ok) AS oks, count_if(later = 0)::BIGINT AS consecutive, max(ts) AS last_at FROM x GROUP BY store_id)
        SELECT store_id, runs, consecutive, round(greatest(0.0, oks / runs * 100 - 8 * consecutive), 2) AS health, consecutive >= 1 AND last_at + INTERVAL 1440 MINUTES > TIMESTAMP '{EVENTS_NOW}' AS open FROM g""",
    "running_latency": "SELECT event_id, floor(avg(round_even(value * 100, 0)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 0.5)::BIGINT AS running_mean FROM events",
    "due_plans": "SELECT s_suppkey AS plan_id FROM supplier WHERE s_suppkey % 4 <> 3",
    "match_queue_step": """WITH q AS (SELECT o_orderkey AS item_id, substring(o_orderpriority, 1, 1)::INTEGER AS priority, o_orderkey % 3 AS attempts, CASE WHEN o_orderkey % 5 = 0 THEN 'DONE' WHEN o_orderkey % 3 > 0 THEN 'RETRY' ELSE 'PENDING' END AS status FROM orders),
        p AS (SELECT item_id FROM q WHERE status <> 'DONE' ORDER BY priority, item_id LIMIT 250), r AS (SELECT q.*, p.item_id IS NOT NULL AS ran FROM q LEFT JOIN p USING (item_id)),
        s AS (SELECT item_id, CASE WHEN NOT ran THEN status WHEN item_id % 2 = 0 THEN 'DONE' WHEN attempts + 1 >= 3 THEN 'FAILED' ELSE 'RETRY' END AS status, (attempts + CASE WHEN ran THEN 1 ELSE 0 END)::INTEGER AS attempts FROM r)
        SELECT status, attempts, count(*) AS items, sum(item_id)::BIGINT AS ids FROM s GROUP BY ALL""",
    "soak_last50": f"""WITH {_EV}, l AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ts DESC, event_id DESC) AS back FROM ev QUALIFY back <= 50)
        SELECT store_id, count(*) AS runs, round(count_if(ok) / count(*) * 100, 2) AS success_percent, round(avg(value), 2) AS mean_value, min(value) AS min_value, max(value) AS max_value, count_if(NOT ok AND failure = 'TIMEOUT')::BIGINT AS timeouts,
               bool_or(NOT ok AND back = 1) AS alarm_last, bool_or(NOT ok AND back <= 5) AS alarm_last_5, bool_or(NOT ok) AS alarm_any FROM l GROUP BY store_id""",
    "repeated_errors": f"""WITH {_EV} SELECT substring(sha256('store ' || store_id || '|error|' || lower(failure)), 1, 16) AS signature, count(*) AS n, failure AS sample FROM ev WHERE NOT ok GROUP BY store_id, failure HAVING count(*) >= 2
        ORDER BY n DESC, signature LIMIT 10""",
    "ingestion_summary": """WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status, floor(o_totalprice) AS d FROM orders),
        g AS (SELECT count(*) AS tasks, count_if(status = 'COMPLETED')::BIGINT AS completed, count_if(status = 'FAILED')::BIGINT AS failed, round(count_if(status = 'COMPLETED') / count(*) * 100, 2) AS success_percent, round(avg(d) FILTER (status = 'COMPLETED' AND d > 0), 2) AS mean_duration, max(d) FILTER (status = 'COMPLETED' AND d > 0) AS longest FROM t),
        r AS (SELECT *, floor((success_percent * 0.35::DOUBLE + 90 * 0.25::DOUBLE + 80 * 0.20::DOUBLE + 70 * 0.10::DOUBLE + 100 * 0.10::DOUBLE) * 100 + 0.5) / 100 AS readiness FROM g)
        SELECT *, CASE WHEN readiness >= 85 THEN 'READY' WHEN readiness >= 65 THEN 'WATCH' ELSE 'NOT_READY' END AS status FROM r""",
    "event_top_lists": """WITH k AS (SELECT 'user' AS "list", user_id::VARCHAR AS key FROM events UNION ALL SELECT 'hour', lpad(hour(ts)::VARCHAR, 2, '0') FROM events UNION ALL SELECT 'value', floor(value)::BIGINT::VARCHAR FROM events UNION ALL SELECT 'props', props FROM events)
        SELECT "list", key, count(*) AS n, row_number() OVER (PARTITION BY "list" ORDER BY count(*) DESC, key)::INTEGER AS rank FROM k GROUP BY "list", key QUALIFY row_number() OVER (PARTITION BY "list" ORDER BY count(*) DESC, key) <= 10""",
    "clean_events": """SELECT event_id, least(50.0::DOUBLE, greatest(0.0, value)) AS value, '{"page":{"n":' || event_id || '}}' AS metadata FROM events WHERE event_type IN ('click', 'purchase', 'view')""",
}
