"""Operations of a catalog: alerts, notifications, retries, circuits, queues, logs, as keyed batch forms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from pricelake.functions import text as T

# --- alerts and notifications -------------------------------------------------


def price_key(price: Column) -> Column:
    return F.rint(price * 100).cast("bigint")


def alert_triggered(kind: Column, threshold: Column, signals: Column) -> Column:
    """Whether an alert of one of eight kinds fires on its product's signals.

    ``signals``: current_price, discount_percent, in_stock, coupon, campaign,
    new_seller, official_seller, value_score.  Unknown kinds never fire.
    """
    fired = (
        F.when(kind == "price_target", signals["current_price"] <= threshold).when(kind == "discount_percent", signals["discount_percent"] >= threshold)
        .when(kind == "stock_back", signals["in_stock"]).when(kind == "coupon_available", signals["coupon"]).when(kind == "campaign_available", signals["campaign"])
        .when(kind == "new_seller", signals["new_seller"]).when(kind == "official_seller", signals["official_seller"]).when(kind == "value_score", signals["value_score"] >= threshold)
    )
    return F.coalesce(fired, F.lit(False))


def fired_once(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """Alerts fire when a product's best price reaches the target, once for each price in a row; a new price fires again.

    ``prices``: product_id, at, price in time; ``targets``: alert_id,
    product_id, target.  alert_id, at, price, price_key.
    """
    hits = prices.join(targets, "product_id").where(F.col("price") <= F.col("target")).withColumn("price_key", price_key(F.col("price")))
    before = F.lag("price_key").over(Window.partitionBy("alert_id").orderBy("at", "price_key"))
    return hits.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("price_key"))).select("alert_id", "at", "price", "price_key")


def _minutes(clock: Column) -> Column:
    return F.substring_index(clock, ":", 1).try_cast("int") * 60 + F.substring_index(clock, ":", -1).try_cast("int")


def in_quiet_hours(at: Column, enabled: Column, start: Column, end: Column) -> Column:
    """Between two clock times, over midnight if the start is later; equal times are always quiet; unreadable ones are 22:00 and 08:00."""
    now = F.hour(at) * 60 + F.minute(at)
    s, e = F.coalesce(_minutes(start), F.lit(22 * 60)), F.coalesce(_minutes(end), F.lit(8 * 60))
    quiet = F.when(s == e, True).when(s < e, (now >= s) & (now < e)).otherwise((now >= s) | (now < e))
    return F.coalesce(enabled, F.lit(False)) & quiet


def next_allowed(at: Column, enabled: Column, start: Column, end: Column) -> Column:
    """When a notification may go: at once, or when the quiet hours end, the next day if that has passed."""
    e = F.coalesce(_minutes(end), F.lit(8 * 60))
    today = F.to_date(at).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), e)
    later = F.when(today <= at, today + F.expr("INTERVAL 1 DAY")).otherwise(today)
    return F.when(in_quiet_hours(at, enabled, start, end), later).otherwise(at)


def delivery_queue(notifications: DataFrame, preferences: DataFrame, queued: DataFrame) -> DataFrame:
    """notification_id, user_id, channel, scheduled_at of deliveries that aren't queued yet, one a channel the user takes.

    ``notifications``: notification_id, user_id, at; ``preferences``: user_id,
    browser, email, quiet, quiet_start, quiet_end; ``queued``: notification_id, channel.
    """
    channels = F.explode(F.array_compact(F.array(F.when(F.col("browser"), "browser"), F.when(F.col("email"), "email"))))
    when = next_allowed(F.col("at"), F.col("quiet"), F.col("quiet_start"), F.col("quiet_end"))
    rows = notifications.join(preferences, "user_id").select("notification_id", "user_id", channels.alias("channel"), when.alias("scheduled_at"))
    return rows.join(queued.select("notification_id", "channel").distinct(), ["notification_id", "channel"], "left_anti")


def first_notifications(notifications: DataFrame) -> DataFrame:
    """One notification for each user and event, the first in time."""
    first = Window.partitionBy("user_id", "event_key").orderBy("at", "notification_id")
    return notifications.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


# --- retries, circuits, queues --------------------------------------------------

#: Failure classes: reliability, mode, seconds until a retry (fixed values).
RETRY = {
    "SECURITY_CHALLENGE": (45, "DEFERRED", 1800), "TIMEOUT": (55, "TRANSIENT", 300), "SCRAPE_ERROR": (50, "TRANSIENT", 600), "PRICE_READ_ERROR": (60, "DEFERRED", 900),
    "NO_BUYABLE_OFFER": (72, "DEFERRED", 21600), "NO_CANDIDATE": (65, "DEFERRED", 21600), "IDENTITY_REJECT": (88, "CONTEXT_CHANGE_ONLY", None), "OTHER": (40, "DEFERRED", 1800),
}


def retry_policy(success: Column, failure: Column) -> Column:
    """reliability, mode, after_seconds of an attempt; unknown classes are OTHER, a success needs no retry."""
    known = F.when(F.upper(F.trim(failure)).isin(*RETRY), F.upper(F.trim(failure))).otherwise("OTHER")
    of = lambda i: F.coalesce(*[F.when(known == k, F.lit(v[i])) for k, v in RETRY.items() if v[i] is not None])
    return F.struct(F.when(success, 100).otherwise(of(0)).alias("reliability"), F.when(success, "NONE").otherwise(of(1)).alias("mode"), F.when(~success, of(2)).alias("after_seconds"))


def retry_decisions(attempts: DataFrame, now: Column) -> DataFrame:
    """store_id, context, scope, allow, mode, remaining_seconds: whether a store may be asked again in a context.

    ``attempts``: store_id, context, at, seq, success, failure.  The last
    failure counts; a later success in the context clears it and the store's
    own.  A security challenge holds for the whole store.
    """
    store_wide = ~F.col("success") & (F.upper("failure") == "SECURITY_CHALLENGE")
    keyed = attempts.withColumn("key", F.when(store_wide, "*").otherwise(F.col("context")))
    last = lambda by: Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("seq"))
    own = keyed.where("key <> '*'").withColumn("_n", F.row_number().over(last(["store_id", "context"]))).where("_n = 1")
    own = own.select("store_id", "context", F.struct("success", "failure", "at").alias("own"))
    wide = keyed.withColumn("_w", (F.col("key") == "*") | F.col("success")).where("_w").withColumn("_n", F.row_number().over(last(["store_id"]))).where("_n = 1 and not success")
    wide = wide.select("store_id", F.struct("success", "failure", "at").alias("wide"))
    rows = attempts.select("store_id", "context").distinct().join(own, ["store_id", "context"], "left").join(wide, "store_id", "left")
    held = F.coalesce("wide", F.when(~F.col("own.success"), F.col("own")))
    rows = rows.withColumn("held", held)
    policy = retry_policy(F.col("held.success"), F.col("held.failure"))
    rows = rows.withColumn("policy", policy)
    left = F.col("policy.after_seconds") - F.timestamp_diff("SECOND", F.col("held.at"), now)
    waits = F.col("held").isNotNull() & ((F.col("policy.mode") == "CONTEXT_CHANGE_ONLY") | F.coalesce(left > 0, F.lit(False)))
    scope = F.when(F.col("wide").isNotNull(), "STORE").when(F.col("held").isNotNull(), "CONTEXT").otherwise("NONE")
    return rows.select("store_id", "context", scope.alias("scope"), (~waits).alias("allow"), F.when(F.col("held").isNotNull(), F.col("policy.mode")).alias("mode"), F.when(left > 0, left).cast("bigint").alias("remaining_seconds"))


def retry_summary(stores: DataFrame) -> DataFrame:
    """One row: stores by retry mode, mean reliability, and the least reliable store (lowest id of equal ones). Reads store_id, policy."""
    return stores.agg(
        F.count_if(F.col("policy.mode").isin("TRANSIENT", "DEFERRED")).alias("retryable"), F.count_if(F.col("policy.mode") == "TRANSIENT").alias("transient"), F.count_if(F.col("policy.mode") == "DEFERRED").alias("deferred"),
        F.count_if(F.col("policy.mode") == "CONTEXT_CHANGE_ONLY").alias("context_only"), F.round(F.avg("policy.reliability"), 2).alias("average_reliability"),
        F.min(F.struct("policy.reliability", "store_id"))["store_id"].alias("least_reliable"),
    )


def circuit(runs: DataFrame, now: Column, failures: int = 3, cooldown_minutes: int = 30) -> DataFrame:
    """store_id, runs, consecutive, health, open, open_until: circuits by the failures at the end of each store's runs.

    ``runs``: store_id, at, seq, ok.  Health is the success rate less eight for
    each failure in a row.  A circuit opens at ``failures`` in a row and closes
    when its cooldown from the last run has passed.
    """
    last_ok = runs.groupBy("store_id").agg(F.max(F.when(F.col("ok"), F.struct("at", "seq"))).alias("last_ok"))
    rows = runs.join(last_ok, "store_id")
    after = F.col("last_ok").isNull() | (F.struct("at", "seq") > F.col("last_ok"))
    g = rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("oks"), F.count_if(after).alias("consecutive"), F.max("at").alias("last_at"))
    until = F.when(F.col("consecutive") >= failures, F.col("last_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(cooldown_minutes)))
    health = F.round(F.greatest(F.lit(0.0), F.col("oks") / F.col("runs") * 100 - 8 * F.col("consecutive")), 2)
    return g.select("store_id", "runs", "consecutive", health.alias("health"), F.coalesce(until > now, F.lit(False)).alias("open"), until.alias("open_until"))


def running_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The mean of each key's values so far, row by row."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(value).over(so_far))


def due_plans(plans: DataFrame, now: Column, busy: bool = False) -> DataFrame:
    """Plans whose next run is missing, unreadable or past; none while user work runs."""
    at = F.col("next_run_at").try_cast("timestamp_ntz")
    return plans.where(F.lit(not busy) & (at.isNull() | (at <= now)))


def queue_step(queue: DataFrame, outcomes: DataFrame, most: int, tries: int = 3) -> DataFrame:
    """A queue after one run over its first ``most`` open rows (the run's own bound): DONE, RETRY, or FAILED at the last try.

    ``queue``: item_id, priority, status, attempts; open are PENDING and RETRY,
    by priority and id.  ``outcomes``: item_id, ok.
    """
    picked = queue.where(F.col("status").isin("PENDING", "RETRY")).orderBy("priority", "item_id").limit(most).select("item_id", F.lit(True).alias("picked"))
    rows = queue.join(picked, "item_id", "left").join(outcomes, "item_id", "left")
    ran = F.coalesce("picked", F.lit(False))
    n = F.col("attempts") + 1
    status = F.when(~ran, F.col("status")).when(F.coalesce("ok", F.lit(False)), "DONE").when(n >= tries, "FAILED").otherwise("RETRY")
    return rows.select("item_id", "priority", status.alias("status"), F.when(ran, n).otherwise(F.col("attempts")).alias("attempts"))


def last_runs(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key (the feature is the limit)."""
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)


# --- events and logs --------------------------------------------------------------

#: Keys of metadata that name a person (fixed values).
PERSONAL = (
    "ip", "ip_address", "email", "e_mail", "username", "user_name", "name", "full_name", "phone", "telephone", "owner_key", "user_id", "session", "session_id", "visitor_id", "cookie",
)


def _scrub(value, depth: int = 0):
    if depth > 3:
        return None
    if isinstance(value, dict):
        kept = ((k, _scrub(v, depth + 1)) for k, v in value.items() if k.strip().lower() not in PERSONAL)
        return {k[:64]: v for k, v in kept if v is not None}
    if isinstance(value, list):
        return [_scrub(v, depth + 1) for v in value[:20]]
    return value[:250] if isinstance(value, str) else value


@pandas_udf(StringType())
def sanitized(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON without personal keys, three levels deep, lists of 20, texts of 250; null for invalid JSON (recursion has no built-in function)."""

    def one(raw: str | None) -> str | None:
        try:
            return json.dumps(_scrub(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    for part in parts:
        yield part.map(one)


def read_log(spark, path: str) -> DataFrame:
    """A JSON-lines log: timestamp, level, source, event_type, message; malformed lines are left out."""
    schema = "timestamp string, level string, source string, event_type string, message string"
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file a partition."""
    rows.write.mode("errorifexists").json(path)


def log_page(log: DataFrame, now: Column, hours: int | None = None, level: str | None = None, source: str | None = None, most: int = 300) -> DataFrame:
    """The last entries of a log, newest first, by age, level and source (the feature is the limit)."""
    rows = log
    if hours is not None:
        rows = rows.where(F.timestamp_diff("SECOND", F.col("timestamp"), now) <= hours * 3600)
    if level:
        rows = rows.where(F.upper("level") == level.upper())
    if source:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy(F.desc("timestamp"), "source", "message").limit(most)


def event_signature() -> Column:
    return T.signature(F.lower("source"), F.lower("event_type"), F.lower("message"))


def repeated_errors(log: DataFrame, top: int = 10) -> DataFrame:
    """signature, n, sample of errors that occur twice or more, the most frequent ones (the feature is the limit)."""
    rows = log.where(F.upper("level").isin("ERROR", "CRITICAL")).withColumn("signature", event_signature())
    return rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("sample")).where("n >= 2").orderBy(F.desc("n"), "signature").limit(top)


def ingestion_summary(tasks: DataFrame) -> DataFrame:
    """One row: tasks, completed and failed ones, success in percent, mean and longest duration. Reads status, duration."""
    done = F.col("status") == "COMPLETED"
    timed = F.when(done & (F.col("duration") > 0), F.col("duration"))
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.round(F.count_if(done) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 2).alias("success_percent"), F.round(F.avg(timed), 2).alias("mean_duration"), F.max(timed).alias("longest"),
    )


def readiness(success: Column, store_success: Column, clean: Column, speed: Column, stable: Column) -> Column:
    """score and status of five rates in percent, weighted .35 .25 .20 .10 .10: READY from 85, WATCH from 65."""
    score = F.floor((success * 0.35 + store_success * 0.25 + clean * 0.20 + speed * 0.10 + stable * 0.10) * 100 + 0.5) / 100
    return F.struct(score.alias("score"), F.when(score >= 85, "READY").when(score >= 65, "WATCH").otherwise("NOT_READY").alias("status"))
