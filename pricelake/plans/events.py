"""Queries over events, conversations, labels, pages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.functions import text as T
from pricelake.sources.tables import read


def event_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 2).alias("avg_value"))


def event_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def event_daily_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by day over the days of all events, days without any as 0, with a bar height of 8 to 100."""
    e = read(spark, sf_dir, "events")
    days = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    n = e.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = days.join(n, "day", "left").fillna(0, ["n"])
    top = out.agg(F.max("n").alias("top"))
    return out.join(F.broadcast(top)).select("day", "n", F.greatest(F.lit(8), F.bround(F.col("n") * 100 / F.greatest("top", F.lit(1)), 0).cast("int")).alias("height"))


def event_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, parted by gaps of over 30 minutes."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(by), "ts")
    e = read(spark, sf_dir, "events").withColumn("new", F.when(gap.isNull() | (gap > 1_800_000_000), 1).otherwise(0))
    e = e.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("with_k"), F.min("p.k").alias("min_k"), F.max("p.k").alias("max_k"))


def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


def label_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", T.normalize_text(F.col("text")).alias("normal"), T.slugify(F.col("text")).alias("slug"))


def name_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), T.normalize_text("p_name").alias("normal"))
    return p.groupBy("normal").agg(F.count(F.lit(1)).alias("n"), F.min("product_id").alias("first_id"), F.min(T.identity_key(F.col("normal"))).alias("key"))


def token_jaccard_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different product names whose words overlap by a third or more, with how many products have each.

    Products are folded to distinct sets of words.  Two sets that overlap by a
    third share one of each one's rarest words, all but a third of them, so only
    those are joined, and frequent words gather nothing but their own names.
    """
    p = read(spark, sf_dir, "part").select("p_partkey", F.array_sort(T.tokens(F.col("p_name"))).alias("words")).where(F.size("words") > 0)
    names = p.groupBy("words").agg(F.min("p_partkey").alias("first_id"), F.count(F.lit(1)).alias("products"))
    words = names.select("first_id", "words", F.explode("words").alias("w"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    rare = Window.partitionBy("first_id").orderBy("c", "w")
    keep = F.size("words") - F.ceil(F.size("words") * 0.33) + 1
    posts = words.join(often, "w").withColumn("place", F.row_number().over(rare)).where(F.col("place") <= keep).select("w", F.col("first_id").alias("id"))
    pairs = posts.join(posts.toDF("w", "other"), "w").where("id < other").select("id", "other").distinct()
    side = lambda name, n: names.select(F.col("first_id").alias(name), F.col("words").alias(f"{name}_words"), F.col("products").alias(n))
    rows = pairs.join(side("id", "products"), "id").join(side("other", "other_products"), "other")
    score = T.jaccard(F.col("id_words"), F.col("other_words"))
    return rows.where(score >= 0.33).select(F.col("id").alias("first_id"), F.col("other").alias("other_first_id"), F.round(score, 4).alias("score"), "products", "other_products")


QUERIES = {f.__name__: f for f in (
    event_dashboard, event_top_users, event_daily_zero_fill, event_hourly_windows, event_sessions, event_props, conversation_rollup, label_quality_bands,
    text_normalize, name_fingerprint, token_jaccard_dups,
)}


def _fold(c: str) -> str:
    return f"translate(lower(translate({c}, 'İI', 'ii')), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def _normal(c: str) -> str:
    return f"trim(regexp_replace({_fold(c)}, '[^a-z0-9]+', ' ', 'g'))"


SQL = {
    "event_dashboard": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 2) AS avg_value FROM events GROUP BY event_type",
    "event_top_users": "SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id)::INTEGER AS rank FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) <= 10",
    "event_daily_zero_fill": """WITH d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events),
        n AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), o AS (SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day))
        SELECT day, n, greatest(8, round_even(n * 100 / greatest((SELECT max(n) FROM o), 1), 0)::INTEGER) AS height FROM o""",
    "event_hourly_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL""",
    "event_props": "WITH p AS (SELECT event_type, (props::JSON ->> 'k')::INTEGER AS k FROM events) SELECT event_type, count(k) AS with_k, min(k) AS min_k, max(k) AS max_k FROM p GROUP BY event_type",
    "conversation_rollup": "SELECT conv_id, count(*) AS turns, count_if(role = 'assistant')::BIGINT AS replies, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "label_quality_bands": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "text_normalize": f"""WITH s AS (SELECT item_id, text, substring(regexp_replace(regexp_replace({_fold('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS slug FROM benchmark)
        SELECT item_id, {_normal('text')} AS normal, CASE WHEN slug = '' THEN 'urun' ELSE slug END AS slug FROM s""",
    "name_fingerprint": f"WITH p AS (SELECT p_partkey, {_normal('p_name')} AS normal FROM part) SELECT normal, count(*) AS n, min(p_partkey) AS first_id, min(substring(sha256(normal), 1, 32)) AS key FROM p GROUP BY normal",
    "token_jaccard_dups": f"""WITH p AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split({_normal('p_name')}, ' '), lambda x: length(x) >= 2))) AS t FROM part),
        n AS (SELECT t, min(p_partkey) AS id, count(*) AS c FROM p WHERE len(t) > 0 GROUP BY t),
        j AS (SELECT a.id AS first_id, b.id AS other_first_id, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS s, a.c AS products, b.c AS other_products FROM n a JOIN n b ON a.id < b.id)
        SELECT first_id, other_first_id, round(i / (s - i), 4) AS score, products, other_products FROM j WHERE i / (s - i) >= 0.33""",
}
