"""Queries over offers: comparison, best offers, ranks, stores, history, quarantine, lifecycle, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.operators import history as H
from pricelake.operators import offers as O
from pricelake.sources.tables import NOW, SQL_CUR, SQL_OBS, current_offers, observations, products, read, stores

STALE = 24 * 400.0
_SERVING = "lifecycle = 'ACTIVE' AND NOT hidden AND price > 0"
_ELIGIBLE = "lifecycle IN ('ACTIVE', 'UPDATED') AND NOT hidden AND price > 0"
_AGE = f"(date_diff('second', seen_at, TIMESTAMP '{NOW}') / 3600)"


def price_comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.compare(current_offers(spark, sf_dir), NOW, STALE).join(products(spark, sf_dir).select("product_id", "name", "brand"), "product_id")


def offer_best_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_offers(current_offers(spark, sf_dir))


def store_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.store_status(current_offers(spark, sf_dir), NOW, STALE)


def store_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (product, store)'s cheapest observation: least total, the latest of equal ones, then order and line."""
    w = Window.partitionBy("product_id", "store_id").orderBy("total", F.desc("seen_at"), "order_id", "line")
    return observations(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("product_id", "store_id", "order_id", "line", "total")


def duplicate_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("first_order")).where("n > 1")


def multi_store_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_offers(spark, sf_dir).where(O.eligible()).groupBy("product_id").agg(F.countDistinct("store_id").alias("stores")).where("stores >= 2")


def products_without_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = current_offers(spark, sf_dir).where(O.serving())
    return products(spark, sf_dir).join(offers, "product_id", "left_anti").select("product_id", "name")


def active_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).join(current_offers(spark, sf_dir).where(O.serving()), "product_id", "left_semi").select("brand").distinct()


def peer_cheaper_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer's number of cheaper offers of the product in other stores, and the best of them.

    A product's totals in order tell both; no offer meets another.  Offers at
    one total are no cheaper than each other, and the cheapest is the peer of all dearer ones.
    """
    whole = Window.partitionBy("product_id")
    rows = current_offers(spark, sf_dir).select("product_id", "store_id", "total")
    rows = rows.withColumns({"cheaper": F.rank().over(whole.orderBy("total")).cast("bigint") - 1, "best_peer": F.min("total").over(whole)})
    return rows.where("cheaper > 0").select("product_id", "store_id", "cheaper", "best_peer")


def price_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.quarantine(current_offers(spark, sf_dir)).select("product_id", "store_id", "price", "peers", "status")


def two_pass_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offers are decided against their original peers; those quarantined are then judged again by the peers that were not.

    A quarantined offer isn't among those peers, so their median is the
    product's, from one more window over the first result.
    """
    first = H.quarantine(current_offers(spark, sf_dir).select("product_id", "store_id", "price"))
    kept = F.when(F.col("status") != "QUARANTINED", F.col("price"))
    whole = Window.partitionBy("product_id")
    again = first.withColumns({"peers_2": F.count(kept).over(whole), "median_2": F.percentile(kept, F.lit(0.5)).over(whole)}).where("status = 'QUARANTINED'")
    ratio = F.col("price") / F.nullif(F.col("median_2"), F.lit(0.0))
    second = H.integrity_status(F.col("price"), F.col("peers_2"), ratio)
    return again.select("product_id", "store_id", "price", F.col("status").alias("first_status"), second.alias("second_status"))


def price_windows_7_30_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.window_stats(observations(spark, sf_dir), "1998-09-02 00:00:00")


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.summary(observations(spark, sf_dir))


def price_trend_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trend_last(observations(spark, sf_dir))


def volatility_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.volatility(observations(spark, sf_dir)).select("product_id", "points", "volatility")


def price_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.changes(observations(spark, sf_dir))


def fake_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fake_discount(observations(spark, sf_dir))


def lifecycle_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.lifecycle(current_offers(spark, sf_dir), NOW, 24 * 1500.0, 24 * 2500.0)
    return rows.groupBy("next_lifecycle").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("product_id").alias("products"))


def stale_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_offers(spark, sf_dir).where(O.serving() & ~O.fresh(NOW, STALE)).select("product_id", "store_id", "seen_at", "total")


def alert_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join: list price as the target that the best total must not exceed; the key is the price in cents."""
    best = O.best_offers(current_offers(spark, sf_dir))
    p = products(spark, sf_dir).select("product_id", (F.col("list_price") * 0.6).alias("target"))
    return best.join(p, "product_id").where("target >= best_total").select("product_id", "best_store_id", "best_total", F.bround(F.col("best_total") * 100, 0).cast("bigint").alias("price_key"))


def price_drop_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 largest drops from a product's highest to its last price."""
    h = H.summary(observations(spark, sf_dir))
    drop = F.round((F.col("highest") - F.col("last_price")) / F.col("highest"), 6)
    return h.select("product_id", "last_price", drop.alias("drop")).orderBy(F.desc("drop"), "product_id").limit(100)


def integrity_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that must be 0: orphans, bad prices, repeated keys, orders whose customer is missing.

    Lines are folded by product and store, and by key, once; what is joined
    with the small tables is what the folds leave.
    """
    li = read(spark, sf_dir, "lineitem")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_extendedprice") <= 0).alias("bad"))
    known_p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("p"))
    known_s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("s"))
    lines = pairs.join(known_p, "l_partkey", "left").join(known_s, "l_suppkey", "left").agg(
        F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n"))), F.lit(0)).alias("orphan_products"),
        F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("n"))), F.lit(0)).alias("orphan_stores"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_prices"),
    )
    repeated = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated_keys"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orphans = read(spark, sf_dir, "orders").join(customers, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("orphan_orders"))
    stacked = lines.select(F.expr("stack(3, 'orphan_products', orphan_products, 'orphan_stores', orphan_stores, 'bad_prices', bad_prices) as (invariant, n)"))
    for one in (repeated, orphans):
        stacked = stacked.unionByName(one.select(F.lit(one.columns[0]).alias("invariant"), F.col(one.columns[0]).alias("n")))
    return stacked


def counter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose total differs from the sum of their lines by over a tenth of it."""
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("line_total"))
    o = read(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.where(F.abs(F.col("o_totalprice") - F.coalesce("line_total", F.lit(0.0))) > 0.1 * F.col("o_totalprice")).select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


def consecutive_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's longest run of hidden observations, in time order, and its number of runs.

    Runs are found inside (store, month) first, so a store's history is many
    tasks; a month leaves one row: its length, the runs at its two ends, the
    longest inside, and whether it is all hidden.  Months are then stitched in
    order, a few rows a store.
    """
    month = F.date_trunc("month", "seen_at")
    rows = observations(spark, sf_dir).select("store_id", month.alias("month"), "seen_at", "order_id", "line", "hidden")
    by = Window.partitionBy("store_id", "month").orderBy("seen_at", "order_id", "line")
    rows = rows.withColumns({"island": F.count_if(~F.col("hidden")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    runs = rows.groupBy("store_id", "month", "island").agg(F.count_if("hidden").alias("n"), F.count_if(~F.col("hidden")).alias("shown"))
    whole = Window.partitionBy("store_id", "month")
    runs = runs.withColumns({"last": F.max("island").over(whole)})
    months = runs.groupBy("store_id", "month").agg(
        F.max(F.when(F.col("island") == 0, F.col("n"))).alias("head"), F.max(F.when(F.col("island") == F.col("last"), F.col("n"))).alias("tail"),
        F.max("n").alias("longest"), F.count_if(F.col("n") > 0).alias("runs"), (F.max("last") == 0).alias("solid"),
    ).fillna(0, ["head"])
    order = Window.partitionBy("store_id").orderBy("month")
    # a run that goes on over months: what stands at the end of the one before, solid months added up
    blocks = months.withColumn("broken", F.count_if(~F.col("solid")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    so_far = Window.partitionBy("store_id", "broken").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    open_tail = F.last(F.when(~F.col("solid"), F.col("tail")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    carried = F.coalesce(F.sum("tail").over(so_far), F.lit(0)) + F.coalesce(open_tail, F.lit(0))
    blocks = blocks.withColumn("carried", carried)
    before = F.coalesce(F.lag("tail").over(order), F.lit(0))
    joined = (before > 0) & (F.col("head") > 0)
    out = blocks.withColumns({"joined": joined.cast("int"), "whole": F.greatest("longest", F.col("head") + F.col("carried"))})
    return out.groupBy("store_id").agg(F.max("whole").alias("longest"), (F.sum("runs") - F.sum("joined")).alias("runs")).where("runs > 0")


def _rollup(spark: SparkSession, sf_dir: str, by: str, also: str | None) -> DataFrame:
    """Eligible offers by a product attribute: products, offers, stores, prices, and distinct values of another attribute.

    Folded to (value, product) and to (value, store) before anything distinct
    is counted, so that no row is multiplied for a count.
    """
    o = current_offers(spark, sf_dir).where(O.eligible()).join(products(spark, sf_dir).select("product_id", "brand", "category"), "product_id")
    of_product = o.groupBy(by, *([also] if also else []), "product_id").agg(F.count(F.lit(1)).alias("offers"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    sums = [F.sum("offers").alias("offers"), F.min("lo").alias("min_price"), F.max("hi").alias("max_price")]
    if also:
        of_product = of_product.groupBy(by, also).agg(F.count(F.lit(1)).alias("products"), F.sum("offers").alias("offers"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = of_product.groupBy(by).agg(F.sum("products").alias("products"), F.count(F.lit(1)).alias(f"{also}s"), *sums)
    else:
        out = of_product.groupBy(by).agg(F.count(F.lit(1)).alias("products"), *sums)
    of_store = o.groupBy(by, "store_id").agg(F.lit(1).alias("one")).groupBy(by).agg(F.count(F.lit(1)).alias("stores"))
    return out.join(of_store, by)


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "category", "brand")


def brand_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "brand", None).drop("max_price")


QUERIES = {f.__name__: f for f in (
    price_comparison_summary, offer_best_flag, store_status_rollup, store_winner, duplicate_offers, multi_store_products, products_without_offers, active_brands,
    peer_cheaper_offers, price_quarantine, two_pass_audit, price_windows_7_30_90, history_summary, price_trend_last6, volatility_band, price_change_events, fake_discounts,
    lifecycle_reconcile, stale_offers, alert_triggers, price_drop_topk, integrity_invariants, counter_drift, consecutive_misses,
    category_rollup, brand_rollup,
)}

_SUMMARY = """s AS (
    SELECT product_id, count(*) AS points, min(price) AS lowest, max(price) AS highest, floor(sum(round(price * 100)::BIGINT) / count(price) + 0.5) / 100 AS average,
           arg_min(price, (seen_at, order_id, line)) AS first_price, arg_max(price, (seen_at, order_id, line)) AS last_price
    FROM obs GROUP BY product_id)"""
_PEERS = """q AS (
    SELECT a.product_id, a.store_id, a.price, count(b.price) AS peers, median(b.price) AS reference
    FROM cur a LEFT JOIN cur b ON a.product_id = b.product_id AND a.store_id <> b.store_id GROUP BY ALL),
v AS (SELECT product_id, store_id, price, peers, CASE WHEN price <= 0 THEN 'QUARANTINED' WHEN peers < 2 THEN 'TRUSTED_LOW_EVIDENCE'
      WHEN price / reference < 0.35 OR price / reference > 2.75 THEN 'QUARANTINED' ELSE 'TRUSTED' END AS status FROM q)"""


def _windows() -> str:
    inside = "price > 0 AND seen_at >= TIMESTAMP '1998-09-02' - INTERVAL {0} DAYS"
    return ", ".join(f"count(price) FILTER ({inside}) AS count_{{0}}, floor(sum(round(price * 100)::BIGINT) FILTER ({inside}) / count(price) FILTER ({inside}) + 0.5) / 100 AS avg_{{0}}, min(price) FILTER ({inside}) AS min_{{0}}, max(price) FILTER ({inside}) AS max_{{0}}".format(d) for d in (7, 30, 90))


def _last(n: int) -> str:
    return f"l AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seen_at DESC, order_id DESC, line DESC) AS back FROM obs QUALIFY back <= {n})"


SQL = {
    "price_comparison_summary": f"""WITH {SQL_CUR}, f AS (SELECT *, {_AGE} <= {STALE} AS fresh FROM cur WHERE {_SERVING}),
        p AS (SELECT *, fresh OR NOT bool_or(fresh) OVER (PARTITION BY product_id) AS pool FROM f),
        b AS (SELECT *, min(CASE WHEN pool THEN total END) OVER (PARTITION BY product_id) AS best FROM p),
        g AS (SELECT product_id, count(*) AS offers, count(DISTINCT store_id) AS stores, count_if(fresh)::BIGINT AS fresh_offers, min(best) AS best_total,
              max(total) AS highest_total, count_if(pool AND total = best)::BIGINT AS best_offers FROM b GROUP BY product_id)
        SELECT g.*, round(highest_total - best_total, 2) AS saving, round(round(highest_total - best_total, 2) / highest_total * 100, 2) AS saving_percent,
               p_name AS name, p_brand AS brand FROM g JOIN part ON p_partkey = product_id""",
    "offer_best_flag": f"""WITH {SQL_CUR} SELECT product_id, arg_min(store_id, (total, store_id)) AS best_store_id, min(total) AS best_total, count(*) AS offers FROM cur WHERE {_ELIGIBLE} GROUP BY product_id""",
    "store_status_rollup": f"""WITH {SQL_CUR}, g AS (SELECT store_id, count(*) AS offers, count_if({_SERVING})::BIGINT AS serving, count_if({_SERVING} AND {_AGE} <= {STALE})::BIGINT AS fresh FROM cur GROUP BY store_id)
        SELECT *, CASE WHEN fresh > 0 THEN 'ACTIVE' WHEN serving > 0 THEN 'STALE' ELSE 'NO_ACTIVE_OFFER' END AS status FROM g""",
    "store_winner": f"""WITH {SQL_OBS} SELECT product_id, store_id, order_id, line, total FROM obs QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY total, seen_at DESC, order_id, line) = 1""",
    "duplicate_offers": f"WITH {SQL_OBS} SELECT product_id, store_id, count(*) AS n, min(order_id) AS first_order FROM obs GROUP BY ALL HAVING count(*) > 1",
    "multi_store_products": f"WITH {SQL_CUR} SELECT product_id, count(DISTINCT store_id) AS stores FROM cur WHERE {_ELIGIBLE} GROUP BY product_id HAVING count(DISTINCT store_id) >= 2",
    "products_without_offers": f"WITH {SQL_CUR} SELECT p_partkey AS product_id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM cur WHERE product_id = p_partkey AND {_SERVING})",
    "active_brands": f"WITH {SQL_CUR} SELECT DISTINCT p_brand AS brand FROM part WHERE p_partkey IN (SELECT product_id FROM cur WHERE {_SERVING})",
    "peer_cheaper_offers": f"WITH {SQL_CUR} SELECT a.product_id, a.store_id, count(*) AS cheaper, min(b.total) AS best_peer FROM cur a JOIN cur b ON a.product_id = b.product_id AND a.store_id <> b.store_id AND b.total < a.total GROUP BY ALL",
    "price_quarantine": f"WITH {SQL_CUR}, {_PEERS} SELECT product_id, store_id, price, peers, status FROM v",
    "two_pass_audit": f"""WITH {SQL_CUR}, {_PEERS}, k AS (SELECT product_id, median(price) AS med, count(*) AS kept FROM v WHERE status <> 'QUARANTINED' GROUP BY product_id)
        SELECT v.product_id, store_id, price, status AS first_status, CASE WHEN price <= 0 THEN 'QUARANTINED' WHEN coalesce(kept, 0) < 2 THEN 'TRUSTED_LOW_EVIDENCE'
               WHEN price / med < 0.35 OR price / med > 2.75 THEN 'QUARANTINED' ELSE 'TRUSTED' END AS second_status
        FROM v LEFT JOIN k USING (product_id) WHERE status = 'QUARANTINED'""",
    "price_windows_7_30_90": f"WITH {SQL_OBS} SELECT product_id, {_windows()} FROM obs GROUP BY product_id",
    "history_summary": f"""WITH {SQL_OBS}, {_SUMMARY}, c AS (SELECT *, CASE WHEN first_price > 0 THEN round((last_price - first_price) / first_price * 100, 2) END AS change_percent FROM s)
        SELECT *, CASE WHEN change_percent > 0.5 THEN 'rising' WHEN change_percent < -0.5 THEN 'falling' ELSE 'stable' END AS trend FROM c""",
    "price_trend_last6": f"""WITH {SQL_OBS}, {_last(6)}, g AS (SELECT product_id, count(*) AS points, arg_max(price, back) AS first_price, arg_min(price, back) AS last_price FROM l GROUP BY product_id),
        c AS (SELECT *, round((last_price - first_price) / nullif(first_price, 0) * 100, 2) AS change_percent FROM g)
        SELECT *, CASE WHEN points < 2 THEN 'unknown' WHEN change_percent <= -2 THEN 'falling' WHEN change_percent >= 2 THEN 'rising' ELSE 'stable' END AS trend FROM c""",
    "volatility_band": f"WITH {SQL_OBS}, {_last(16)} SELECT product_id, count(*) AS points, round(stddev_pop(price) / nullif(avg(price), 0), 4) AS volatility FROM l GROUP BY product_id",
    "price_change_events": f"""WITH {SQL_OBS}, b AS (SELECT *, lag(total) OVER (PARTITION BY product_id, store_id ORDER BY seen_at, order_id, line) AS previous_total FROM obs)
        SELECT product_id, store_id, order_id, line, seen_at, previous_total, total FROM b WHERE previous_total IS NULL OR total <> previous_total""",
    "fake_discounts": f"WITH {SQL_OBS}, {_SUMMARY} SELECT product_id, points, lowest, highest, average, last_price, points >= 3 AND last_price >= average AND (highest - lowest) / nullif(lowest, 0) >= 0.1 AS fake FROM s",
    "lifecycle_reconcile": f"""WITH {SQL_CUR}, n AS (SELECT product_id, CASE WHEN {_AGE} > 60000 THEN 'ARCHIVED' WHEN {_AGE} > 36000 THEN 'MISSING' WHEN hidden THEN 'OUT_OF_STOCK' ELSE lifecycle END AS next_lifecycle FROM cur)
        SELECT next_lifecycle, count(*) AS offers, count(DISTINCT product_id) AS products FROM n GROUP BY next_lifecycle""",
    "stale_offers": f"WITH {SQL_CUR} SELECT product_id, store_id, seen_at, total FROM cur WHERE {_SERVING} AND NOT {_AGE} <= {STALE}",
    "alert_triggers": f"""WITH {SQL_CUR}, b AS (SELECT product_id, arg_min(store_id, (total, store_id)) AS best_store_id, min(total) AS best_total FROM cur WHERE {_ELIGIBLE} GROUP BY product_id)
        SELECT product_id, best_store_id, best_total, round_even(best_total * 100, 0)::BIGINT AS price_key FROM b JOIN part ON p_partkey = product_id WHERE p_retailprice * 0.6 >= best_total""",
    "price_drop_topk": f"""WITH {SQL_OBS}, {_SUMMARY} SELECT product_id, last_price, round((highest - last_price) / highest, 6) AS "drop" FROM s ORDER BY 3 DESC, 1 LIMIT 100""",
    "integrity_invariants": """SELECT 'orphan_products' AS invariant, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'orphan_stores', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT 'orphan_orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'bad_prices', count(*) FROM lineitem WHERE l_extendedprice <= 0
        UNION ALL SELECT 'repeated_keys', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "counter_drift": """WITH s AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS line_total FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, coalesce(lines, 0) AS lines FROM orders LEFT JOIN s ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(line_total, 0)) > 0.1 * o_totalprice""",
    "consecutive_misses": f"""WITH {SQL_OBS}, i AS (SELECT store_id, hidden, count_if(NOT hidden) OVER (PARTITION BY store_id ORDER BY seen_at, order_id, line ROWS UNBOUNDED PRECEDING) AS island FROM obs),
        r AS (SELECT store_id, island, count(*) AS n FROM i WHERE hidden GROUP BY ALL) SELECT store_id, max(n) AS longest, count(*) AS runs FROM r GROUP BY store_id""",
    "category_rollup": f"""WITH {SQL_CUR} SELECT p_type AS category, count(DISTINCT product_id) AS products, count(*) AS offers, count(DISTINCT p_brand) AS brands, count(DISTINCT store_id) AS stores, min(price) AS min_price, max(price) AS max_price
        FROM cur JOIN part ON p_partkey = product_id WHERE {_ELIGIBLE} GROUP BY p_type""",
    "brand_rollup": f"""WITH {SQL_CUR} SELECT p_brand AS brand, count(DISTINCT product_id) AS products, count(*) AS offers, count(DISTINCT store_id) AS stores, min(price) AS min_price
        FROM cur JOIN part ON p_partkey = product_id WHERE {_ELIGIBLE} GROUP BY p_brand""",
}
