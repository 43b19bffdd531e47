"""Queries of comparison by variant, store pages, marketplace offers and the low-price rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import comparison as C
from pricelake.operators import history as H
from pricelake.sources.listings import DEVICE, SQL_DEVICES
from pricelake.sources.tables import SQL_CUR, SQL_OBS, current_offers, observations, products, read


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current offers with a variant by the store, a stock text, a seller's mark and a delivery text by the order."""
    o = current_offers(spark, sf_dir)
    n = F.col("order_id")
    said = F.when(n % 10 == 0, "Tükendi").when(n % 10 == 1, "OUT OF STOCK").when(n % 10 == 2, None).otherwise("Stokta var")
    ok = C.available(F.col("price"), n % 13 != 0, F.col("hidden"), F.col("lifecycle"), said)
    return o.select(
        "product_id", "store_id", (F.col("store_id") % 3).alias("variant_id"), (F.col("store_id") + F.col("product_id") * 10_000_000).alias("offer_id"), "price", F.when(n % 4 == 0, 0.0).otherwise(F.col("shipping")).alias("shipping"),
        ok.alias("is_available"), (F.col("store_id") % 5 == 0).alias("official"), F.when(n % 3 == 0, "yarın kapında").alias("delivery"),
    )


def global_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offer of each product's selected variant with its score."""
    return C.compared(_offers(spark, sf_dir)).select("product_id", "variant_id", "store_id", "total", "is_available", "is_best", "score")


def global_comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_summary(C.compared(_offers(spark, sf_dir)))


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every store's page: its cheapest shown offers (the feature is the limit) and their categories."""
    o = current_offers(spark, sf_dir).select("store_id", "product_id", "price", (~F.col("hidden")).alias("active"))
    rows = o.join(products(spark, sf_dir).select("product_id", "category"), "product_id")
    return C.store_page(rows).select("store_id", "place", "product_id", "price", "category", "of_category")


def marketplace_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations as a marketplace's rows: of one store's repeated ones the cheapest stays."""
    o = observations(spark, sf_dir)
    code = F.when(F.col("order_id") % 3 != 0, F.concat(F.lit("c"), F.col("order_id") % 2))
    rows = o.select("product_id", "store_id", code.alias("code"), F.concat(F.lit("/p/"), F.col("line") % 2).alias("url"), "price", (F.col("order_id") * 10 + F.col("line")).alias("offer_id"))
    return C.marketplace_offers(rows).select("product_id", "store_id", "reference", "offer_id", "price", "is_best", "saving")


def low_price_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of phones and accessories that lie too far under their peers' median."""
    kinds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).selectExpr("k", f"{DEVICE['kind']} AS kind").select(F.col("k").alias("product_id"), "kind")
    rows = H.quarantine(current_offers(spark, sf_dir)).join(kinds, "product_id")
    verdict = C.low_price_verdict(F.col("kind"), F.col("peers"), F.col("ratio"))
    return rows.withColumn("verdict", verdict).where("verdict is not null").select("product_id", "store_id", "kind", "price", "peers", "ratio", "verdict")


QUERIES = {f.__name__: f for f in (global_comparison, global_comparison_summary, store_pages, marketplace_offers, low_price_quarantine)}

_V = f"""WITH {SQL_CUR}, o AS (SELECT product_id, store_id, store_id % 3 AS variant_id, price, CASE WHEN order_id % 4 = 0 THEN 0.0 ELSE shipping END AS shipping, store_id % 5 = 0 AS official, order_id % 3 = 0 AS delivery,
        order_id % 13 <> 0 AND NOT hidden AND lifecycle = 'ACTIVE' AND price > 0 AND order_id % 10 NOT IN (0, 1) AS is_available FROM cur),
    c AS (SELECT product_id, variant_id FROM o QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY is_available DESC, CASE WHEN is_available THEN price END, variant_id) = 1),
    s AS (SELECT o.*, price + shipping AS total FROM o JOIN c USING (product_id, variant_id)),
    b AS (SELECT *, min(total) FILTER (is_available) OVER (PARTITION BY product_id) AS least FROM s)"""

SQL = {
    "global_comparison": _V
    + """ SELECT product_id, variant_id, store_id, total, is_available, coalesce(is_available AND total = least, false) AS is_best, CASE WHEN is_available THEN 50.0 + CASE WHEN total = least THEN 25 ELSE 0 END + CASE WHEN shipping <= 0 THEN 10 ELSE 0 END
        + CASE WHEN official THEN 10 ELSE 0 END + CASE WHEN delivery THEN 5 ELSE 0 END ELSE 0.0 END::DOUBLE AS score FROM b""",
    "global_comparison_summary": _V
    + """, g AS (SELECT product_id, min(variant_id) AS variant_id, count(*) AS total_offers, count(*) FILTER (is_available) AS offers, count(DISTINCT store_id) FILTER (is_available) AS stores, min(total) FILTER (is_available) AS best_total,
        max(total) FILTER (is_available) AS highest_total, arg_min(store_id, row(total, store_id)) FILTER (is_available) AS best_store FROM b GROUP BY product_id)
        SELECT *, floor(coalesce(highest_total - best_total, 0.0) * 100 + 0.5) / 100 AS saving, CASE WHEN highest_total > best_total THEN floor((highest_total - best_total) / highest_total * 100 * 100 + 0.5) / 100 ELSE 0.0 END AS saving_percent FROM g""",
    "store_pages": f"""WITH {SQL_CUR}, r AS (SELECT store_id, product_id, price, p_type AS category, row_number() OVER (PARTITION BY store_id ORDER BY price, product_id)::INTEGER AS place FROM cur JOIN part ON p_partkey = product_id WHERE NOT hidden)
        SELECT store_id, place, product_id, price, category, count(*) OVER (PARTITION BY store_id, category) AS of_category FROM r WHERE place <= 80""",
    "marketplace_offers": f"""WITH {SQL_OBS}, r AS (SELECT product_id, store_id, CASE WHEN order_id % 3 <> 0 THEN 'c' || (order_id % 2) ELSE '/p/' || (line % 2) END AS reference, order_id * 10 + line AS offer_id, price,
            min(price) OVER (PARTITION BY product_id) AS low, max(price) OVER (PARTITION BY product_id) AS high FROM obs)
        SELECT product_id, store_id, reference, offer_id, price, price = low AS is_best, floor((high - price) * 100 + 0.5) / 100 AS saving FROM r QUALIFY row_number() OVER (PARTITION BY product_id, store_id, reference ORDER BY price, offer_id) = 1""",
    "low_price_quarantine": f"""WITH {SQL_CUR}, {SQL_DEVICES}, p AS (SELECT a.product_id, a.store_id, a.price, count(b.price) AS peers, median(b.price) AS m FROM cur a LEFT JOIN cur b ON b.product_id = a.product_id AND b.store_id <> a.store_id GROUP BY ALL)
        SELECT product_id, store_id, kind, p.price, peers, round(p.price / m, 4) AS ratio, 'QUARANTINED' AS verdict FROM p JOIN dev ON k = product_id WHERE kind IN ('phone', 'accessory') AND peers >= 2 AND round(p.price / m, 4) < 0.55""",
}
