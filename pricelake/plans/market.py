"""Queries over the whole market: home page, category badges, identity clusters and merges, staging, sitemap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import merge
from pricelake.sources.tables import SQL_CUR, SQL_OBS, cents, current_offers, latest, observations, products

#: Observations from here on are staged over those before.
STAGED_FROM = "1999-01-01 00:00:00"
_PAYLOAD = ["price", "shipping", "total", "lifecycle", "hidden"]


def home_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's card: best price of the available offers, or of all if none is; saving against the dearest and the list price."""
    ok = (F.col("lifecycle") == "ACTIVE") & ~F.col("hidden") & (F.col("price") > 0)
    offer = F.struct("price", "store_id")
    cards = current_offers(spark, sf_dir).groupBy("product_id").agg(
        F.coalesce(F.min(F.when(ok, offer)), F.min(offer)).alias("best"),
        F.coalesce(F.max(F.when(ok, F.col("price"))), F.max("price")).alias("dearest"),
        F.count_if(ok).alias("available"),
    )
    cards = cards.join(products(spark, sf_dir).select("product_id", "list_price"), "product_id").select("product_id", "available", F.col("best.price").alias("best_price"), F.col("best.store_id").alias("best_store_id"), "dearest", "list_price")
    percent = lambda high: F.when(F.col(high) > F.col("best_price"), cents((F.col(high) - F.col("best_price")) / F.col(high) * 100)).otherwise(0.0)
    cards = cards.withColumn("displayed", F.greatest(percent("dearest"), percent("list_price"))).drop("list_price")
    return cards.withColumn("score", F.when(F.col("displayed") > 0, F.least(F.lit(100.0), F.rint(F.col("displayed") * 3 + 55))).otherwise(50.0).cast("bigint"))


def category_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest card and the card with the largest saving in each category."""
    cards = home_cards(spark, sf_dir).join(products(spark, sf_dir).select("product_id", "category"), "product_id")
    return cards.groupBy("category").agg(
        F.count(F.lit(1)).alias("cards"),
        F.min(F.struct("best_price", "product_id"))["product_id"].alias("cheapest_id"),
        F.max("displayed").alias("largest_saving"),
        F.min(F.struct(-F.col("displayed"), "product_id"))["product_id"].alias("largest_saving_id"),
    )


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = current_offers(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("offers"))
    key = F.concat(F.lower(F.trim("brand")), F.lit("|size="), F.col("size"))
    return products(spark, sf_dir).join(n, "product_id", "left").select("product_id", key.alias("identity_key"), F.coalesce("offers", F.lit(0)).alias("offers"))


def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that more than one product has."""
    return _identities(spark, sf_dir).groupBy("identity_key").agg(F.count(F.lit(1)).alias("members"), F.min("product_id").alias("first_id"), F.sum("offers").alias("offers")).where("members > 1")


def canonical_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's survivor: of its identity the one with most offers, then the lowest id."""
    return merge.survivors(_identities(spark, sf_dir))


def merged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers relinked to the survivors; of a store's offers for one survivor the cheapest stays."""
    relinked = current_offers(spark, sf_dir).join(canonical_survivors(spark, sf_dir), "product_id")
    return relinked.groupBy("survivor_id", "store_id").agg(F.min("total").alias("total"), F.count(F.lit(1)).alias("collapsed"))


def staging_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer after the later observations are staged over the earlier ones."""
    split = F.col("seen_at") < F.lit(STAGED_FROM).cast("timestamp_ntz")
    rows = observations(spark, sf_dir)
    return merge.upsert(latest(rows.where(split)), latest(rows.where(~split)), ["product_id", "store_id"], _PAYLOAD)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (home_cards, category_badges, duplicate_clusters, canonical_survivors, merged_offers, staging_upsert)}

_OK = "lifecycle = 'ACTIVE' AND NOT hidden AND price > 0"
_PERCENT = "CASE WHEN {0} > best_price THEN floor(({0} - best_price) / {0} * 100 * 100 + 0.5) / 100 ELSE 0.0 END"
_CARDS = f"""b AS (
    SELECT product_id, count_if({_OK})::BIGINT AS available, coalesce(min(price) FILTER ({_OK}), min(price)) AS best_price,
           coalesce(arg_min(store_id, (price, store_id)) FILTER ({_OK}), arg_min(store_id, (price, store_id))) AS best_store_id, coalesce(max(price) FILTER ({_OK}), max(price)) AS dearest
    FROM cur GROUP BY product_id),
d AS (SELECT b.*, greatest({_PERCENT.format('dearest')}, {_PERCENT.format('p_retailprice')}) AS displayed FROM b JOIN part ON p_partkey = product_id),
cards AS (SELECT *, CASE WHEN displayed > 0 THEN least(100.0::DOUBLE, round_even(displayed * 3 + 55, 0)) ELSE 50 END::BIGINT AS score FROM d)"""
_IDENTITIES = "ids AS (SELECT p_partkey AS product_id, lower(trim(p_brand)) || '|size=' || p_size AS identity_key, (SELECT count(*) FROM cur WHERE cur.product_id = p_partkey) AS offers FROM part)"
_SURVIVORS = _IDENTITIES + """, sur AS (SELECT product_id, first_value(product_id) OVER (PARTITION BY identity_key ORDER BY offers DESC, product_id) AS survivor_id, count(*) OVER (PARTITION BY identity_key) AS members FROM ids)"""
_LATEST = "SELECT * FROM obs WHERE seen_at {0} TIMESTAMP '" + STAGED_FROM + "' QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen_at DESC, order_id DESC, line DESC) = 1"

SQL: dict[str, str] = {
    "home_cards": f"WITH {SQL_CUR}, {_CARDS} SELECT * FROM cards",
    "category_badges": f"""WITH {SQL_CUR}, {_CARDS} SELECT p_type AS category, count(*) AS cards, arg_min(product_id, (best_price, product_id)) AS cheapest_id, max(displayed) AS largest_saving, arg_min(product_id, (-displayed, product_id)) AS largest_saving_id
        FROM cards JOIN part ON p_partkey = product_id GROUP BY p_type""",
    "duplicate_clusters": f"WITH {SQL_CUR}, {_IDENTITIES} SELECT identity_key, count(*) AS members, min(product_id) AS first_id, sum(offers)::BIGINT AS offers FROM ids GROUP BY identity_key HAVING count(*) > 1",
    "canonical_survivors": f"WITH {SQL_CUR}, {_SURVIVORS} SELECT * FROM sur",
    "merged_offers": f"WITH {SQL_CUR}, {_SURVIVORS} SELECT survivor_id, store_id, min(total) AS total, count(*) AS collapsed FROM cur JOIN sur USING (product_id) GROUP BY ALL",
    "staging_upsert": f"""WITH {SQL_OBS}, o AS ({_LATEST.format('<')}), n AS ({_LATEST.format('>=')}),
        m AS (SELECT product_id, store_id, {', '.join(f'CASE WHEN n.price IS NULL THEN o.{c} ELSE n.{c} END AS {c}' for c in _PAYLOAD)},
              CASE WHEN o.price IS NULL THEN 'inserted' WHEN n.price IS NULL THEN 'kept' WHEN {' AND '.join(f'o.{c} = n.{c}' for c in _PAYLOAD)} THEN 'unchanged' ELSE 'updated' END AS outcome
              FROM o FULL JOIN n USING (product_id, store_id))
        SELECT *, outcome IN ('inserted', 'updated') AS queued FROM m""",
}
