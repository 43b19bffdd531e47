"""Comparison of a product's offers by variant, a store's page, offers of a marketplace, and the low-price rule of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.sources.tables import cents

#: What an availability text says of an offer that can't be had (fixed values).
GONE = ("stokta yok", "tükendi", "stok dışı", "out of stock")
#: Kinds whose prices may not lie too far under their peers', the least ratio and the least number of peers (fixed values).
LOW_PRICE_KINDS, LOW_RATIO, LOW_PEERS = ("accessory", "phone"), 0.55, 2


def available(price: Column, active: Column, hidden: Column, lifecycle: Column, availability: Column) -> Column:
    """Active, shown, ACTIVE in its lifecycle (as it is written; null counts as ACTIVE), with a price, and not said to be gone."""
    text = F.lower(F.coalesce(availability, F.lit("")))
    said = text.contains(GONE[0])
    for words in GONE[1:]:
        said = said | text.contains(words)
    return active & ~hidden & (F.coalesce(lifecycle, F.lit("ACTIVE")) == "ACTIVE") & (F.coalesce(price, F.lit(0.0)) > 0) & ~said


def compared(offers: DataFrame) -> DataFrame:
    """Offers of each product's selected variant with total, best flag and score; ``offers`` as they come otherwise.

    Reads product_id, variant_id, offer_id, price, shipping, is_available,
    official, delivery.  The variant with the cheapest available offer is
    selected (the smallest id of equal ones), the smallest variant if none is
    available; a product without variants (all null) is compared as a whole.
    An available offer scores 50, 25 more with the least total, 10 with free
    shipping, 10 of an official seller, 5 with a delivery text, 100 at most.
    """
    choice = F.struct(~F.col("is_available"), F.when(F.col("is_available"), F.col("price")), F.col("variant_id"))
    chosen = offers.where("variant_id is not null").groupBy("product_id").agg(F.min_by("variant_id", choice).alias("selected"))
    rows = offers.join(chosen, "product_id", "left").where("selected is null or variant_id = selected").drop("selected")
    rows = rows.withColumn("total", F.col("price") + F.coalesce("shipping", F.lit(0.0)))
    ok = F.col("is_available")
    rows = rows.withColumn("least", F.min(F.when(ok, F.col("total"))).over(Window.partitionBy("product_id")))
    best = ok & (F.col("total") == F.col("least"))
    score = 50.0 + F.when(best, 25).otherwise(0) + F.when(F.coalesce("shipping", F.lit(0.0)) <= 0, 10).otherwise(0) + F.when(F.coalesce("official", F.lit(False)), 10).otherwise(0) + F.when(F.coalesce("delivery", F.lit("")) != "", 5).otherwise(0)
    return rows.withColumns({"is_best": F.coalesce(best, F.lit(False)), "score": F.when(ok, F.least(F.lit(100.0), score)).otherwise(0.0)}).drop("least")


def comparison_summary(rows: DataFrame, store: str = "store_id") -> DataFrame:
    """One row a product of `compared` rows: offers, available ones, their stores, least and largest total, saving, best store."""
    ok = F.col("is_available")
    out = rows.groupBy("product_id").agg(
        F.min("variant_id").alias("variant_id"), F.count(F.lit(1)).alias("total_offers"), F.count_if(ok).alias("offers"), F.count_distinct(F.when(ok, F.col(store))).alias("stores"),
        F.min(F.when(ok, F.col("total"))).alias("best_total"), F.max(F.when(ok, F.col("total"))).alias("highest_total"), F.min(F.when(ok, F.struct("total", F.col(store).alias("s"))))["s"].alias("best_store"),
    )
    saving = F.coalesce(F.col("highest_total") - F.col("best_total"), F.lit(0.0))
    return out.withColumns({"saving": cents(saving), "saving_percent": F.when(saving > 0, cents(saving / F.col("highest_total") * 100)).otherwise(0.0)})


def store_page(offers: DataFrame, top: int = 80) -> DataFrame:
    """Each store's ``top`` cheapest active offers (the feature is the limit) with the number of them in their category."""
    order = Window.partitionBy("store_id").orderBy("price", "product_id")
    rows = offers.where("active").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Diğer"))
    return rows.withColumn("category", category).withColumn("of_category", F.count(F.lit(1)).over(Window.partitionBy("store_id", "category")))


def marketplace_offers(offers: DataFrame) -> DataFrame:
    """A product's offers, of one store and reference (its code, else its address) the cheapest, with the best flag and what it saves against the dearest.

    Best and dearest are of all offers, before repeated ones go.  Reads
    product_id, store_id, code, url, price, offer_id.
    """
    whole = Window.partitionBy("product_id")
    reference = F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.col("url"))
    rows = offers.withColumns({"low": F.min("price").over(whole), "high": F.max("price").over(whole), "reference": reference})
    first = Window.partitionBy("product_id", "store_id", "reference").orderBy("price", "offer_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.withColumns({"is_best": F.col("price") == F.col("low"), "saving": cents(F.col("high") - F.col("price"))}).drop("_n", "low", "high")


def low_price_verdict(kind: Column, peers: Column, ratio: Column) -> Column:
    """QUARANTINED for a phone or accessory under .55 of its peers' median, from two peers on; else null: other rules decide."""
    return F.when(kind.isin(*LOW_PRICE_KINDS) & (peers >= LOW_PEERS) & (ratio < LOW_RATIO), "QUARANTINED")
