"""Offer predicates, best offers, ranking and comparison of a product's offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def serving() -> Column:
    """Offers that are shown: lifecycle ACTIVE, not hidden, a price above 0."""
    return (F.upper(F.coalesce("lifecycle", F.lit("ACTIVE"))) == "ACTIVE") & ~F.col("hidden") & (F.col("price") > 0)


def eligible() -> Column:
    """Offers that can be the best: ACTIVE or UPDATED, not hidden, a price above 0."""
    return F.col("lifecycle").isin("ACTIVE", "UPDATED") & ~F.col("hidden") & (F.col("price") > 0)


def age_hours(now: str) -> Column:
    return F.timestamp_diff("SECOND", "seen_at", F.lit(now).cast("timestamp_ntz")) / 3600


def fresh(now: str, stale_hours: float) -> Column:
    """Not older than ``stale_hours``; an age of exactly that is still fresh."""
    return age_hours(now) <= stale_hours


def best_offers(offers: DataFrame) -> DataFrame:
    """The one best offer of each product among the eligible: least total, then store."""
    best = offers.where(eligible()).groupBy("product_id").agg(F.min(F.struct("total", "store_id")).alias("b"), F.count(F.lit(1)).alias("offers"))
    return best.select("product_id", F.col("b.store_id").alias("best_store_id"), F.col("b.total").alias("best_total"), "offers")


def compare(offers: DataFrame, now: str, stale_hours: float) -> DataFrame:
    """Each product's comparison over its serving offers: fresh ones if there are any, else all.

    ``offers`` has one row for each product and store.  offers, stores,
    fresh_offers, best and highest total, saving and its percentage, and how
    many offers are at the best total (all of them are flagged best).
    """
    whole = Window.partitionBy("product_id")
    rows = offers.where(serving()).select("product_id", "total", fresh(now, stale_hours).alias("fresh"))
    least = F.coalesce(F.min(F.when(F.col("fresh"), F.col("total"))).over(whole), F.min("total").over(whole))
    rows = rows.withColumns({"best": least, "pool": F.col("fresh") | ~F.max("fresh").over(whole)})  # one window, and its order serves the aggregate
    out = rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("offers"), F.count(F.lit(1)).alias("stores"), F.count_if("fresh").alias("fresh_offers"), F.min("best").alias("best_total"),
        F.max("total").alias("highest_total"), F.count_if(F.col("pool") & (F.col("total") == F.col("best"))).alias("best_offers"),
    )
    saving = F.round(F.col("highest_total") - F.col("best_total"), 2)
    return out.withColumns({"saving": saving, "saving_percent": F.round(saving / F.col("highest_total") * 100, 2)})


def store_status(offers: DataFrame, now: str, stale_hours: float) -> DataFrame:
    """Each store's offers, serving and fresh ones: ACTIVE, STALE or NO_ACTIVE_OFFER."""
    out = offers.groupBy("store_id").agg(F.count(F.lit(1)).alias("offers"), F.count_if(serving()).alias("serving"), F.count_if(serving() & fresh(now, stale_hours)).alias("fresh"))
    return out.withColumn("status", F.when(F.col("fresh") > 0, "ACTIVE").when(F.col("serving") > 0, "STALE").otherwise("NO_ACTIVE_OFFER"))


def lifecycle(offers: DataFrame, now: str, missing_hours: float, archive_hours: float) -> DataFrame:
    """The next lifecycle of each offer by age: ARCHIVED, MISSING, or what it is."""
    age = age_hours(now)
    return offers.withColumn("next_lifecycle", F.when(age > archive_hours, "ARCHIVED").when(age > missing_hours, "MISSING").when(F.col("hidden"), "OUT_OF_STOCK").otherwise(F.col("lifecycle")))
