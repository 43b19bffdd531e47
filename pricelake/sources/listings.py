"""Listings of stores with titles as shops write them, made from `part`.

The driver's tables have no device titles.  Each part gets a device (family,
variant, memory, disk, colour, network) by its key alone, and two listings
whose titles write it in different styles, so that an operator that reads
titles can be held against the device they came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def _pick(i: str, *values: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


def _nth(divisor: int, n: int) -> str:
    return f"CAST(floor(k / {divisor}) % {n} AS INT)"


def _text(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS STRING)"


#: SQL of the columns of a device, for Spark and for DuckDB; k is the part's key.
DEVICE = {
    "kind": "CASE CAST(k % 5 AS INT) WHEN 3 THEN 'tablet' WHEN 4 THEN 'audio' ELSE 'phone' END",
    "brand": _pick("CAST(k % 5 AS INT)", "Samsung", "Apple", "Xiaomi", "Samsung", "Xiaomi"),
    "model": f"CASE CAST(k % 5 AS INT) WHEN 0 THEN 'Galaxy S' || {_text('20 + floor(k / 5) % 6')} WHEN 1 THEN 'iPhone ' || {_text('11 + floor(k / 5) % 6')} "
    f"WHEN 2 THEN 'Redmi Note ' || {_text('9 + floor(k / 5) % 6')} WHEN 3 THEN 'Galaxy Tab S' || {_text('6 + floor(k / 5) % 4')} ELSE 'Redmi Buds ' || {_text('3 + floor(k / 5) % 4')} END",
    "variant": f"CASE CAST(k % 5 AS INT) WHEN 0 THEN {_pick(_nth(30, 4), '', 'Ultra', 'Plus', 'FE')} WHEN 1 THEN {_pick(_nth(30, 4), '', 'Pro', 'Pro Max', 'Plus')} "
    f"WHEN 2 THEN {_pick(_nth(30, 4), '', 'Pro', 'Plus', 'Pro')} WHEN 3 THEN {_pick(_nth(30, 4), '', 'Plus', 'Ultra', 'FE')} ELSE {_pick(_nth(30, 4), '', 'Lite', 'Pro', 'Active')} END",
    "ram": f"CASE WHEN k % 5 < 4 THEN CAST({_pick(_nth(7, 4), '4', '6', '8', '12')} AS INT) END",
    "storage": f"CASE WHEN k % 5 < 4 THEN CAST({_pick(_nth(11, 4), '64', '128', '256', '512')} AS INT) END",
    "color": _pick(_nth(13, 4), "Siyah", "Beyaz", "Mavi", "Gri"),
    "network": "CASE WHEN k % 5 < 3 AND k % 2 = 0 THEN '5G' ELSE '' END",
}
_RAM, _DISK = "CAST(ram AS STRING)", "CAST(storage AS STRING)"
_WITH = "CASE WHEN variant = '' THEN model ELSE model || ' ' || variant END"
_NET = "CASE WHEN network = '' THEN '' ELSE ' ' || network END"
#: SQL of a listing's title; copy is 0 or 1.
TITLE = f"""CASE WHEN kind = 'audio' THEN CASE WHEN (k + copy) % 2 = 0 THEN brand ELSE upper(brand) END || ' ' || {_WITH} || ' ' || color ELSE CASE CAST((k + copy) % 4 AS INT)
    WHEN 0 THEN brand || ' ' || {_WITH} || ' ' || {_RAM} || 'GB RAM ' || {_DISK} || 'GB ' || color || {_NET}
    WHEN 1 THEN {_WITH} || {_NET} || ' ' || {_RAM} || '/' || {_DISK} || ' GB ' || color || ' Akıllı Cihaz'
    WHEN 2 THEN upper(brand) || ' ' || {_WITH} || {_NET} || ' ' || {_DISK} || ' GB ' || {_RAM} || ' GB RAM (' || color || ')'
    ELSE brand || ' ' || {_WITH} || ' ' || {_RAM} || 'GB+' || {_DISK} || 'GB, ' || color || ', Türkiye Garantili' || {_NET} END END"""
CATEGORY = _pick("CASE kind WHEN 'phone' THEN 0 WHEN 'tablet' THEN 1 ELSE 2 END", "Elektronik > Cep Telefonu", "Elektronik > Tablet", "Elektronik > Kulaklık")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, product_id, copy, title, brand (null in one style), category, price."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"))
    rows = rows.selectExpr("*", *[f"{sql} AS {name}" for name, sql in DEVICE.items()]).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    unnamed = (F.col("kind") != "audio") & ((F.col("k") + F.col("copy")) % 4 == 1)
    return rows.select(
        (F.col("k") * 2 + F.col("copy")).alias("listing_id"), F.col("k").alias("product_id"), "copy", F.expr(TITLE).alias("title"),
        F.when(~unnamed, F.col("brand")).alias("brand"), F.expr(CATEGORY).alias("category"), "price",
    )


#: DuckDB SQL of the devices and of the listings, with the device's columns beside them.
SQL_DEVICES = "dev AS (SELECT p_partkey AS k, p_retailprice AS price, " + ", ".join(f"{sql} AS {name}" for name, sql in DEVICE.items()) + " FROM part)"
SQL_LISTINGS = SQL_DEVICES + f""", lst AS (SELECT *, k * 2 + copy AS listing_id, {TITLE} AS title, {CATEGORY} AS category FROM dev, (SELECT unnest([0, 1]) AS copy))"""
