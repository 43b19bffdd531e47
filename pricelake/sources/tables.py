"""Tables, and the views on them that every catalog operator works on.

The driver's tables stand for a price-comparison catalog: `part` is the product,
`supplier` the store, a `lineitem` row one observation of an offer.  Lifecycle
and visibility are proxies: `l_linestatus` O is ACTIVE and F is UPDATED,
`l_returnflag` R is hidden.  `l_tax` is the shipping share of the price, a
tenth of `l_quantity` the seller's rating, and `l_discount` stands for the
match score and for how far the crossed-out price is above the price.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of the lineitem data and of the events (parameters of every operator that needs a clock).
NOW = "2001-11-05 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    """Money to two decimals, half up, by double arithmetic alone: the same number on any engine."""
    return F.floor(c * 100 + 0.5) / 100


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a lineitem.

    product_id, store_id, order keys, price, shipping, total, old_price,
    rating, match_score, seen_at, lifecycle, hidden.
    """
    unit = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    out = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        unit.alias("price"),
        cents(unit * F.col("l_tax")).alias("shipping"),
        cents(unit * (1 + 5 * F.col("l_discount"))).alias("old_price"),
        (F.col("l_quantity") / 10).alias("rating"),
        (50 + 500 * F.col("l_discount")).alias("match_score"),
        F.col("l_shipdate").alias("seen_at"),
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("UPDATED").alias("lifecycle"),
        (F.col("l_returnflag") == "R").alias("hidden"),
    )
    return out.withColumn("total", cents(F.col("price") + F.col("shipping")))


def recency() -> Column:
    """One number that orders observations by time, order and line.

    A decimal has a fixed width, so the latest row comes from a hash aggregate;
    the largest struct would have every observation sorted twice.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("seen_at")).cast("decimal(17,0)")
    place = F.col("order_id").cast("decimal(15,0)") * F.lit(Decimal(10**5)) + F.col("line").cast("decimal(5,0)")
    return (micros * F.lit(Decimal(10**20)).cast("decimal(21,0)") + place).cast("decimal(38,0)")


#: Columns of an offer that are of fixed width; the lifecycle has two values.
_FIXED = ("order_id", "line", "price", "shipping", "total", "old_price", "rating", "match_score", "hidden")


def latest(rows: DataFrame) -> DataFrame:
    """The latest observation of each (product, store), by time, order and line."""
    rows = rows.select("product_id", "store_id", *_FIXED, "seen_at", (F.col("lifecycle") == "ACTIVE").alias("live"), recency().alias("at"))
    newest = [F.max_by(c, "at").alias(c) for c in (*_FIXED, "live")]
    out = rows.groupBy("product_id", "store_id").agg(*newest, F.max("seen_at").alias("seen_at"))
    return out.withColumn("lifecycle", F.when(F.col("live"), "ACTIVE").otherwise("UPDATED")).drop("live")


def current_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each (product, store)."""
    return latest(observations(spark, sf_dir))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


#: The same views in DuckDB SQL, for the oracle.
SQL_OBS = """u AS (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price FROM lineitem),
h AS (SELECT *, floor(price * l_tax * 100 + 0.5) / 100 AS shipping FROM u), obs AS (
    SELECT l_partkey AS product_id, l_suppkey AS store_id, l_orderkey AS order_id, l_linenumber AS line, price, shipping, floor((price + shipping) * 100 + 0.5) / 100 AS total,
           floor(price * (1 + 5 * l_discount) * 100 + 0.5) / 100 AS old_price, l_quantity / 10 AS rating, 50 + 500 * l_discount AS match_score, l_shipdate AS seen_at, CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'UPDATED' END AS lifecycle, l_returnflag = 'R' AS hidden
    FROM h)"""
SQL_CUR = SQL_OBS + """, cur AS (
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen_at DESC, order_id DESC, line DESC) AS rn FROM obs) WHERE rn = 1)"""
