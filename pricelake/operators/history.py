"""Price history: windows, trends, changes, volatility, forecasts, quarantine by peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.sources.tables import recency


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def mean(c: Column) -> Column:
    """The mean of money, rounded half up; summed in whole cents, so that no order of rows changes it."""
    return F.floor(F.sum(F.bround(c * 100, 0).cast("bigint")) / F.count(c) + 0.5) / 100


def window_stats(history: DataFrame, now: str, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Per product and window: count, mean, least and greatest price above 0 seen in the last so many days."""
    out = []
    for d in days:
        inside = F.when((F.col("price") > 0) & (F.col("seen_at") >= _now(now) - F.expr(f"INTERVAL {d} DAYS")), F.col("price"))
        out += [F.count(inside).alias(f"count_{d}"), F.when(F.count(inside) > 0, mean(inside)).alias(f"avg_{d}"), F.min(inside).alias(f"min_{d}"), F.max(inside).alias(f"max_{d}")]
    return history.groupBy("product_id").agg(*out)


def summary(history: DataFrame) -> DataFrame:
    """Per product: points, least, greatest, mean, first and last price, change in percent and its trend beyond half a percent."""
    rows = history.withColumn("at", recency())
    out = rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("points"), F.min("price").alias("lowest"), F.max("price").alias("highest"), mean(F.col("price")).alias("average"),
        F.min_by("price", "at").alias("first_price"), F.max_by("price", "at").alias("last_price"),
    )
    change = F.when(F.col("first_price") > 0, F.round((F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100, 2))
    return out.withColumns({"change_percent": change, "trend": F.when(change > 0.5, "rising").when(change < -0.5, "falling").otherwise("stable")})


def recent_shape(history: DataFrame) -> DataFrame:
    """Per product: change and trend over the last 6 prices, volatility of the last 16 and 20, mean of the last 20.

    One window gives all of them.  The trend is insufficient under two prices,
    else falling or rising from 2 % on; volatility (population deviation over
    mean) is null under three prices.
    """
    rows = _last(history, 20)
    inside = lambda n: F.when(F.col("back") <= n, F.col("price"))
    out = rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(inside(6), F.when(F.col("back") <= 6, F.col("back"))).alias("first"), F.min_by("price", "back").alias("last"),
        F.when(F.count(F.lit(1)) >= 3, F.stddev_pop(inside(16)) / F.avg(inside(16))).alias("volatility_16"),
        (F.stddev_pop("price") / F.avg("price")).alias("volatility_20"), F.avg("price").alias("average_20"),
    )
    change = F.when(F.col("n") < 2, 0.0).otherwise(F.floor((F.col("last") - F.col("first")) / F.col("first") * 100 * 100 + 0.5) / 100)
    out = out.withColumn("change", change)
    trend = F.when(F.col("n") < 2, "insufficient").when(F.col("change") <= -2, "falling").when(F.col("change") >= 2, "rising").otherwise("stable")
    return out.select("product_id", "change", trend.alias("trend"), "volatility_16", "volatility_20", "average_20")


def _last(history: DataFrame, n: int) -> DataFrame:
    return _last_of(history, ["product_id"], n)


def _last_of(history: DataFrame, key: list[str], n: int) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(F.desc("seen_at"), F.desc("order_id"), F.desc("line"))
    return history.withColumn("back", F.row_number().over(by)).where(F.col("back") <= n)


def trend_last(history: DataFrame, n: int = 6, percent: float = 2.0) -> DataFrame:
    """First against last of the last ``n`` prices: falling, rising, stable; with under two points unknown."""
    out = _last(history, n).groupBy("product_id").agg(F.count(F.lit(1)).alias("points"), F.max_by("price", "back").alias("first_price"), F.min_by("price", "back").alias("last_price"))
    change = F.round((F.col("last_price") - F.col("first_price")) / F.nullif(F.col("first_price"), F.lit(0.0)) * 100, 2)
    return out.withColumns({"change_percent": change, "trend": F.when(F.col("points") < 2, "unknown").when(change <= -percent, "falling").when(change >= percent, "rising").otherwise("stable")})


def volatility(history: DataFrame, n: int = 16) -> DataFrame:
    """Population deviation over mean of the last ``n`` prices, and a band of it around the last price."""
    out = _last(history, n).groupBy("product_id").agg(F.count(F.lit(1)).alias("points"), F.avg("price").alias("mean"), F.stddev_pop("price").alias("sd"), F.min_by("price", "back").alias("last_price"))
    v = F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))
    return out.select("product_id", "points", F.round(v, 4).alias("volatility"), F.round(F.col("last_price") * F.greatest(F.lit(0.0), 1 - v), 2).alias("low_band"), F.round(F.col("last_price") * (1 + v), 2).alias("high_band"))


def changes(history: DataFrame) -> DataFrame:
    """Append on change: the first observation of each offer, and those whose total differs from the one before."""
    before = F.lag("total").over(Window.partitionBy("product_id", "store_id").orderBy("seen_at", "order_id", "line"))
    rows = history.withColumn("previous_total", before)
    return rows.where(F.col("previous_total").isNull() | (F.col("total") != F.col("previous_total"))).select("product_id", "store_id", "order_id", "line", "seen_at", "previous_total", "total")


def offer_changes(history: DataFrame) -> DataFrame:
    """Append on change of price, shipping, total (in cents) or availability: the rows that an offer's history keeps.

    Rows without a price are left out before they are compared; null shipping
    is 0 and null availability empty.  Reads the columns that
    `streaming.catalog.history_stream` reads; both keep the same rows.
    """
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint")
    rows = history.where("price > 0").withColumns({"shipping": F.coalesce("shipping", F.lit(0.0)), "availability": F.coalesce("availability", F.lit(""))})
    rows = rows.withColumn("_now", F.struct(*[cents(c).alias(c) for c in ("price", "shipping", "total")], "availability"))
    before = F.lag("_now").over(Window.partitionBy("product_id", "store_id").orderBy("seen_at", "order_id", "line"))
    kept = rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("_now")))
    return kept.select("product_id", "store_id", "order_id", "line", "seen_at", "price", "shipping", "total", "availability")


def fake_discount(history: DataFrame) -> DataFrame:
    """Products with three points or more, prices that spread a tenth or more, and a last price no better than the mean."""
    history, at = history.withColumn("at", recency()), "at"
    out = history.groupBy("product_id").agg(F.count(F.lit(1)).alias("points"), F.min("price").alias("lowest"), F.max("price").alias("highest"), mean(F.col("price")).alias("average"), F.max_by("price", at).alias("last_price"))
    return out.withColumn("fake", (F.col("points") >= 3) & (F.col("last_price") >= F.col("average")) & ((F.col("highest") - F.col("lowest")) / F.nullif(F.col("lowest"), F.lit(0.0)) >= 0.1))


def integrity_status(price: Column, peers: Column, ratio: Column, low: float = 0.35, high: float = 2.75) -> Column:
    """QUARANTINED, TRUSTED_LOW_EVIDENCE or TRUSTED, by a price and its ratio to the peers' median (fixed values)."""
    outside = (ratio < low) | (ratio > high)
    return F.when(price <= 0, "QUARANTINED").when(peers < 2, "TRUSTED_LOW_EVIDENCE").when(outside, "QUARANTINED").otherwise("TRUSTED")


def quarantine(offers: DataFrame, low: float = 0.35, high: float = 2.75) -> DataFrame:
    """Each offer against the median of the product's offers in other stores.

    Under two peers: TRUSTED_LOW_EVIDENCE; a ratio under ``low`` or over
    ``high``: QUARANTINED.  ``offers`` has one row for each product and store,
    so an offer's peers are the product's prices in order without its own: the
    k-th of them is the product's k-th before its own place, the next one
    from there.  Four order statistics a product give every offer's median.
    """
    whole = Window.partitionBy("product_id")
    rows = offers.withColumns({"rn": F.row_number().over(whole.orderBy("price", "store_id")), "n": F.count(F.lit(1)).over(whole)})
    low_at, high_at = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2) + 1

    def price_at(k: Column) -> Column:
        return F.max(F.when(F.col("rn") == k, F.col("price"))).over(whole)

    rows = rows.withColumns({"l0": price_at(low_at), "l1": price_at(low_at + 1), "u0": price_at(high_at), "u1": price_at(high_at + 1), "peers": F.col("n") - 1})
    lower, upper = F.when(F.col("rn") > low_at, F.col("l0")).otherwise(F.col("l1")), F.when(F.col("rn") > high_at, F.col("u0")).otherwise(F.col("u1"))
    rows = rows.withColumn("reference", F.when(F.col("peers") >= 1, (lower + upper) / 2))
    rows = rows.withColumn("ratio", F.when(F.col("peers") >= 2, F.col("price") / F.nullif(F.col("reference"), F.lit(0.0))))
    status = integrity_status(F.col("price"), F.col("peers"), F.col("ratio"), low, high)
    return rows.select("product_id", "store_id", "price", "peers", F.round("reference", 2).alias("reference"), F.round("ratio", 4).alias("ratio"), status.alias("status"))


def evidence_status(offers: DataFrame, history: DataFrame, last: int = 20) -> DataFrame:
    """product_id, store_id, price, peers, ratio, status: each offer against its peers and its own history.

    The median of an offer's own last prices joins its peers if there are any
    and it lies between .60 and 1.67 of their median.  With one number more the
    median of the evidence still comes from order statistics: of the peers, the
    ones around the middle are enough, and the own median falls before,
    between or after them.
    """
    whole = Window.partitionBy("product_id")
    rows = offers.withColumns({"rn": F.row_number().over(whole.orderBy("price", "store_id")), "n": F.count(F.lit(1)).over(whole)})
    peers = F.col("n") - 1

    def ordered(k: Column) -> Column:
        """The product's price at place ``k``, for places that depend on its number of offers alone."""
        return F.max(F.when(F.col("rn") == k, F.col("price"))).over(whole)

    # peers in order without the own price: place k of them is the product's k before the own place, else k + 1
    middle = F.floor(peers / 2)
    near = {i: ordered(middle + i) for i in range(-1, 4)}
    rows = rows.withColumns({f"o{i + 1}": c for i, c in near.items()} | {"peers": peers, "middle": middle})
    peer = lambda i: F.when(F.col("rn") > F.col("middle") + i, F.col(f"o{i + 1}")).otherwise(F.col(f"o{i + 2}"))
    before, here, after = peer(0), peer(1), peer(2)
    odd = F.col("peers") % 2 == 1
    peer_median = F.when(F.col("peers") == 0, None).when(odd, here).otherwise((before + here) / 2)
    recent = _last_of(history, ["product_id", "store_id"], last).groupBy("product_id", "store_id").agg(F.percentile("price", F.lit(0.5)).alias("own"))
    rows = rows.withColumns({"before": before, "here": here, "after": after, "peer_median": peer_median}).join(recent, ["product_id", "store_id"], "left")
    joins = F.coalesce((F.col("peers") >= 1) & (F.col("own") / F.col("peer_median")).between(0.60, 1.67), F.lit(False))
    between = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    own = F.col("own")
    # an even number of peers and one more: the middle one; an odd number and one more: the mean of two
    low, high = F.coalesce("before", F.col("here")), F.coalesce("after", F.col("here"))
    with_even = between(own, F.col("before"), F.col("here"))
    lower = F.when(own <= F.col("here"), F.when(F.col("peers") > 1, F.greatest(own, low)).otherwise(own)).otherwise(F.col("here"))
    upper = F.when(own <= F.col("here"), F.col("here")).otherwise(F.when(F.col("peers") > 1, F.least(own, high)).otherwise(own))
    median = F.when(joins, F.when(odd, (lower + upper) / 2).otherwise(with_even)).otherwise(F.col("peer_median"))
    rows = rows.withColumns({"count": F.col("peers") + joins.cast("int"), "ratio": F.col("price") / F.nullif(median, F.lit(0.0))})
    status = integrity_status(F.col("price"), F.col("count"), F.col("ratio"))
    return rows.select("product_id", "store_id", "price", F.col("count").cast("bigint").alias("peers"), "ratio", status.alias("status"))
