"""Structured Streaming forms: event validation, hourly windows, price changes and alerts with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event types that are taken in (fixed values).
EVENT_TYPES = ("click", "purchase", "error", "signup", "view")


def valid_events(events: DataFrame, longest: float = 3_600_000.0) -> DataFrame:
    """Known types only; the value is clamped to 0 and ``longest``, the properties cut at 250 characters."""
    rows = events.where(F.col("event_type").isin(*EVENT_TYPES) & F.col("ts").isNotNull())
    return rows.withColumns({"value": F.least(F.lit(longest), F.greatest(F.lit(0.0), "value")), "props": F.substring("props", 1, 250)})


def hourly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """hour, event_type, n; batch or stream, rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def change_stream(observations: DataFrame) -> DataFrame:
    """Append on change: product_id, store_id, seen_at, total of observations whose total differs from the offer's last.

    The state is one total an offer.  Inside a micro-batch rows go by time,
    order and line, as in the batch form; a batch is compared with itself
    moved by one, the state in front.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["seen_at", "order_id", "line"])
        before = rows["total"].shift(1, fill_value=state.get[0] if state.exists else float("nan"))
        state.update((float(rows["total"].iloc[-1]),))
        yield rows.loc[before != rows["total"], ["product_id", "store_id", "seen_at", "total"]]

    rows = observations.select("product_id", "store_id", F.col("seen_at").cast("timestamp").alias("seen_at"), "order_id", "line", "total")
    schema = "product_id bigint, store_id bigint, seen_at timestamp, total double"
    return rows.groupBy("product_id", "store_id").applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def alerts(changes: DataFrame, targets: DataFrame, late: str = "1 day") -> DataFrame:
    """Stream-static join: changes whose total is not over the product's target, once for each product and price.

    Prices are keyed in cents.  A price that comes again within ``late`` is
    left out; state older than that goes, so it doesn't grow for ever.  In a
    batch all repeats are left out.
    """
    hit = changes.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", late).join(targets, "product_id").where("total <= target")
    hit = hit.select("product_id", "store_id", "seen_at", "total", F.rint(F.col("total") * 100).cast("bigint").alias("price_key"))
    key = ["product_id", "price_key"]
    return hit.dropDuplicatesWithinWatermark(key) if changes.isStreaming else hit.dropDuplicates(key)


def notifications(fired: DataFrame, late: str = "7 days") -> DataFrame:
    """One notification for each user and event within ``late``; ``fired`` has user_id, event_key, at."""
    rows = fired.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(["user_id", "event_key"]) if fired.isStreaming else rows.dropDuplicates(["user_id", "event_key"])
