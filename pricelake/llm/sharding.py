"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialise

#: Points of the ring: positions are 0 to RING - 1.
RING = 1 << 20


@dataclass(frozen=True)
class Ring:
    """Virtual nodes: ``starts`` ascending, arc i reaching from starts[i] to the next start, ``owners`` their shards."""

    starts: tuple[int, ...]
    owners: tuple[int, ...]


def ring(shards: int, virtual_nodes: int) -> Ring:
    """Each shard's virtual nodes at hashed positions; a shard's positions don't depend on how many others there are."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            p, salt = xxhash.xxh64_intdigest(f"shard-{s}-node-{v}") % RING, 0
            while p in at:
                salt += 1
                p = xxhash.xxh64_intdigest(f"shard-{s}-node-{v}-{salt}") % RING
            at[p] = s
    starts = sorted(at)
    return Ring(tuple(starts), tuple(at[p] for p in starts))


def position_blocks(on: Ring) -> list[tuple[int, list[int], int]]:
    """For each 1024 positions: (block, starts inside, arcs begun before), so that a position's arc is a short count."""
    out, begun = [], 0
    for block in range(RING >> 10):
        cuts = [p for p in on.starts if p >> 10 == block]
        out.append((block, cuts, begun))
        begun += len(cuts)
    return out


def place(counts: dict[int, int], on: Ring, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where each arc's rows go: (arc, first rank, end rank, shard, first slot).

    A shard may take a fixed number of rows: the total over the shards, the
    first ones one more where it doesn't divide.  Each shard first takes its
    own arcs' rows in ring order while it has room.  What then overflows goes
    clockwise, arc by arc, to the next virtual node whose shard has room.
    ``counts`` has an entry an arc, so this works on the ring, not on rows.
    """
    total, arcs = sum(counts.values()), len(on.starts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot, out, over = [0] * shards, [], []

    def take(arc: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((arc, rank, rank + n, shard, slot[shard]))
            slot[shard] += n
            room[shard] -= n
        return n

    for arc in range(arcs):
        n = counts.get(arc, 0)
        if (got := take(arc, 0, n, on.owners[arc])) < n:
            over.append((arc, got, n))
    for arc, rank, n in over:
        step = 1
        while rank < n:
            rank += take(arc, rank, n - rank, on.owners[(arc + step) % arcs])
            step += 1
    return out


#: Positions of a cell: rows are ranked inside cells, many of which make an arc.
_CELL_BITS = 6


def shard_rows(docs: DataFrame, shards: int = 8, virtual_nodes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    The law is `rows`: loads are bounded by the mean, so shard sizes differ by
    one row at most; keys overflowing a full shard continue clockwise.  A row's
    key is its id with its text's checksum, so many rows without an id still
    spread over the ring, and equal texts under different ids do not gather.
    Slots number a shard's rows from 0 without gaps, arc by arc, inside an arc
    by ring position, id, checksum and size.

    Only slim rows move.  An arc's rows are ranked in cells of the ring (16,384
    of them, whatever the number of arcs), so no task sorts an arc; the cells'
    counts, a bounded number, give each cell its first rank.  One count an arc
    reaches the driver, where the overflow is settled.  Texts are read once for
    sizes and checksums, never shuffled.

    Null text: size 1 and checksum 0, as empty text; very long texts are only
    measured.  Identical repeated rows get one slot each, ties any of their
    slots.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.  `grown_shard` is null, as this law isn't `key`.
    """
    spark: SparkSession = docs.sparkSession
    on = ring(shards, virtual_nodes)
    rows = id_text(docs, id_col, text_col)
    slim = rows.select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"))
    slim = slim.withColumn("position", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(RING)).cast("int"))
    cuts = F.broadcast(spark.createDataFrame(position_blocks(on), "block int, cuts array<int>, first int"))
    placed = slim.withColumn("block", F.shiftright("position", 10)).join(cuts, "block")
    arc_of = F.pmod(F.col("first") + F.size(F.filter("cuts", lambda c: c <= F.col("position"))) - 1, F.lit(len(on.starts))).cast("int")
    # the arc over the ring's end goes on at its beginning: there its cells come last
    wraps = F.when(F.col("position") < on.starts[0], F.col("position") + RING).otherwise(F.col("position"))
    placed = placed.select("doc_id", "size", "text_crc32", wraps.alias("position"), arc_of.alias("arc"))
    placed = placed.withColumn("cell", F.shiftright("position", _CELL_BITS))
    cells = materialise(placed.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    plan = place({r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}, on, shards)
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    first_rank = F.broadcast(cells.select("arc", "cell", F.coalesce(before, F.lit(0)).alias("first_rank")))
    inside = F.row_number().over(Window.partitionBy("arc", "cell").orderBy("position", "doc_id", "text_crc32", "size")).cast("bigint") - 1
    ranked = placed.withColumn("inside", inside).join(first_rank, ["arc", "cell"]).withColumn("rank", F.col("first_rank") + F.col("inside"))
    plan_rows = F.broadcast(spark.createDataFrame(plan, "arc int, lo bigint, hi bigint, shard int, first_slot bigint"))
    out = ranked.join(plan_rows, (ranked["arc"] == plan_rows["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    slot = (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
