"""Conversation prefix trie: rolling prefix fingerprints group candidates, groups are verified, sums roll up to parents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A fingerprint is the remainders of one polynomial in BASE by two primes below 2^31: products fit 64 bits.
MODULI = (2147483647, 2147483629)
BASE = (1000003, 1000033)
#: A conversation is dealt out in PIECES if it has more than HOT turns and over a thousandth of all turns.
HOT, PIECES = 4096, 64
#: Turns of a conversation that one window sums, and ids that are joined to one string.
RUN, IDS = 4096, 4096

WORD = r"[^\x20\x09-\x0D]+"

_KEY = ["depth", "fp", "split"]


def _left_out(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty, and leaves out of its own."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(4)).cast("int")


def _powers(n: int, base: int, modulus: int) -> np.ndarray:
    """``base`` to the 0 .. n - 1, by doubling."""
    out = np.ones(n, np.int64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * pow(base, k, modulus) % modulus
        k *= 2
    return out


class PrefixScan:
    """Depths and fingerprints of turns sorted by conversation, piece and place, batch after batch."""

    def __init__(self, moduli: tuple[int, int] = MODULI) -> None:
        self.moduli, self.open, self.state = moduli, None, [0] * 4
        self.powers = [np.ones(1, np.int64)] * 2

    def of(self, conv: np.ndarray, piece: np.ndarray, own: np.ndarray, skip: np.ndarray, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which turns stay, their depth, and by modulus the sum up to and before each.

        Of a piece's own turns the first ``skip`` go.  ``terms`` are the turns' hashes.
        """
        here = (conv[0], piece[0])
        new = np.concatenate(([here != self.open], (conv[1:] != conv[:-1]) | (piece[1:] != piece[:-1])))
        begins = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        goes_on = np.cumsum(new) == 0

        def running(v: np.ndarray, before: int) -> np.ndarray:
            total = np.cumsum(v)
            return total - total[begins] + v[begins] + np.where(goes_on, before, 0)

        own_n = running(own.astype(np.int64), self.state[0])
        stays = ~own | (own_n > skip)
        depth = running(stays.astype(np.int64), self.state[1])
        after, before = [], []
        for m, (t, p) in enumerate(zip(terms, self.moduli)):
            if len(self.powers[m]) <= depth.max():
                self.powers[m] = _powers(2 * int(depth.max()) + 1, BASE[m], p)
            term = np.where(stays, t % p * self.powers[m][depth] % p, 0)
            total = running(term, self.state[2 + m])
            after.append(total % p)
            before.append((total - term) % p)
        self.open, self.state = (conv[-1], piece[-1]), [int(own_n[-1]), int(depth[-1]), *(int(a[-1]) for a in after)]
        return stays, depth, after, before


def _scanned(rows: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """conv, piece, depth, sums after (h0, h1) and before (g0, g1), role, text of the turns that stay, within each piece."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = PrefixScan(moduli)
        for part in parts:
            if not part.num_rows:
                continue
            conv, piece, own, skip, t0, t1 = (part.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            stays, depth, after, before = scan.of(conv, piece, own, skip, [t0, t1])
            made = [part.column(0), part.column(1), *map(pa.array, (depth, *after, *before)), part.column(6), part.column(7)]
            out = pa.RecordBatch.from_arrays(made, names=["conv", "piece", "depth", "h0", "h1", "g0", "g1", "role", "text"])
            yield out if stays.all() else out.filter(pa.array(stays))

    hashed = [F.pmod(F.xxhash64(*cols), F.lit(m)) for cols, m in ((["role", "text"], MODULI[0]), (["text", "role"], MODULI[1]))]
    dealt = rows.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "own", "turn", "role", "text")
    sent = dealt.select("conv", "piece", "own", F.when(F.col("piece") == 0, _left_out(F.col("conv"))).otherwise(0).alias("skip"), *hashed, "role", "text")
    return sent.mapInArrow(run, "conv bigint, piece int, depth bigint, h0 bigint, h1 bigint, g0 bigint, g1 bigint, role string, text string")


def _cut_points(rows: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """conv and the turns that end its pieces, of conversations with more than ``hot`` turns and over a thousandth of all turns.

    At most 1,000 rows of PIECES - 1 numbers, whatever the size of the table.
    """
    total = counts.agg(F.sum("n").alias("total"))
    large = counts.join(F.broadcast(total), F.col("n") > F.greatest(F.lit(hot), F.col("total") / 1000)).select("conv")
    ends = F.percentile_approx("turn", [i / PIECES for i in range(1, PIECES)], 10_000)
    return rows.join(F.broadcast(large), "conv").groupBy("conv").agg(F.array_distinct(ends).alias("ends")).where("ends is not null")


def rebuilt_turns(conversations: DataFrame, scratch: Scratch, hot: int = HOT, moduli: tuple[int, int] = MODULI) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation with their fingerprints (conv, depth, fp, before, role, text), and conv with its number of rows."""
    spark = conversations.sparkSession
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    counts = scratch.put(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "counts")
    cuts = scratch.put(_cut_points(rows, counts, hot), "cuts")
    piece = F.coalesce(F.size(F.filter("ends", lambda e: e < F.col("turn"))), F.lit(0)) if (has_hot := not cuts.isEmpty()) else F.lit(0)
    own = (rows.join(F.broadcast(cuts), "conv", "left") if has_hot else rows).select("conv", piece.alias("piece"), F.lit(True).alias("own"), "turn", "role", "text")

    first = Window.partitionBy("conv").orderBy("turn", "role", "text")
    starts = rows.where(F.col("conv") % 20 == 0).withColumn("place", F.row_number().over(first)).where("place <= 3")
    takers = counts.select((F.col("conv") - F.col("conv") % 20).alias("start"), F.col("conv").alias("taker"), _left_out(F.col("conv")).alias("h")).where("h > 0")
    taken = takers.join(starts, F.col("start") == F.col("conv")).where("place <= h")
    taken = taken.select(F.col("taker").alias("conv"), F.lit(0).alias("piece"), F.lit(False).alias("own"), F.col("place").cast("bigint").alias("turn"), "role", "text")

    turns = scratch.put(_scanned(own.unionByName(taken), moduli), "turns")
    if has_hot:
        ends = turns.join(F.broadcast(cuts), "conv").groupBy("conv", "piece").agg(F.max(F.struct("depth", "h0", "h1")).alias("e"))
        carried = _carried(sorted((r.conv, r.piece, *r.e) for r in ends.collect()), moduli)  # at most 1,000 x PIECES rows
        names = "conv bigint, piece int, d bigint, p0 bigint, p1 bigint, c0 bigint, c1 bigint"
        turns = turns.join(F.broadcast(spark.createDataFrame(carried, names)), ["conv", "piece"], "left")

        def whole(sum_: str, m: int) -> Column:
            return F.when(F.col("d").isNull(), F.col(sum_)).otherwise((F.col(f"c{m}") + F.col(sum_) * F.col(f"p{m}")) % moduli[m])

        depth = F.col("depth") + F.coalesce("d", F.lit(0))
    else:

        def whole(sum_: str, m: int) -> Column:
            return F.col(sum_)

        depth = F.col("depth")
    fp, before = (F.shiftleft(whole(f"{k}0", 0), 31) + whole(f"{k}1", 1) for k in "hg")
    return turns.select("conv", depth.alias("depth"), fp.alias("fp"), before.alias("before"), "role", "text"), counts


def _carried(ends: list[tuple], moduli: tuple[int, int]) -> list[tuple]:
    """What each piece but the first of a conversation adds to its depths and sums, and the power its sums go by."""
    out, conv, d, c = [], None, 0, [0, 0]
    for k, piece, depth, *sums in ends:
        if k != conv:
            conv, d, c = k, 0, [0, 0]
        powers = [pow(BASE[m], d, moduli[m]) for m in (0, 1)]
        if d:
            out.append((k, piece, d, *powers, *c))
        c = [(c[m] + sums[m] * powers[m]) % moduli[m] for m in (0, 1)]
        d += depth
    return out


def _groups(turns: DataFrame) -> DataFrame:
    """One row a candidate group: its representative (smallest id), members, and whether all members' turns and parents equal the representative's."""
    last = F.struct("before", "parent_split", "role", "text")
    found = turns.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(last).alias("lo"), F.max(last).alias("hi"))
    return found.select(*_KEY, "conv_id", "n_convs", "lo.before", "lo.parent_split", F.regexp_count("lo.text", F.lit(WORD)).cast("bigint").alias("words"), (F.col("lo") == F.col("hi")).alias("alike"))


def _verified(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns and groups such that each group is one node.

    All members of a group equal its representative turn by turn iff at every
    depth they have one last turn, byte for byte, and one parent group: the
    smallest and the largest (parent, role, text) are then equal.  Groups that
    fail are split by parent, role and text, and as their children then have
    other parents, those are looked at again, until none fails.
    """
    turns = turns.withColumn("split", F.lit(0).cast("bigint")).withColumn("parent_split", F.lit(0).cast("bigint"))
    groups = scratch.put(_groups(turns), "groups")
    while not groups.where("not alike").isEmpty():
        last = [*_KEY, "before", "parent_split", "role", "text"]
        parted = turns.groupBy(*last).agg(F.min("conv").alias("part"))
        parted = turns.join(parted, last).select("conv", "depth", "fp", "before", "role", "text", F.col("part").alias("split"))
        above = parted.select("conv", (F.col("depth") + 1).alias("depth"), F.col("split").alias("parent_split"))
        turns = scratch.put(parted.join(above, ["conv", "depth"], "left").fillna(0, ["parent_split"]), "split")
        groups = scratch.put(_groups(turns), "groups")
    return turns.select("conv", *_KEY), groups


def _suffix_sums(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, depth, key, saved, leaf) with saved and leaf summed over the conversation's turns from this one on, by runs of RUN turns."""
    rows = rows.withColumn("run", F.floor(F.col("depth") / RUN))
    inside = Window.partitionBy("conv", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.where(F.col("run") > 0).groupBy("conv", "run").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("conv").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = runs.select("conv", (F.col("run") - 1).alias("run"), F.sum("s").over(later).alias("s"), F.sum("l").over(later).alias("l"))
    summed = rows.select("conv", "run", *_KEY, F.sum("saved").over(inside).alias("saved"), F.sum("leaf").over(inside).alias("leaf")).join(after, ["conv", "run"], "left")
    return summed.select(*_KEY, (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaf") + F.coalesce("l", F.lit(0))).alias("leaf"))


def _ends(last: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, streamed in order; ids are first joined in ranges of IDS."""
    parts = last.groupBy(*_KEY, F.floor(F.col("conv") / IDS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    names = [*_KEY, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if k == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], names=names)

    ordered = parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "part")
    return ordered.mapInArrow(run, "depth bigint, fp bigint, split bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, hot: int = HOT, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A rebuilt conversation is a path from the root; a node is a distinct
    beginning of such paths and is named by its smallest member and its depth.
    Turns are hash-partitioned by conversation, sorted, and scanned with numpy
    for their depth and the rolling fingerprint of the prefix.  Equal depth and
    fingerprint make a candidate group, which is verified and if need be split.

    A node's sums over its subtree need no walk up the tree: the nodes that a
    conversation represents are one run at the end of its path, so each turn of
    a path passes on what its conversation's own nodes from there on hold, and
    a sum by node adds the paths up.

    A conversation with a large part of all turns is dealt out by ranges of
    turns, whose sums are carried on afterwards; turns with one number stay
    together.  Groups are folded before they are shuffled.  The ids that end at
    one node pass through one task, joined in ranges and streamed: SHA-256 has
    no other way.

    Order: turn, null first, then role, then text, so ties have one result;
    repeated rows are repeated turns.  Null role and text are empty.  Rows
    without conv_id belong to no conversation and are left out.  A conversation
    whose rebuilt form has no turn is a member of the root only.  Without
    conversations there is no node.  Other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    found, counts = rebuilt_turns(conversations, scratch, hot, moduli)
    turns, groups = _verified(found, scratch)
    none = F.lit(0).cast("bigint")
    root = counts.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(none.alias("depth"), none.alias("fp"), none.alias("split"), "conv_id", "n_convs", F.lit(None).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("parent_split"), none.alias("words"))
    nodes = groups.drop("alike").unionByName(root)
    up = [(F.col("depth") - 1).alias("depth"), F.col("before").alias("fp"), F.col("parent_split").alias("split")]
    children = groups.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.put(nodes.join(children, _KEY, "left").fillna(0, ["n_children"]), "nodes")

    held = nodes.where("depth > 0").select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    paths = turns.join(held, ["conv", "depth"], "left").fillna(0, ["saved", "leaf"])
    sums = _suffix_sums(paths).where("saved > 0 or leaf > 0").groupBy(*_KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    sums = scratch.put(sums, "sums")
    top = sums.where("depth = 1").agg(F.coalesce(F.sum("saved_tokens"), none).alias("saved_tokens"), F.coalesce(F.sum("n_leaves"), F.lit(1).cast("bigint")).alias("n_leaves"))
    sums = sums.unionByName(top.select(none.alias("depth"), none.alias("fp"), none.alias("split"), "saved_tokens", "n_leaves"))

    rootward = counts.select("conv", none.alias("depth"), none.alias("fp"), none.alias("split"))
    last = turns.unionByName(rootward).groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("e")).select("conv", "e.*")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("split").alias("parent_split"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, _KEY, "left").join(_ends(last), _KEY, "left").join(parents, ["depth", "before", "parent_split"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", none).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
