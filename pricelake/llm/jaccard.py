"""N-gram Jaccard join over count vectors, with an R-tree inside blocks that exactly cover all links.

A document is the set of its word shingles.  Shingles are hashed into groups;
the number of shingles in each group makes the document a point.  The overlap
of two sets is at most the sum over the groups of the smaller count, and that
of a set with any point of an R-tree's box at most the sum of the smaller of
its count and the box's largest count.  Boxes and points whose bound is below
what a link needs are left out; what survives is verified on the sets.

One R-tree over a whole corpus does not prune: with as many groups as it
needs for a tight bound every query meets every box.  So the index is cut into
blocks first, by a rule that loses no link.  Two sets that link differ in few
shingles, D at most at their sizes.  Dealt into more than D groups by hash, one
group at least has the same shingles in both.  A block is all documents with the same
shingles in one group, and the R-tree works inside blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, id_text
from .components import components

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Members of one side of a tile: larger blocks are dealt into tiles of this many by this many.
TILE = 1024
_LEAF = 16


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int = 4) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; fewer words than a shingle has: the whole sequence; none: empty."""
    ws = text.encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    n = len(ws) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total = mix(total * _ODD[0] + h[i : i + n])
    return np.unique(total)


@lru_cache
def size_classes(longest: int = 1 << 40) -> list[int]:
    """Largest sizes of the size classes, each 1.6 times the one before."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return out


def classes_of(n: int, num: int, den: int) -> list[int]:
    """The classes that can hold the larger of a pair with a set of ``n``: its own, and those a link reaches."""
    tops, most = size_classes(), n * den // num
    k = int(np.searchsorted(tops, n))
    out = [k]
    while tops[k] < most:
        k += 1
        out.append(k)
    return out


#: Low bits of a block's key that hold its size class.
_CLASS_BITS = 6


def blocks(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """The keys of the blocks that a set is in (group and its shingles hashed, with the class), and for each class how many can be left out.

    A class with sets up to b has more groups than shingles in which linked
    sets of it differ, 2b(den-num)/(den+num) at most.  A set of n differs from
    its partners, whose sizes are at most b and n*den/num, in D shingles at
    most, so at most D of its groups differ.  If it has f > D groups that aren't
    empty, f - D of them or more are the same in any set that it links with.
    There are a few groups more than needed, so that nearly every set has so
    many; one that hasn't is also in the blocks of its empty groups, and two
    such sets have one group at least in common, empty or not.

    So a set may leave out its f - D - 1 most frequent blocks: of the blocks
    that two linked sets have in common the rarest stays in both.
    """
    tops, out, spare, n = size_classes(), [], [], len(s)
    where, what = mix(s + _ODD[1]), mix(s + _ODD[2])
    low = np.uint64((1 << _CLASS_BITS) - 1)
    for k in classes_of(n, num, den):
        widest = 2 * tops[k] * (den - num) // (den + num)
        groups = widest + 1 + (widest + 7) // 8 + (widest > 0)
        differ = (n + min(tops[k], n * den // num)) * (den - num) // (den + num)
        g = (where % np.uint64(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        full, first = np.unique(g[order], return_index=True)
        sums = np.add.reduceat(what[order], first)
        spare.append(max(0, len(full) - differ - 1))
        if len(full) <= differ:
            empty = np.setdiff1d(np.arange(groups), full)
            full, sums = np.concatenate([full, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        key = mix(mix(sums + full.astype(np.uint64) * _ODD[3]) + np.uint64((k + 1) * int(_ODD[4]) & 0xFFFFFFFFFFFFFFFF))
        out.append(key & ~low | np.uint64(k))
    return np.concatenate(out), spare


def point(s: np.ndarray) -> np.ndarray:
    """A set's count vector: a power of two of groups, about one for two shingles, by the leading bits of a hash."""
    bits = max(4, int(len(s) - 1).bit_length() - 1)
    return np.bincount((mix(s + _ODD[5]) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed(p: np.ndarray) -> bytes:
    """A count vector with as many bytes a group as its largest count needs, and that number first."""
    kind = np.min_scalar_type(int(p.max()))
    return bytes([kind.itemsize]) + p.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1)


def folded(p: np.ndarray, dims: int) -> np.ndarray:
    """The point over fewer groups: neighbours are summed."""
    return p.reshape(dims, -1).sum(axis=1, dtype=np.int64) if len(p) != dims else p.astype(np.int64)


def needed(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray:
    """The overlap that sets of sizes a and b need to link."""
    return -(-num * (a + b) // (num + den))


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """The most that two sets can overlap: the summed minima of their count vectors over the coarser one's groups."""
    dims = min(len(a), len(b))
    return int(np.minimum(folded(a, dims), folded(b, dims)).sum())


class Forest:
    """Packed R-trees of count vectors, one a tile, with the nodes of all of them in common arrays by level.

    Points are count vectors over 16 groups.  A node has its points' largest
    count in each group and the smallest of their sizes.  A tile's points lie
    in order of size and of coarser counts; every _LEAF of them make a node,
    and so on up to one root a tile.
    """

    def __init__(self, tile: np.ndarray, counts: np.ndarray, num: int, den: int) -> None:
        self.num, self.den, self.visited = num, den, 0
        sizes = counts.sum(axis=1)
        self.order = np.lexsort((*counts.reshape(len(counts), 4, -1).sum(axis=2).T, sizes, tile))
        boxes, least, of = counts[self.order], sizes[self.order], tile[self.order]
        self.levels = [(boxes, least, None, None)]
        while True:
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            cuts = np.flatnonzero(place % _LEAF == 0)
            boxes, least, of = np.maximum.reduceat(boxes, cuts), np.minimum.reduceat(least, cuts), of[cuts]
            self.levels.append((boxes, least, cuts, np.append(cuts[1:], len(place))))
            if len(cuts) == len(first):
                break
        self.tiles = of

    def query(self, tile: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (number of a query, number of a point of its tile) that may link, from the roots down."""
        root = np.searchsorted(self.tiles, tile)
        asks = np.flatnonzero(self.tiles[np.minimum(root, len(self.tiles) - 1)] == tile)
        at, sizes = root[asks], counts.sum(axis=1)
        for boxes, least, cuts, ends in reversed(self.levels):
            self.visited += len(at)
            need = needed(sizes[asks], least[at], self.num, self.den)
            may = need <= sizes[asks]
            asks, at, need = asks[may], at[may], need[may]
            may = _minima(counts, boxes, asks, at) >= need
            asks, at = asks[may], at[may]
            if cuts is not None:
                n = ends[at] - cuts[at]
                below = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                asks, at = np.repeat(asks, n), np.repeat(cuts[at], n) + below
        return asks, self.order[at]


def _minima(q: np.ndarray, boxes: np.ndarray, asks: np.ndarray, at: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Summed minima of the rows ``asks`` of ``q`` and ``at`` of ``boxes``, a bounded number of cells at a time."""
    step = max(1, cells // q.shape[1])
    parts = [np.minimum(q[asks[i : i + step]], boxes[at[i : i + step]]).sum(axis=1) for i in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


#: Sets whose keys a task has already sent are remembered, so many of them.
_SENT = 1 << 19


def signatures(docs: DataFrame, words: int, num: int, den: int, passes: int) -> DataFrame:
    """doc_id, n, set_hash (128 bits), point, first_class, spare, keys_0 to keys_(passes - 1) of every row of ``docs`` (doc_id, text).

    Of rows with one set a task gives keys and point once, with the first that
    has an id.  `spare` has a number for each class from the first one on.
    Keys are dealt into ``passes`` columns by their leading bits,
    so that each pass reads its own alone.
    """
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("point", pa.binary()), ("first_class", pa.int32()), ("spare", pa.list_(pa.int32()))]
    fields += [(f"keys_{r}", pa.list_(pa.int64())) for r in range(passes)]

    def dealt(keys: list[np.ndarray]) -> list[pa.Array]:
        flat = np.concatenate([np.zeros(0, np.uint64), *keys])
        doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        own = ((flat >> np.uint64(32)) * np.uint64(passes)) >> np.uint64(32)
        out = []
        for r in range(passes):
            mine = own == r
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[mine], minlength=len(keys)))])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[mine].view(np.int64))))
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for part in parts:
            for ids, texts in batches(part.column(1).to_pylist(), part.column(0).to_pylist()):
                sets = [shingle_set(t, words) for t in texts]
                hashes = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                keys, spares, points = [], [], []
                for doc, s, h in zip(ids, sets, hashes):
                    new = len(s) > 0 and doc is not None and h not in sent
                    key, spare = blocks(s, num, den) if new else (np.zeros(0, np.uint64), [])
                    keys.append(key)
                    spares.append(spare)
                    points.append(packed(point(s)) if new else None)
                    if new and len(sent) < _SENT:
                        sent.add(h)
                first = [classes_of(len(s), num, den)[0] if x else None for s, x in zip(sets, spares)]
                cols = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(points, pa.binary())]
                cols += [pa.array(first, pa.int32()), pa.array(spares, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, *dealt(keys)], schema=pa.schema(fields))

    ddl = ", ".join(f"keys_{r} array<bigint>" for r in range(passes))
    return docs.mapInArrow(run, f"doc_id bigint, n bigint, set_hash binary, point binary, first_class int, spare array<int>, {ddl}")


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int, part: int = 64) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link, with the sets made from ``texts`` (node, text).

    A node with many partners is dealt into parts, each with the node's own
    text first, so a task streams its partners past one set.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    hubs = n.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"))
    rest = pairs.join(n, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
    rows = hubs.unionByName(rest).join(texts, "node").select("a", "part", "role", "node", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in parts:
            out: list[tuple[int, int]] = []
            for a, at, role, node, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                s = shingle_set(text, words)
                if not role:
                    own = [*own, s] if hub == (a, at) else [s]
                    hub = (a, at)
                elif hub == (a, at) and any(den * (i := len(np.intersect1d(s, o, True))) >= num * (len(s) + len(o) - i) for o in own):
                    out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a bigint, b bigint").distinct()


#: Rows that ask their tiles' trees at once.
_ASK = 512
#: Rows of tiles that are searched together.
_TOGETHER = 16_384


def tile_search(members: DataFrame, num: int, den: int, reach: dict[str, Accumulator] | None = None) -> DataFrame:
    """Pairs (a, b) that may link, of ``members``: key, tile, asks (the row's side), node, component, point.

    Rows of a tile come sorted, the searched side first; its R-tree is built
    once and asked by all rows of the other side.  Tiles of one side ask
    themselves.  Trees are built and asked many at a time, as most are small.
    Pairs in one component are left out.  ``reach`` (nodes, tried, kept)
    counts visited nodes and points, pairs of the tiles, and pairs kept.
    """

    def searched(rows: pa.Table) -> pa.RecordBatch:
        out, counts = _search(rows, num, den)
        for name, n in counts.items():
            if reach:
                reach[name].add(n)
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in parts:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            starts = _tile_starts(rows)
            cut = int(starts[-1]) if len(starts) else 0  # the last tile may go on
            if rows.num_rows >= _TOGETHER and cut:
                yield searched(rows.slice(0, cut))
                rows = rows.slice(cut)
            rest = rows
        if rest is not None and rest.num_rows:
            yield searched(rest)

    return members.repartition("key", "tile").sortWithinPartitions("key", "tile", "asks").mapInArrow(run, "a bigint, b bigint").distinct()


def _tile_starts(rows: pa.Table) -> np.ndarray:
    """Where the tiles begin."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    key = rows.column(0).to_numpy()
    tile = rows.column(1).combine_chunks().dictionary_encode()
    tile = np.concatenate([np.asarray(c.indices) for c in tile.chunks]) if isinstance(tile, pa.ChunkedArray) else np.asarray(tile.indices)
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))


def _search(rows: pa.Table, num: int, den: int) -> tuple[pa.RecordBatch, dict[str, int]]:
    """`tile_search` of whole tiles, with what it counts."""
    starts = _tile_starts(rows)
    tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    asks = rows.column(2).to_numpy().astype(bool)
    node, comp = rows.column(3).to_numpy(), rows.column(4).to_numpy()
    points = [unpacked(x) for x in rows.column(5).to_pylist()]
    counts = np.stack([folded(p, 16) for p in points])
    alone = np.add.reduceat(asks.astype(np.int64), starts)[tile] == 0
    held, asking = np.flatnonzero(~asks), np.flatnonzero(asks | alone)
    left, right, visited = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    if len(held):
        forest = Forest(tile[held], counts[held], num, den)
        for at in range(0, len(asking), _ASK):
            mine = asking[at : at + _ASK]
            i, j = forest.query(tile[mine], counts[mine])
            i, j = mine[i], held[j]
            open_ = (comp[i] != comp[j]) & (~alone[i] | (i < j))
            i, j = _finer(i[open_], j[open_], points, num, den)
            left.append(i)
            right.append(j)
        visited = forest.visited
    own = np.bincount(tile[held], minlength=len(starts))
    other = np.bincount(tile[asks], minlength=len(starts))
    one, two = node[np.concatenate(left)], node[np.concatenate(right)]
    found = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
    tried = int(np.where(other > 0, own * other, own * (own - 1) // 2).sum())
    return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in (0, 1)], names=["a", "b"]), {"nodes": visited, "tried": tried, "kept": len(found)}


def _finer(i: np.ndarray, j: np.ndarray, points: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that their count vectors over all groups of the coarser one don't exclude either."""
    of = np.fromiter(map(len, points), np.int64, len(points))
    sizes = np.fromiter((int(p.sum()) for p in points), np.int64, len(points))
    need, dims = needed(sizes[i], sizes[j], num, den), np.minimum(of[i], of[j])
    ok = np.ones(len(i), bool)
    for d in np.unique(dims[dims > 16]):
        own = np.flatnonzero(dims == d)
        used, back = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
        fine = np.stack([folded(points[k], int(d)) for k in used])
        ok[own] = _minima(fine, fine, back[: len(own)], back[len(own) :]) >= need[own]
    return i[ok], j[ok]


def not_excluded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) of which some count vectors (``points``: node, point) allow a link."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p, q = ([unpacked(x) for x in part.column(i).to_pylist()] for i in (2, 3))
            may = [bound(x, y) >= needed(int(x.sum()), int(y.sum()), num, den) for x, y in zip(p, q)]
            yield part.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    rows = pairs.join(points.toDF("a", "p"), "a").join(points.toDF("b", "q"), "b").select("a", "b", "p", "q")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _tiles(members: DataFrame) -> DataFrame:
    """``members`` (key, node, component, head_component) dealt into tiles: key, tile, asks, node, component.

    The members in the head's component are connected with each other; only
    the others have to ask, those members and each other.
    """
    core = F.col("component") == F.col("head_component")
    n = members.groupBy("key").agg(F.count_if(~core).alias("n_ask"), F.count_if(core).alias("n_core"))
    n = n.where("n_ask > 0").select("key", F.ceil(F.col("n_ask") / TILE).cast("int").alias("cu"), F.ceil(F.col("n_core") / TILE).cast("int").alias("cl"))
    rows = members.join(n, "key").withColumns({"core": core, "h": F.xxhash64("node")})
    u, l = F.pmod(F.col("h"), F.col("cu")).cast("int"), F.pmod(F.col("h"), F.greatest("cl", F.lit(1))).cast("int")
    tile = lambda asks, kind, i, j: F.struct(F.format_string("%s-%d-%d", F.lit(kind), i, j).alias("tile"), F.lit(asks).alias("asks"))
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    asked = F.transform(upto(F.col("cu")), lambda i: tile(0, "core", i, l))
    asking = F.concat(
        F.transform(upto(F.col("cl")), lambda j: tile(1, "core", u, j)),
        F.transform(upto(F.col("cu")), lambda j: F.when(j < u, tile(0, "ask", j, u)).when(j > u, tile(1, "ask", u, j)).otherwise(tile(0, "ask", u, u))),
    )
    rows = rows.withColumn("t", F.explode(F.when(F.col("core"), asked).otherwise(asking)))
    return rows.select("key", "t.tile", "t.asks", "node", "component")


def block_members(sigs: DataFrame, node: DataFrame, scratch: Scratch, passes: int) -> DataFrame:
    """key, node, size, head_node, head_size of each member of a block, its head (the smallest node) apart.

    Most keys occur once.  They are found pass by pass, each over a range of
    keys, so that only a part of all keys is ever shuffled at a time; the
    counts are written before the join, and a pass's shuffle files go before
    the next.  Then each set leaves out its most frequent blocks, as many as it
    can (see `blocks`), so what a common passage or a short group gathers goes.
    """
    posts = None
    for r in range(passes):
        own = sigs.select("doc_id", F.explode(f"keys_{r}").alias("key"))
        shared = own.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        own = scratch.put(own.join(scratch.put(shared, "shared"), "key"), f"posts-{r}")
        posts = own if posts is None else posts.unionByName(own)
    budget = sigs.where("point is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets"), F.first("first_class").alias("first_class"), F.first("spare").alias("spare"))
    size_class = F.col("key").bitwiseAND(F.lit((1 << _CLASS_BITS) - 1)).cast("int")
    rows = posts.join(budget, "doc_id").withColumn("class", size_class)
    often = Window.partitionBy("doc_id", "class").orderBy(F.desc("c"), F.desc("key"))
    spare = F.when(F.col("sets") == 1, F.try_element_at("spare", F.col("class") - F.col("first_class") + 1)).otherwise(0)
    kept = rows.withColumns({"place": F.row_number().over(often), "left_out": F.coalesce(spare, F.lit(0))}).where("place > left_out").select("doc_id", "key")
    kept = kept.join(node.toDF("doc_id", "node", "size"), "doc_id").select("key", "node", "size").distinct()
    kept = scratch.put(kept, "kept")
    scratch.drop("shared", *[f"posts-{r}" for r in range(passes)])
    heads = kept.groupBy("key").agg(F.min("node").alias("head_node"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "head_node")
    heads = heads.join(node.select(F.col("node").alias("head_node"), F.col("n").alias("head_size")).distinct(), "head_node")
    return scratch.put(kept.join(heads, "key").where("node <> head_node"), "blocks")


def jaccard_components(
    docs: DataFrame,
    words: int = 4,
    num: int = 85,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    passes: int = 4,
    reach: dict[str, Accumulator] | None = None,
) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of ``docs``; sets link when den * overlap >= num * union.

    `class_id` is the smallest id with the same set, `component_id` the
    smallest id reachable over links.  Steps, each on slim columns:

    1. Sets, sizes, block keys of all rows, from whole texts (written once,
       dropped when the blocks stand).
    2. Every block's smallest id is its head.  Each member (folded to classes
       of equal sets) is verified against that of its heads with which it
       shares most blocks, if their count vectors allow a link.
    3. Components of the links found.  In a block whose members all fell into
       one component nothing is left to find.
    4. In the others, members outside the head's component search the block's
       R-tree (in tiles where a block is large); what it can't exclude is
       verified, one survivor for each node and component first, then those
       that still lie between components, and the components are completed.
    ``reach`` counts what the trees are asked, see `tile_search`.

    So no link between different components is lost, and members of a group
    of copies are not paired with each other.

    Null text is empty text; rows without words link with nothing and have
    themselves as component.  Rows without an id take their class's component
    (null if none of the class has an id).  Rows that share an id count as
    one document with the links of each.  Very long texts are one set each.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = id_text(docs, id_col, text_col)
    sigs = scratch.put(signatures(rows, words, num, den, passes), "signatures")
    classes = sigs.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    slim = sigs.select("doc_id", "n", "set_hash").join(classes, "set_hash", "left")
    slim = scratch.put(slim.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")), "classes")

    node = slim.where("n > 0 and doc_id is not null").select("doc_id", F.col("class_id").alias("node"), "n").distinct()
    member = block_members(sigs, node, scratch, passes)
    asked = scratch.put(member.select("node").union(member.select("head_node")).distinct(), "asked")
    points = sigs.where("point is not null").select("doc_id", "point").join(node, "doc_id").join(asked, "node", "left_semi")
    points = scratch.put(points.select("node", "point").distinct(), "points")  # several where one id has several texts
    scratch.drop("signatures")

    fits = member.where(f"{num} * greatest(size, head_size) <= {den} * least(size, head_size)")
    shared = fits.groupBy("node", "head_node").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("node").agg(F.max_by("head_node", F.struct("shared", -F.col("head_node"))).alias("head_node"))
    pairs = best.select(F.least("node", "head_node").alias("a"), F.greatest("node", "head_node").alias("b")).distinct()
    pairs = scratch.put(not_excluded(pairs, points, num, den), "pairs")
    texts = rows.join(asked, rows["doc_id"] == asked["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    texts = scratch.put(texts, "candidates")
    links = scratch.put(verified(pairs, texts, words, num, den), "head-links")

    def component_of(links: DataFrame, name: str) -> DataFrame:
        of = asked.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        return scratch.put(of, name)

    of = component_of(links, "first-components")
    head_of = of.select(F.col("node").alias("head_node"), F.col("component").alias("head_component"))
    every = member.select("key", "node", "head_node").unionByName(member.select("key", F.col("head_node").alias("node"), "head_node").distinct())
    every = every.distinct().join(of, "node").join(head_of, "head_node").select("key", "node", "component", "head_component")
    # blocks with the same members are searched once
    mixed = every.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"),
        *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)],
    )
    mixed = mixed.where("lo < hi").groupBy("c", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    every = scratch.put(every.join(mixed, "key"), "mixed")
    tiles = _tiles(every).join(points, "node").select("key", "tile", "asks", "node", "component", "point")
    open_ = scratch.put(tile_search(tiles, num, den, reach), "survivors")
    # of a node's survivors one in each other component is verified first; that leaves few for the rest
    known = open_.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
    first = scratch.put(known.groupBy("a", "cb").agg(F.min("b").alias("b")).select("a", "b"), "first")
    links = scratch.put(links.unionByName(verified(first, texts, words, num, den)), "links")
    of = component_of(links, "second-components")
    rest = open_.join(first, ["a", "b"], "left_anti").join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca <> cb").select("a", "b")
    found = scratch.put(verified(scratch.put(rest, "rest"), texts, words, num, den), "last-links")
    # rows that share an id but not a set tie their classes together
    shared_ids = node.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    ties = node.join(shared_ids, "doc_id").select("a", F.col("node").alias("b"))
    comps = components(links.unionByName(found).unionByName(ties))
    scratch.drop(*[name for name in scratch.paths if name != "classes"])
    out = slim.join(comps, slim["class_id"] == comps["node"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", component)


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns as they are.

    Rows without an id stay if no row with an id is in their component; rows
    that repeat an id and its text stay or go together.  Null and empty texts
    stay.  An empty table stays empty.
    """
    of = jaccard_components(docs, words, num, den, id_col, text_col)
    gone = of.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["gone"], "left_anti")
