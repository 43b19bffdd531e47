"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

The test items are a stated query set: they are dealt into blocks of a bounded
number of words, and each block is held against all documents.  Only a block's
words and seeds are sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of items in one block.
BLOCK_WORDS = 500_000
_MATCH, _OTHER, _GAP = 2, -1, -1
_MIX = np.int64(0x9E3779B97F4A7C1)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall((text or "").lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The best Smith-Waterman score of two word sequences, and where it ends in both (after the last word).

    A match counts 2, another word or a gap -1.
    """
    down = _GAP * np.arange(len(b) + 1)
    prev, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, x in enumerate(a):
        now = np.maximum(prev + _GAP, 0)
        now[1:] = np.maximum(now[1:], prev[:-1] + np.where(b == x, _MATCH, _OTHER))
        prev = np.maximum.accumulate(now - down) + down  # gaps along b
        if (top := int(prev.max())) > best[0]:
            best = (top, i + 1, int(prev.argmax()))
    return best


def grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the n-grams whose words are all known (ids from 0)."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids >= 0
    whole = known[: len(ids) - n + 1].copy()
    for i in range(1, n):
        whole &= known[i : len(ids) - n + 1 + i]
    at = np.flatnonzero(whole)
    key = np.zeros(len(at), np.int64)
    with np.errstate(over="ignore"):
        for i in range(n):
            key = (key + ids[at + i] + 1) * _MIX
            key ^= key >> 29
    return at, key


@dataclass
class Block:
    """Items by number, the ids of their words, and their seeds, which are all their n-grams: sorted keys with the items and places of each.

    An item shorter than n is a seed as it stands.
    """

    items: dict[int, np.ndarray]
    vocabulary: dict[str, int]
    n: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    places: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> "Block":
        vocabulary: dict[str, int] = {}
        items: dict[int, np.ndarray] = {}
        for item, text in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64)
            if len(ids):
                items[item] = ids
        at: dict[int, list[tuple[int, int]]] = {}
        for item, ids in items.items():
            for place, key in zip(*grams(ids, min(n, len(ids)))):
                at.setdefault(int(key), []).append((item, int(place)))
        keys = np.array(sorted(at), np.int64)
        return cls(items, vocabulary, n, keys, [at[int(k)] for k in keys])

    def lengths(self) -> list[int]:
        """The lengths of n-gram that occur as seeds."""
        return sorted({min(self.n, len(ids)) for ids in self.items.values()})

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in the text, seed number)."""
        for n in self.lengths():
            at, key = grams(ids, n)
            if len(at) and len(self.keys):
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                for j in np.flatnonzero(self.keys[k] == key):
                    yield int(at[j]), int(k[j])


def passages(block: Block, words: list[str], threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of each item that the text holds; of several places the best.

    Around a seed three item lengths are aligned, as an alignment that scores
    enough has at most an item's length of gaps.  Windows with too few of the
    item's words to reach the threshold are left out before they are aligned,
    each word counted as often as both have it; so common seeds cost little.
    """
    ids = block.ids(words)
    seeds: dict[int, set[tuple[int, int]]] = {}
    for at, seed in block.hits(ids):
        for item, place in block.places[seed]:
            n = len(block.items[item])
            seeds.setdefault(item, set()).add((max(0, at - place - n), min(len(ids), at - place + 2 * n)))
    spans: dict[int, list[tuple[int, int]]] = {}
    for item, windows in seeds.items():
        inside, often = np.unique(block.items[item], return_counts=True)
        where = np.flatnonzero(np.isin(ids, inside))
        which = np.searchsorted(inside, ids[where])
        need = threshold * len(block.items[item])
        for lo, hi in sorted(windows):
            first, end = np.searchsorted(where, (lo, hi))
            if end - first < need or np.minimum(np.bincount(which[first:end], minlength=len(inside)), often).sum() < need:
                continue
            own = spans.setdefault(item, [])
            if own and lo <= own[-1][1]:
                own[-1] = (own[-1][0], max(hi, own[-1][1]))
            else:
                own.append((lo, hi))
    out = []
    for item, windows in spans.items():
        b, best = block.items[item], (0, 0, 0, 0)
        need = threshold * _MATCH * len(b)
        for lo, hi in windows:
            got, i, j = align(ids[lo:hi], b)
            if got >= need and got > best[0]:
                _, back, _ = align(ids[lo : lo + i][::-1], b[:j][::-1])
                best = (got, lo + i - back, lo + i, item)
        if best[0]:
            out.append((item, best[0] / (_MATCH * len(b)), best[1], best[2]))
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_WORDS words (a longer item alone), one block at a time on the driver."""
    rows = items.select(items[item_col].cast("bigint").alias("item"), F.coalesce(items[text_col], F.lit("")).alias("text")).where("item is not null")
    texts = rows.distinct().withColumn("w", F.size(F.split("text", r"\s+")))
    cells = max(1, -(-(texts.agg(F.sum("w").cast("bigint")).first()[0] or 0) // (BLOCK_WORDS // 2)))
    for cell in range(cells):
        own = texts if cells == 1 else texts.where(F.pmod(F.xxhash64("item"), F.lit(cells)) == cell)
        if got := [(r.item, r.text) for r in own.orderBy("item", "text").toLocalIterator()]:
            yield got


def _numbered(rows: list[tuple[int, str]]) -> tuple[list[int], list[tuple[int, str]]]:
    """The items' ids, and the rows by number: several texts under one id are items of their own."""
    return [i for i, _ in rows], [(k, text) for k, (_, text) in enumerate(rows)]


def _prepared(items: DataFrame, n: int, item_col: str) -> Iterator[tuple[list[int], Block]]:
    for rows in _blocks(items, item_col, "text"):
        names, rows = _numbered(rows)
        if (block := Block.of(rows, n)).items:
            yield names, block


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, start, end, passage: each item that a document holds, with its place.

    Score: the Smith-Waterman score of item and passage by words (match 2,
    other word or gap -1) over that of an unchanged copy; at least
    ``threshold``.  An item copied with a third of its words changed scores
    0.5.  `start` and `end` are characters of the text, `passage` what stands
    there.  Only places with a seed are aligned, and all n-grams of an item
    are seeds: only a copy with no n words in a row of the item left is not
    found.

    Documents are read once and never shuffled.

    Null, empty and wordless texts hold nothing, and such items (or items
    without an id) are in nothing.  Items shorter than ``n`` words are found
    by their whole sequence.  Of an item's repeated passages in a document the
    best is returned, the first of equal ones; repeated rows are returned
    each; a null id stays null.  Empty tables give an empty result, and other
    columns are ignored.
    """
    out = None
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    for names, block in _prepared(items, n, item_col):
        got = rows.mapInArrow(_search(names, block, threshold), _FOUND)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], _FOUND)


_FOUND = "doc_id bigint, item_id bigint, score double, start bigint, end bigint, passage string"


def _search(names: list[int], block: Block, threshold: float):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[] for _ in kinds]
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                best: dict[int, tuple] = {}
                if found := passages(block, words_of(text), threshold):
                    places = [m.span() for m in WORD.finditer(text.lower())]
                    for item, score, first, end in found:
                        if score > best.get(names[item], (0,))[0]:
                            best[names[item]] = (score, places[first][0], places[end - 1][1])
                for item, (score, lo, hi) in sorted(best.items()):
                    for col, v in zip(out, (doc, item, score, lo, hi, text.lower()[lo:hi] if len(text.lower()) != len(text) else text[lo:hi])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "item_id", "score", "start", "end", "passage"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are, filtered where they are read."""
    at, schema = docs.columns.index(text_col), docs.schema
    for _, block in _prepared(items, n, item_col):

        def run(parts: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield part.filter(pa.array([not passages(block, words_of(t), threshold) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
