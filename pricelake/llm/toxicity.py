"""Toxicity by compression distance: two zstandard dictionaries, window compression lengths, calibrated thresholds."""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, held, id_text

#: A line that ends both dictionaries and begins every window, and the mark that ends every window: fixed block costs
#: cancel, and the compressor still looks for matches at the window's end.
CARRIER = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$&"
TAIL = CARRIER[:16]
GRAM = 5
#: Words of the longest window.
RUN = 3
#: Parts of the labelled texts for the calibration.
FOLDS = 4
#: Toxic texts that a run of words stands in, at least.
_LEAST = 4
_EDGE = string.punctuation.encode()
_CACHE_CHARS = 2_000_000
#: Chance under which a whole word or run marks toxic texts.
_CHANCE = 1e-5


def _parameters(size: int) -> zstd.ZstdCompressionParameters:
    """For dictionaries of at most ``size`` bytes."""
    log = max(13, (size + 1024).bit_length())
    return zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=log, hash_log=log - 1, chain_log=log - 1, search_log=4, min_match=4, target_length=64, strategy=zstd.STRATEGY_LAZY2)


def _compressor(dictionary: bytes, size: int) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(dictionary + CARRIER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_parameters(size))
    return zstd.ZstdCompressor(dict_data=d, compression_params=_parameters(size))


def windows(text: str) -> list[bytes]:
    """A text's words in lower case, without punctuation at their ends."""
    return [w for x in text.lower().encode().split() if (w := x.strip(_EDGE))]


def runs(words: list[bytes]) -> set[bytes]:
    """The windows of 2 to RUN words."""
    return {b" ".join(words[i : i + n]) for n in range(2, RUN + 1) for i in range(len(words) - n + 1)}


def _grams(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)}


def _tail(k: int, mean: float) -> float:
    """Probability of ``k`` or more events where ``mean`` are expected."""
    term = below = math.exp(-mean)
    for i in range(1, k):
        term *= mean / i
        below += term
    return max(0.0, 1 - below)


@dataclass
class Tally:
    """Documents by class, and in how many of each class a gram, a word and a run of words occur."""

    documents: list[int]
    grams: list[Counter]
    words: list[Counter]
    runs: list[Counter]

    @classmethod
    def of(cls, labelled: Iterable[tuple[str, int]], asked: set[bytes]) -> "Tally":
        """Of runs only those ``asked`` for are counted."""
        t = cls([0, 0], [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()])
        known: dict[bytes, set[bytes]] = {}
        for text, label in labelled:
            listed, grams = windows(text), set()
            words = set(listed)
            for w in words:
                if w not in known:
                    known[w] = _grams(w)
                grams |= known[w]
            t.documents[label] += 1
            t.grams[label].update(grams)
            t.words[label].update(words)
            t.runs[label].update(runs(listed) & asked)
        return t

    def __add__(self, other: "Tally") -> "Tally":
        return Tally(*([a + b for a, b in zip(getattr(self, f), getattr(other, f))] for f in ("documents", "grams", "words", "runs")))

    def marking(self, counts: list[Counter], chance: float) -> set[bytes]:
        """Those in at least two toxic texts, eight times as frequent there as in ordinary texts, with less than this ``chance``."""
        n, (ordinary, toxic) = self.documents, counts
        return {
            g for g, c in toxic.items()
            if c >= 2 and (c + 0.5) / (n[1] + 1) >= 8 * (ordinary[g] + 0.5) / (n[0] + 1) and _tail(c, n[1] * (ordinary[g] + 1) / (n[0] + 2)) < chance
        }


def _fill(stretches: Iterable[bytes], size: int | None = None) -> bytes:
    """The first stretches that fit (None: all), the first of all at the end, where references to it are shortest."""
    out: list[bytes] = []
    for s in stretches:
        if size is not None and sum(map(len, out)) + len(s) > size:
            break
        if not any(s in o for o in out):
            out.append(s)
    return b"".join(reversed(out))


@dataclass(frozen=True)
class Dictionaries:
    """Content of both dictionaries, and the windows that the toxic one has as wholes."""

    ordinary: bytes
    toxic: bytes
    wholes: tuple[bytes, ...]


def train_dictionaries(t: Tally, size: int = 2048) -> Dictionaries:
    """The ordinary dictionary has the words that save most in ordinary text.

    The toxic one has them too, as toxic texts consist of them as well, and
    all that toxic texts have beyond chance: stretches of 5-grams, whole words
    that share their letters with ordinary words, and runs of words of which
    none marks by itself.  The letters that such words share are in the
    ordinary dictionary too, so that ordinary words gain nothing by them.
    """
    sure = t.marking(t.grams, 1e-6)
    marking = t.marking(t.words, _CHANCE)
    known = {w: w in marking or not sure.isdisjoint(_grams(w)) for r in t.runs[1] for w in r.split(b" ")}
    phrases = {r for r in t.marking(t.runs, _CHANCE) if not any(known[w] for w in r.split(b" "))}
    wholes: Counter = Counter({w: t.words[1][w] for w in marking}) + Counter({r: t.runs[1][r] for r in phrases})
    stretches: Counter = Counter()
    for w, c in t.words[1].items():
        padded, i = b" " + w + b" ", 0
        while i <= len(padded) - GRAM:
            j = i
            while padded[j : j + GRAM] in sure:
                j += 1
            if j > i:
                stretches[padded[i : j + GRAM - 1]] += c
            i = max(j, i + 1)
    savings = sorted(t.words[0].items(), key=lambda p: (-p[1] * min(len(p[0]), 12), p[0]))[: size * 4]
    shared = {g for w in marking for g in _grams(w)} - sure
    carriers: dict[bytes, tuple[int, bytes]] = {}
    for w, c in t.words[0].items():
        if w not in marking:
            for g in _grams(w) & shared:
                carriers[g] = max(carriers.get(g, (0, b"")), (c, w))
    beside = _fill(b" " + w + b" " for _, w in sorted(set(carriers.values()), key=lambda p: (-p[0], p[1])))
    ordinary = beside + _fill((w + b" " for w, _ in savings if not _grams(w) & sure), size)
    parts = Counter({b" " + w + b" ": c for w, c in wholes.items()}) + stretches
    toxic = _fill(s for s, _ in sorted(parts.items(), key=lambda p: (-p[1], p[0])))
    return Dictionaries(ordinary, ordinary + toxic, tuple(sorted(wholes)))


class Distances:
    """How many bytes a window takes less with the toxic dictionary than with the ordinary one; words met before are kept."""

    def __init__(self, of: Dictionaries) -> None:
        self.ordinary, self.toxic = (_compressor(d, len(of.toxic)) for d in (of.ordinary, of.toxic))
        self.wholes = frozenset(of.wholes)
        self.runs = {w for w in of.wholes if b" " in w}
        self.heads = {w.split(b" ")[0] for w in self.runs}
        self.known: dict[bytes, int] = {}
        self.held = 0

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Each window's gain, and whether the toxic dictionary has it as a whole.

        Windows are the words, and the runs of words that the toxic dictionary
        has: another run gains what its words gain.
        """
        words = windows(text)
        if self.heads:
            at = [i for i, w in enumerate(words) if w in self.heads]
            words += [r for i in at for n in range(2, RUN + 1) if i + n <= len(words) and (r := b" ".join(words[i : i + n])) in self.runs]
        for w in set(words).difference(self.known):
            window = CARRIER + b" " + w + b" " + TAIL
            gain = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
            self.known[w] = 2 * gain + (w in self.wholes)
            self.held += len(w)
        got = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.held > _CACHE_CHARS:
            self.known, self.held = {}, 0
        return got >> 1, got & 1


def distances(of: Dictionaries) -> Distances:
    """This process's `Distances` of the last dictionaries asked for."""
    return held(of, lambda: Distances(of))


def features(gains: np.ndarray, wholes: np.ndarray) -> list[float]:
    """1, the largest gain, the mean of the three largest, and the logarithms of how many windows gain 3 bytes or more and are stand in the toxic dictionary as wholes."""
    top = np.sort(np.append(gains, [0, 0, 0]))[::-1]
    return [1.0, float(top[0]), float(top[:3].mean()), math.log1p(int((gains >= 3).sum())), math.log1p(int(wholes.sum()))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method, with a penalty on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    dictionaries: Dictionaries
    weights: tuple[float, ...]


def without_copies(labelled: list[tuple[str, int]], size: int = 16) -> list[tuple[str, int]]:
    """The texts that share under half of their ``size`` smallest hashes of five words in a row with an earlier one.

    Single words would not do: texts of one language share their common ones.
    Copies repeat their own rare words, which would then seem to mark their class.
    """
    seen: dict[int, list[int]] = {}
    out = []
    for k, (text, label) in enumerate(labelled):
        words = windows(text)
        n = min(5, len(words))
        sketch = sorted({zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)} if n else ())[:size]
        shared = Counter(i for h in sketch for i in seen.get(h, ()))
        if not shared or 2 * max(shared.values()) < len(sketch):
            out.append((text, label))
            for h in sketch:
                seen.setdefault(h, []).append(k)
    return out


def fit(labelled: list[tuple[str, int]]) -> ToxicityModel:
    """Dictionaries from all of ``labelled`` but near copies; the calibration from FOLDS parts, each scored by the others' dictionaries.

    Without any toxic or without any ordinary text the score is the base rate.
    """
    labelled = without_copies(labelled)
    often = Counter(r for text, label in labelled if label for r in runs(windows(text)))
    asked = {r for r, c in often.items() if c >= _LEAST}
    folds = [labelled[i::FOLDS] for i in range(FOLDS)]
    tallies = [Tally.of(f, asked) for f in folds]
    x, y = [features(np.zeros(0, np.int64), np.zeros(0, np.int64))], [0.0]
    for i, fold in enumerate(folds):
        d = Distances(train_dictionaries(reduce(Tally.__add__, tallies[:i] + tallies[i + 1 :])))
        x += [features(*d.of(text)) for text, _ in fold]
        y += [float(label) for _, label in fold]
    return ToxicityModel(train_dictionaries(reduce(Tally.__add__, tallies)), tuple(float(v) for v in _logistic(np.array(x), np.array(y))))


def training_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = 700, ordinary_rows: int = 1300) -> list[tuple[str, int]]:
    """At most so many labelled rows of each class, whole texts, chosen by a hash of the id.

    This bounded sample is all that reaches the driver.  Null labels are left
    out; ids with several labels count with the highest.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(17))
    picked = [marks.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = id_text(docs).join(chosen, "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, from its whole text alone.

    Scores are from 0 to 1.  Null and empty texts, and texts without words,
    get the score of a text without any gain.  Rows are scored where they are
    read; nothing is shuffled.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, w = distances(model.dictionaries), np.array(model.weights)
        for part in parts:
            for ids, texts in batches(part.column(1).to_pylist(), part.column(0).to_pylist()):
                z = np.array([features(*d.of(t)) for t in texts]) @ w
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are, filtered where they are read."""
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, w = distances(model.dictionaries), np.array(model.weights)
        for part in parts:
            z = np.array([features(*d.of(t or "")) for t in part.column(at).to_pylist()]).reshape(-1, len(w)) @ w
            yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
