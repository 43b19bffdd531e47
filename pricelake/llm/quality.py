"""Quality classifier: a sparse ensemble of rules from tree paths, weighted by a lasso, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_text

#: Rounds, depth and learning rate of the trees whose paths become rules, and thresholds tried a statistic.
TREES, DEPTH, RATE, CUTS = 40, 3, 0.3, 32
#: Labelled rows of each class that are fitted on, at most.
SAMPLE = 3_000
_PENALTIES = (0.03, 0.01, 0.003, 0.001)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (without columns of these names) with one double a statistic of the whole text, as `NAMES` lists them.

    The text is split once, and reduced once to its capitals and once to its
    signs; what is counted comes from these.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    held = docs.select(
        *docs.columns, text.alias("_text"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)).alias("_words"),
        F.split(bare, "\n").alias("_lines"),
        F.regexp_replace(text, r"[\p{L}\p{N}\x20\x09-\x0D]+", "").alias("_signs"),
    )
    words, n_words, signs = F.col("_words"), F.size("_words"), F.col("_signs")
    per_word, per_line = F.greatest(n_words, F.lit(1)), F.size("_lines")

    def count(mark: str) -> Column:
        return F.length(signs) - F.length(F.replace(signs, F.lit(mark), F.lit("")))

    values = {
        "words": F.log1p(n_words.cast("double")),
        "word_length": (F.length("_text") - n_words) / per_word,
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "repeated_words": F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))) / per_word,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / per_word,
        "words_a_line": n_words / per_line,
        "distinct_lines": F.size(F.array_distinct("_lines")) / per_line,
        "capitals": F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")) / per_word,
        "signs": F.length(signs) / per_word,
        "bars": count("|") / per_word,
        "exclamations": count("!") / per_word,
        "stops": count(".") / per_word,
        "commas": count(",") / per_word,
    }
    assert tuple(values) == NAMES
    return held.select(*docs.columns, *[v.cast("double").alias(k) for k, v in values.items()])


NAMES = ("words", "word_length", "distinct_words", "repeated_words", "short_words", "words_a_line", "distinct_lines", "capitals", "signs", "bars", "exclamations", "stops", "commas")


@dataclass(frozen=True)
class Condition:
    """A statistic is at most (or above) a bound."""

    name: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.name) > self.bound if self.above else F.col(self.name) <= self.bound

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = x[:, NAMES.index(self.name)]
        return at > self.bound if self.above else at <= self.bound


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class QualityModel:
    """Rules with their weights, and the constant of the logistic sum."""

    constant: float
    rules: tuple[tuple[float, Rule], ...] = ()

    def column(self) -> Column:
        """The score over the columns of `statistics`."""
        total = F.lit(self.constant)
        for weight, rule in self.rules:
            met = rule[0].column()
            for c in rule[1:]:
                met = met & c.column()
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same from a matrix of statistics."""
        total = np.full(len(x), self.constant)
        for weight, rule in self.rules:
            total += weight * np.logical_and.reduce([c.holds(x) for c in rule])
        return 1 / (1 + np.exp(-total))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, depth: int, rules: list[Rule], out: np.ndarray, at: np.ndarray) -> None:
    """One regression tree on gradients; every path below the root joins ``rules``, leaves write their step to ``out``."""
    best = (1e-6, None)
    here = at
    gs, hs = g[here].sum(), h[here].sum()
    if depth:
        for j, name in enumerate(NAMES):
            v = x[here, j]
            for bound in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1])):
                low = v <= bound
                k = int(low.sum())
                if min(k, len(v) - k) < 10:
                    continue
                gl, hl = g[here][low].sum(), h[here][low].sum()
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                if gain > best[0]:
                    best = (gain, (name, j, float(bound)))
    if best[1] is None:
        out[here] += RATE * gs / (hs + 1)
        return
    name, j, bound = best[1]
    low = x[here, j] <= bound
    for above, part in ((False, here[low]), (True, here[~low])):
        longer = (*path, Condition(name, above, bound))
        rules.append(longer)
        _grow(x, g, h, longer, depth - 1, rules, out, part)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, each tree grown on another two thirds of the rows; rules that hold for equal rows count once."""
    rng, rules, margin = np.random.default_rng(11), [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, weight * (y - p), weight * p * (1 - p), (), DEPTH, rules, step, np.flatnonzero(rng.random(len(y)) < 2 / 3))
        margin += step
    seen: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=len):
        seen.setdefault(np.logical_and.reduce([c.holds(x) for c in rule]).tobytes(), rule)
    return list(seen.values())


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """Constant and weights of a logistic model with an absolute penalty, by accelerated proximal gradients."""
    z1 = np.column_stack([np.ones(len(z)), z])
    weight = weight / weight.sum()
    rate = 4 / max(np.linalg.eigvalsh((z1 * weight[:, None]).T @ z1)[-1], 1e-12)
    shrink = np.full(z1.shape[1], penalty * rate)
    shrink[0] = 0
    w, ahead, t = np.zeros(z1.shape[1]), np.zeros(z1.shape[1]), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ ahead, -30, 30)))
        moved = ahead - rate * (z1.T @ (weight * (p - y)))
        new = np.sign(moved) * np.maximum(abs(moved) - shrink, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Rules from trees, the penalty that loses least on every fourth row, then the weights from all rows.

    Without both classes the score is the base rate (a half without rows).
    """
    if len(set(y.tolist())) < 2:
        return QualityModel(float(np.log(((y * weight).sum() + 0.5) / (((1 - y) * weight).sum() + 0.5))))
    fourth = np.arange(len(y)) % 4 == 3
    if len(set(y[fourth].tolist())) < 2 or len(set(y[~fourth].tolist())) < 2:
        fourth[:] = False
    rules = tree_rules(x[~fourth], y[~fourth], weight[~fourth])

    def met(rules: list[Rule], x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules]).astype(float) if rules else np.zeros((len(x), 0))

    def loss(penalty: float) -> float:
        b, w = lasso(z[~fourth], y[~fourth], weight[~fourth], penalty)
        m = b + z[fourth] @ w
        return float((weight[fourth] * (np.logaddexp(0, m) - y[fourth] * m)).sum())

    z = met(rules, x)
    penalty = min(_PENALTIES, key=loss) if fourth.any() else _PENALTIES[1]
    b, w = lasso(z, y, weight, penalty)
    return QualityModel(b, tuple((float(v), r) for v, r in zip(w, rules) if v))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and weights of at most ``rows`` labelled documents of each class, chosen by a hash of the id.

    Only the statistics of these reach the driver, one row an id.  Weights give
    each class the share that it has among all labels, so that the score stays
    a probability.  Null labels and ids are left out; ids with several labels
    count with the lowest; of several texts of an id one counts.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).where(F.col("quality").isin(0, 1)).collect()}
    picked = [marks.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    found = statistics(id_text(docs).join(chosen, "doc_id")).groupBy("doc_id", "quality").agg(F.min(F.struct(*NAMES)).alias("s")).collect()
    found = sorted(found, key=lambda r: r.doc_id)
    y = np.array([r.quality for r in found], float)
    x = np.array([list(r.s) for r in found], float).reshape(len(found), len(NAMES))
    weight = np.array([share[int(v)] / max(1, int((y == v).sum())) for v in y], float)
    return x, y, weight / weight.mean() if len(weight) else weight


def described(model: QualityModel) -> list[str]:
    """The rules in words, the heaviest first."""
    heaviest = sorted(model.rules, key=lambda r: -abs(r[0]))
    return [f"{w:+.3f} if " + " and ".join(f"{c.name} {'>' if c.above else '<='} {c.bound:.4g}" for c in rule) for w, rule in heaviest]


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, from its whole text alone.

    All of it is built-in functions; rows are scored where they are read and
    nothing is shuffled.  Scores are from 0 to 1.  Null and empty texts, and
    texts of white space, have statistics of 0 and score by them.  Rows that
    repeat score alike; an empty table gives no rows; other columns are left
    out.
    """
    return statistics(id_text(docs, id_col, text_col)).select("doc_id", model.column().alias("score"))
