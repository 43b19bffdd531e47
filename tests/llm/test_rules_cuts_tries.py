"""Quality rules, fill-in-the-middle cuts and the prefix trie against brute force, SQL, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm import infill, quality, queries, trie

CLASH = "doc_id long, text string, words double, fp long, depth long, conv long, score double, split long"


def edge_docs(spark):
    """Nulls, empty and white texts, control strings, several alphabets, repeats, a long text, clashing columns."""
    long = " ".join(f"wörd{i % 977}" for i in range(60_000))
    texts = [(1, "a  b\tc"), (2, "ü ß\n\n漢字 😀 x"), (2, "ü ß\n\n漢字 😀 x"), (3, None), (4, ""), (None, "a b c"), (5, " \t "), (6, long), (7, "x <P> y"), (8, "<S <M a> b <"), (9, "    a"), (None, None)]
    texts += [(10 + i, " ".join("abcdef"[: 1 + i % 6])) for i in range(200)]
    return spark.createDataFrame([(*t, 1.0, 1, 1, 1, 1.0, 1) for t in texts], CLASH)


# fill in the middle


def brute_cut(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text, text
    if h[3] % 100 < 80:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("chunk", [1, 300, 4_000_000])
def test_cuts_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(infill, "_CHUNK", chunk)
    docs = edge_docs(spark)
    made = infill.fill_in_middle(docs)
    got = made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    want = [brute_cut(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_cuts_of_all_forms_read_back(spark):
    docs = edge_docs(spark)
    for spm in (0, 100):
        made = infill.fill_in_middle(docs, seed=7, percent=100, spm_percent=spm)
        back = made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).select("back").collect()
        assert sorted(r.back for r in back) == sorted(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(size, share):
    bits = np.random.default_rng(size).random(size) < share
    v = infill.BitVector(bits)
    at = np.arange(size + 1)
    assert v.rank(at).tolist() == np.concatenate(([0], np.cumsum(bits))).tolist()
    assert v.total == bits.sum()
    assert v.select(np.arange(v.total)).tolist() == np.flatnonzero(bits).tolist()


# quality


def test_quality_held_out(spark):
    """At sf0.1 the held-out fold is told apart; the learnt rows are only those outside it."""
    sf = "/root/testdata/sf0.1"
    scored = queries.op11_rule_quality(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").select("score", "predicted", "quality").collect()
    low = [r for r in rows if r.quality == 0]
    high = [r for r in rows if r.quality == 1]
    assert len(rows) > 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == 0 for r in low) >= 0.95 * len(low)
    assert sum(r.predicted == 1 for r in high) >= 0.99 * len(high)


def test_quality_columns_equal_matrix(spark):
    """The compiled columns give what the rules give on the collected statistics; every row has a score."""
    docs = edge_docs(spark)
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.NAMES)))
    y = ((x[:, 0] > 0.4) & (x[:, 2] <= 0.7)).astype(float)
    model = quality.fit(x, y, np.ones(400))
    assert model.rules and ((model.score(x) >= 0.5) == y).mean() > 0.97 and len(quality.described(model)) == len(model.rules)
    assert len(model.rules) < len(quality.tree_rules(x, y, np.ones(400)))  # the lasso leaves some out
    stats = quality.statistics(docs.select("doc_id", "text")).collect()
    want = sorted(zip([-1 if r.doc_id is None else r.doc_id for r in stats], model.score(np.array([r[2:] for r in stats])).round(9)))
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "score"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 9)) for r in got.collect()) == want
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_statistics(spark):
    rows = spark.createDataFrame([(1, " The cat cat sat.\n\nA | B!! 42 \n"), (2, None), (3, " \n ")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.statistics(rows).collect()}
    r = got[1]
    words = "The cat cat sat. A | B!! 42".split()
    assert round(np.expm1(r.words)) == 8 and r.distinct_words == 7 / 8 and r.repeated_words == 1 / 8
    assert r.short_words == sum(len(w) <= 3 for w in words) / 8 and r.words_a_line == 8 / 3 and r.distinct_lines == 1
    assert (r.capitals, r.signs, r.bars, r.exclamations, r.stops, r.commas) == (3 / 8, 4 / 8, 1 / 8, 2 / 8, 1 / 8, 0)
    assert got[2].words == got[3].words == 0


def test_quality_without_classes(spark):
    """One class, no rows, null labels, repeated ids: a score is the base rate then, and a repeated id counts once."""
    assert quality.fit(np.zeros((5, len(quality.NAMES))), np.ones(5), np.ones(5)).score(np.zeros((1, len(quality.NAMES))))[0] > 0.9
    assert quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0), np.zeros(0)).score(np.zeros((1, len(quality.NAMES))))[0] == 0.5
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    x, y, w = quality.training_sample(docs, labels)
    assert y.tolist() == [0, 1] and len(x) == 2 and len(w) == 2
    assert quality.training_sample(docs.limit(0), labels)[0].shape == (0, len(quality.NAMES))


# trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if paths[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth string, fp string, split int"


def conversations(seed, n=70, long=0):
    """Few distinct turns, so that paths share beginnings; null and tied turns, repeats, a long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(rng.randrange(1, 9)):
            turn = rng.choice([i, i, i, i // 2, None])
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, " d  e f "])))
    for i in range(long):
        rows += [(c, i // 2, "user", f"t{(i * 7) % 5} x") for c in (40, 41)]
    return rows + [(None, 1, "user", "x")] + rows[:5]


def run_trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "q", "r", 3) for r in rows], TURNS)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **how).collect()), key=repr)


@pytest.mark.parametrize("moduli", [trie.MODULI, (3, 2), (1, 1)])
def test_trie_equals_brute_force_when_prints_collide(spark, moduli):
    """With weak moduli most candidate groups are mixed and have to be split."""
    rows = conversations(1)
    assert run_trie(spark, rows, moduli=moduli) == brute_trie(rows)


def test_trie_of_a_hot_conversation(spark, monkeypatch):
    """A conversation of most turns is dealt out in pieces and summed in runs."""
    monkeypatch.setattr(trie, "PIECES", 8)
    monkeypatch.setattr(trie, "RUN", 64)
    monkeypatch.setattr(trie, "IDS", 4)
    rows = conversations(2, long=600)
    df = spark.createDataFrame([(*r, "q", "r", 3) for r in rows], TURNS)
    turns = df.where("conv_id is not null").select(F.col("conv_id").alias("conv"), "turn")
    cuts = {r.conv: r.ends for r in trie._cut_points(turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), 200).collect()}
    assert sorted(cuts) == [40, 41] and all(len(e) == 7 for e in cuts.values())
    assert run_trie(spark, rows, hot=200) == brute_trie(rows)


def test_trie_edges(spark):
    assert run_trie(spark, []) == [] and run_trie(spark, [(None, 1, "user", "x")]) == []
    alone = [(20 * i + 3, 0, "user", "x") for i in range(12)]  # some lose all their turns: members of the root only
    assert run_trie(spark, alone) == brute_trie(alone)
    same = [(c, t, "user", "one two") for c in range(100, 160) for t in range(5)]
    assert run_trie(spark, same) == brute_trie(same)
    huge = [(7, 0, "user", "w " * 200_000), (8, 0, "user", "w " * 200_000)]
    assert run_trie(spark, huge) == brute_trie(huge)


def test_scan_by_small_batches():
    """The scan's state goes on from batch to batch."""
    rng = np.random.default_rng(4)
    conv, piece = np.sort(rng.integers(0, 6, 200)), np.zeros(200, np.int64)
    own, skip = rng.random(200) < 0.8, conv % 3
    terms = [rng.integers(0, m, 200) for m in trie.MODULI]
    whole = trie.PrefixScan().of(conv, piece, own, skip, terms)
    scan, parts = trie.PrefixScan(), []
    for lo in range(0, 200, 7):
        at = slice(lo, lo + 7)
        parts.append(scan.of(conv[at], piece[at], own[at], skip[at], [t[at] for t in terms]))
    for i in (0, 1):
        assert np.concatenate([p[i] for p in parts]).tolist() == whole[i].tolist()
    for i in (2, 3):
        for m in (0, 1):
            assert np.concatenate([p[i][m] for p in parts]).tolist() == whole[i][m].tolist()
