"""The training-data operators against brute force, SQL, round trips and held-out labels."""

import hashlib
import io
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pricelake.llm import chat, decontamination, dedup, jaccard, lengths, licences, packing, queries, records, sharding, tokens, toxicity
from pricelake.llm.tokens import encoder, public_path

SCHEMA = "doc_id long, text string, hash string, node long, key string"


def edge_docs(spark):
    """Nulls, empty and white texts, ties, repeated rows, a long text, and columns with names that operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a  b\tc"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (None, "a b c"), (5, "   "), (6, long), (7, long + " x"), (None, None)]
    return spark.createDataFrame([(*r, "h", 1, "k") for r in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf_dir, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def test_exact_dedup_edges(spark):
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in dedup.exact_groups(edge_docs(spark)).collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert got[(1, h("a b c"))] == (1, 4, True) and got[(2, h("a b c"))] == (1, 4, False) and got[(None, h("a b c"))] == (1, 4, False)
    assert got[(3, h(""))] == (3, 3, True) and got[(5, h(" "))] == (5, 1, True)
    from pyspark.sql import functions as F

    same_hash = dedup.exact_groups(edge_docs(spark), content_hash=lambda c: F.lit("x")).where("kept").select("doc_id").distinct().count()
    assert same_hash == 5  # collisions do not join texts
    assert dedup.exact_groups(empty_docs(spark)).count() == 0
    assert dedup.drop_exact_copies(edge_docs(spark)).columns == edge_docs(spark).columns


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_components(docs, k, num, den):
    sets = {d: shingles(t, k) for d, t in docs}
    comp = {d: d for d in sets}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * (i := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(spark, sf_dir):
    """Small documents, with edits near the threshold."""
    rng = np.random.default_rng(5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(60).collect()]
    for d, t in docs[:30]:
        for e in range(4):
            ws = t.split()
            for i in rng.integers(0, len(ws), rng.integers(0, 2 + len(ws) // 30)):
                ws[i] = f"z{rng.integers(1000)}"
            docs.append((10_000 + 10 * d + e, " ".join(ws)))
    docs += [(20_000 + i, " ".join(f"v{j}" for j in range(i))) for i in range(12)]
    return docs


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, sf_dir, k, num):
    docs = near_copies(spark, sf_dir)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k, num, 100).collect()}
    assert got == brute_components(docs, k, num, 100)


def test_jaccard_tiles_equal_brute_force(spark, sf_dir, monkeypatch):
    """Blocks much larger than a tile, passes that don't divide the keys evenly, null and repeated ids."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for d in range(70):
        ws = list(base)
        for i in rng.integers(0, len(ws), rng.integers(1, 6)):
            ws[i] = f"z{rng.integers(1000)}"
        docs.append((d, " ".join(ws)))
    df = spark.createDataFrame(docs + [(None, docs[3][1]), docs[5], (None, "")], "doc_id long, text string")
    reach = {name: spark.sparkContext.accumulator(0) for name in ("nodes", "tried", "kept")}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, passes=3, reach=reach).collect() if r.doc_id is not None}
    assert got == brute_components(docs, 4, 85, 100)
    assert reach["nodes"].value > 0 and 0 < reach["kept"].value < reach["tried"].value  # the trees are asked, and leave pairs out


@pytest.mark.parametrize("seed", range(4))
def test_forest_equals_all_pairs(seed):
    """Every pair that the bound allows at 16 groups is found, in its own tile alone, and no other."""
    rng = np.random.default_rng(seed)
    tile = np.sort(rng.integers(0, 9, 400))
    counts = rng.poisson(rng.choice([1, 4, 9], 400)[:, None], (400, 16)).astype(np.int64)
    counts[200:] = np.maximum(0, counts[:200] + rng.integers(-1, 2, (200, 16)))
    asks = rng.choice(400, 150, replace=False)
    forest = jaccard.Forest(tile, counts, 85, 100)
    i, j = forest.query(tile[asks], counts[asks])
    size = counts.sum(1)
    want = {
        (a, b) for a, x in enumerate(asks) for b in range(400)
        if tile[x] == tile[b] and (need := int(jaccard.needed(size[x], size[b], 85, 100))) <= size[x] and np.minimum(counts[x], counts[b]).sum() >= need
    }
    assert set(zip(i.tolist(), j.tolist())) == want
    assert forest.visited < len(asks) * 400


def test_jaccard_edges(spark):
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(edge_docs(spark)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == 4 and got[5] == 5 and got[6] == got[7] == 6
    assert jaccard.jaccard_components(empty_docs(spark)).count() == 0
    assert jaccard.drop_near_copies(edge_docs(spark)).where("doc_id = 7").count() == 0


def test_jaccard_one_id_with_two_texts(spark):
    """Each of an id's texts keeps its links, whichever of the two points is the smaller."""
    one, two = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 150)))
    rows = []
    for k, (x, y) in enumerate(((one, two), (two, one))):
        x, y = x.replace(" ", f"q{k} "), y.replace(" ", f"q{k} ")
        rows += [(10 * k + 1, x), (10 * k + 2, x), (10 * k + 2, y), (10 * k + 3, x + " end")]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(10 * k + i, 10 * k + 1) for k in (0, 1) for i in (1, 2, 3)}


def brute_sw(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, now[j] - 1))
        best, prev = max(best, max(now)), now
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 40)), rng.integers(0, 5, rng.integers(1, 20))
        assert decontamination.align(a, b)[0] == brute_sw(a.tolist(), b.tolist())


def test_decontamination_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000").orderBy("doc_id").limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).collect()]
    rng = np.random.default_rng(1)
    for n, (i, t) in enumerate(items[:10]):
        ws = t.split()
        for at in rng.integers(0, len(ws), len(ws) // 6):
            ws[at] = "zzz"
        docs[n] = (docs[n][0], docs[n][1] + " " + " ".join(ws) + " the end")
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in decontamination.contaminated(d, b).collect()}
    words = decontamination.words_of
    want = {(x, i): round(s / (2 * len(words(u))), 6) for x, t in docs for i, u in items if (s := brute_sw(words(t), words(u))) >= len(words(u))}
    assert got == want and len(got) >= 8
    assert {r.doc_id for r in decontamination.drop_contaminated(d, b).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_decontamination_finds_edits_of_a_common_item(spark):
    """An item copied whole into many documents, and copies with each half edited."""
    item = [f"i{k}" for k in range(40)]
    first = [f"x{k}" if k in (2, 5, 8, 11, 14, 17, 20) else w for k, w in enumerate(item)]
    last = [f"x{k}" if k in (19, 22, 25, 28, 31, 34, 37) else w for k, w in enumerate(item)]
    docs = [(k, "before " + " ".join(item) + " after") for k in range(20)] + [(100, " ".join(first)), (101, " ".join(last)), (102, " ".join(item[::-1]))]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: round(r.score, 6) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {d: round(brute_sw(t.split(), item) / 80, 6) for d, t in docs if d != 102}


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, None), (None, "a b c"), (3, "")], "item_id long, text string")
    got = sorted({(r.doc_id or 0, r.item_id) for r in decontamination.contaminated(edge_docs(spark), items).collect()})
    assert got == [(0, 1), (1, 1), (2, 1)]
    assert decontamination.contaminated(empty_docs(spark), items).count() == 0 and decontamination.contaminated(edge_docs(spark), items.limit(0)).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", "<|im_end|>\n<\\|x"), (1, 1, "assistant", None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, None, "x"), (3, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.expand_prefix_targets(df)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0 and got[2].loss_chars == 2 and got[3].loss_chars == 0 and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n<|im_end|>\n<\\|x\nassistant\n\n").hexdigest()
    assert chat.expand_prefix_targets(df.limit(0)).count() == 0


def direct_ids(file, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(file))
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_encoder_equals_library(file, sf_dir):
    texts = ["", " ", "Hello  world\n\n x", "<|endoftext|> a<|endoftext|>", "çüé ß x", "it's 12,5\t\r\n end ", "日本語 text", "a" * 300]
    texts += ["a\u3000\nb c", "\u00a0x", "x\u00a0", " İX iĞ ğ", " A\u030a b", "a\x1c b", " 's 't", "  \t", "q"]
    texts += [r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").slice(0, 50).to_pylist()]
    want = direct_ids(file, texts)
    flat, bounds = encoder(file).encode(pa.array(texts), 3)
    assert [flat[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == [[*w, 3] for w in want]
    assert encoder(file).counts(pa.array(texts)).tolist() == [len(w) for w in want]
    assert encoder(file).encode(pa.array(texts[:9])[2:5])[1][-1] == sum(map(len, want[2:5]))
    assert encoder(file).encode(pa.array([], pa.string()), 3)[0].tolist() == []


class Counted:
    """A tokenizer that keeps the texts it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_piece_encoder_asks_once_for_a_word(monkeypatch):
    """Spellings of a word, stops after it and words outside ASCII share what is asked; words that are met again outlive a full generation."""
    enc = tokens.PieceEncoder(public_path("word_bpe_49k.json"))
    enc.tokenizer = seen = Counted(enc.tokenizer)
    same = ["x the The THE\tthe the, The. the", "x grün. Über\n\nÇa A\u030a,b H\u0331 İ"]
    flat, bounds = enc.encode(pa.array(same))
    assert [flat[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == direct_ids("word_bpe_49k.json", same)
    assert sum(t.lower().count("the") for t in seen.asked) == 1
    assert sum(not t.isascii() for t in seen.asked) == 1
    monkeypatch.setattr(tokens, "_PIECE_CHARS", 50)
    for i in range(20):
        texts = ["y often said"] + [f"z {'q' * i}{k}k" for k in range(9)]
        flat, bounds = enc.encode(pa.array(texts))
        assert [flat[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == direct_ids("word_bpe_49k.json", texts)
        assert len(enc.index) < 40 and len(enc.before[0]) < 40
    assert sum(t.count("often") for t in seen.asked) == 1


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_encoder_equals_library_at_stops_and_marks(file):
    r = random.Random(5)
    letters = "\u0338\u0308\u0327\u0331\u0307\u0301.,;:!? \n\tAbHiİßς's\u00e91\u03a3\u212b"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    flat, bounds = encoder(file).encode(pa.array(texts))
    assert [flat[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == direct_ids(file, texts)


def brute_packing(rows, seq_len=2048):
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece, from the library's ids."""
    out = []
    for (doc, text), got in zip(rows, direct_ids("word_bpe_49k.json", [t or "" for _, t in rows])):
        ids, start = [*got, 1], 0
        for k in packing.binary_lengths(len(ids), seq_len):
            out.append((doc, start, k, zlib.crc32(struct.pack(f"<{k}I", *ids[start : start + k])), len(ids)))
            start += k
        assert start == len(ids)
    return sorted(out, key=repr)


def test_packing_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    got = queries.op5_power_of_two_packing(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == brute_packing(rows)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in got)


def test_packing_edges(spark):
    """Nulls, empty texts, repeated rows, a long text, clashing columns; an empty table."""
    df = edge_docs(spark)
    got = [(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in packing.pack(df).collect()]
    assert sorted(got, key=repr) == brute_packing([(r.doc_id, r.text) for r in df.collect()])
    assert packing.pack(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, seq_len=1000)


def test_packing_batches_hold_equal_lengths(spark, sf_dir):
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    batches = packing.bucket_batches(pieces, batch_tokens=4096).collect()
    assert all(len(b.ids) == 4 * (b.sequences << b.bucket) and len(b.ids) <= 4 * 4096 for b in batches)
    cut = [(b.bucket, b.ids[i : i + (4 << b.bucket)]) for b in batches for i in range(0, len(b.ids), 4 << b.bucket)]
    assert sorted(cut) == sorted((r.bucket, bytes(r.ids)) for r in pieces.collect())
    assert packing.bucket_batches(packing.pack(empty_docs(spark))).count() == 0


def brute_ring(rows, shards, virtual_nodes=128):
    """(shard, slot) of each row: own arcs first in ring order, then overflow clockwise; row by row."""
    on = sharding.ring(shards, virtual_nodes)
    arcs = {}
    for doc, crc, size, position in rows:
        arc = max((i for i, p in enumerate(on.starts) if p <= position), default=len(on.starts) - 1)
        arcs.setdefault(arc, []).append((position + (sharding.RING if position < on.starts[0] else 0), doc, crc, size))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    filled, out, over = [0] * shards, {}, []

    def put(row, shard):
        out[row] = (shard, filled[shard])
        filled[shard] += 1

    for arc in range(len(on.starts)):
        for row in sorted(arcs.get(arc, [])):
            if filled[on.owners[arc]] < room[on.owners[arc]]:
                put(row[1:], on.owners[arc])
            else:
                over.append((arc, row[1:]))
    for arc, row in over:
        step = 1
        while filled[on.owners[(arc + step) % len(on.owners)]] >= room[on.owners[(arc + step) % len(on.owners)]]:
            step += 1
        put(row, on.owners[(arc + step) % len(on.owners)])
    return out


def test_sharding_equals_brute_force(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = docs.select("doc_id", F.crc32("text").alias("crc"), F.octet_length("text").alias("n")).withColumn("position", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(sharding.RING)))
    rows = [(r.doc_id, r.crc, r.n + 1, r.position) for r in where.collect()]
    for shards in (8, 3):
        got = {(r.doc_id, r.text_crc32, r["size"]): (r.shard, r.slot) for r in sharding.shard_rows(docs, shards).collect()}
        assert got == brute_ring(rows, shards)


def test_sharding_moves_little(spark):
    """A ninth shard: rows that change their shard are fewer than half of what dealing anew moves (eight ninths)."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    before, after = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, n).collect()} for n in (8, 9))
    moved = sum(before[d] != after[d] for d in before) / len(before)
    assert moved < 0.45


def test_sharding_edges(spark, sf_dir):
    """Nulls, empty texts, repeated rows, clashing columns: every row has a slot of its own; an empty table."""
    rows = sharding.shard_rows(edge_docs(spark), 3).collect()
    assert len(rows) == 10 and len({(r.shard, r.slot) for r in rows}) == 10 and {r.law for r in rows} == {"rows"}
    assert [r["size"] for r in rows if r.text_crc32 == 0].count(1) == 3
    assert sharding.shard_rows(empty_docs(spark)).count() == 0
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    query = queries.op6_bounded_ring_sharding(spark, sf_dir).collect()
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in query) and len(query) == len(docs)


def test_records_round_trip(spark, tmp_path):
    df = edge_docs(spark)
    got = records.read_records(records.write_records(df, f"file://{tmp_path}/r", partitions=3)).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].encode())))
    at = 0
    for r, (doc, ids) in zip(got, zip([d for d, _ in rows], direct_ids("byte_bpe_50k.json", [t for _, t in rows]))):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert records.read_records(records.write_records(empty_docs(spark), f"file://{tmp_path}/e")).count() == 0


def test_records_shuffled_reads(spark, tmp_path):
    """Another seed is another order; every record comes once in each."""
    manifest = records.write_records(edge_docs(spark), f"file://{tmp_path}/s", partitions=3)
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in records.read_records(manifest).collect())
    orders = []
    for seed in (1, 2):
        got = records.read_shuffled(manifest, seed).orderBy("epoch_order").collect()
        orders.append([(r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.ids)) for r in got])
        assert sorted(orders[-1]) == want and all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert orders[0] != orders[1]
    empty = records.write_records(empty_docs(spark), f"file://{tmp_path}/t")
    assert records.read_shuffled(empty, 1).count() == 0


def test_records_tell_damage(tmp_path):
    """Any changed byte, and a cut file, raise."""
    raw = b"".join(records.frame(records.payload_of(i, np.array([i, 9], "<u4").tobytes(), 2)) for i in range(3))

    def read(data):
        f = io.BytesIO(data)
        while (p := records.read_record(f)) is not None:
            records.unpack(p)

    read(raw)
    for at in range(len(raw)):
        with pytest.raises(ValueError):
            read(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    for end in range(1, len(raw)):
        if end % (len(raw) // 3):
            with pytest.raises(ValueError):
                read(raw[:end])
    assert records.unpack(records.read_record(io.BytesIO(raw), len(raw) // 3))[0] == 1


def test_length_histogram(spark):
    df = edge_docs(spark)
    n = [len(x) for x in direct_ids("byte_bpe_50k.json", [r.text or "" for r in df.collect()])]
    hist = lengths.length_histogram(lengths.token_lengths(df))
    rows = hist.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        assert r.documents == n.count(r.n_tokens) and r.documents_at_least == sum(x >= r.n_tokens for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.n_tokens) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert r.quantile == sum(x <= r.n_tokens for x in n) / len(n)
    limits = [0, 2, 3, 2048, max(n), 10**9]
    totals = {r.context_limit: (r.documents_cut, r.truncated_tokens) for r in lengths.token_totals(hist, limits).collect()}
    assert totals == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in limits}
    got = {r.share: r.n_tokens for r in lengths.length_quantile(hist, [0.25, 0.5, 1.0]).collect()}
    assert got == {q: next(x for x in sorted(n) if sum(y <= x for y in n) >= q * len(n)) for q in got}


def test_length_histogram_query_equals_brute_force(spark, sf_dir):
    n = [len(x) for x in direct_ids("byte_bpe_50k.json", [r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()])]
    got = {r.n_tokens: (r.documents, r.documents_at_least, r.truncated_tokens) for r in queries.op8_token_length_histogram(spark, sf_dir).collect()}
    assert got == {k: (n.count(k), sum(x >= k for x in n), sum(min(x, k) for x in n)) for k in set(n)}


def test_length_histogram_of_an_empty_table(spark):
    hist = lengths.length_histogram(lengths.token_lengths(empty_docs(spark)))
    assert hist.count() == 0
    assert [(r.documents_cut, r.truncated_tokens) for r in lengths.token_totals(hist, [5]).collect()] == [(0, 0)]


def test_toxicity_held_out(spark):
    """Of the held-out texts at sf0.1 nine tenths are right, of the toxic ones too."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_compression_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted == truth[r.doc_id] for r in rows)
    assert all(0 <= r.score <= 1 for r in rows) and hit / len(rows) > 0.9
    assert sum(r.predicted for r in rows if truth[r.doc_id]) > 0.9 * sum(truth[r.doc_id] for r in rows)


def test_toxicity_query_equals_plain_scoring(spark, sf_dir):
    """Each document by itself, each window compressed anew, nothing kept."""
    model = queries.toxicity_model(spark, sf_dir)
    got = {r.doc_id: r for r in queries.op9_compression_toxicity(spark, sf_dir).collect()}
    d = model.dictionaries
    wholes, size = set(d.wholes), len(d.toxic)
    for r in pq.read_table(f"{sf_dir}/documents.parquet").slice(0, 40).to_pylist():
        words = toxicity.windows(r["text"])
        seen = words + [b" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1) if b" ".join(words[i : i + n]) in wholes]
        gains = []
        for w in seen:
            raw = toxicity.CARRIER + b" " + w + b" " + toxicity.TAIL
            gains.append(len(toxicity._compressor(d.ordinary, size).compress(raw)) - len(toxicity._compressor(d.toxic, size).compress(raw)))
        top = sorted([0, 0, 0, *gains], reverse=True)[:3]
        x = [1, top[0], sum(top) / 3, np.log1p(sum(g >= 3 for g in gains)), np.log1p(sum(w in wholes for w in seen))]
        score = 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))
        assert abs(got[r["doc_id"]].score - score) < 1e-9 and got[r["doc_id"]].predicted == (score >= 0.3)
        assert got[r["doc_id"]].held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_edges(spark):
    """Null and empty texts score alike, repeated rows too; clashing columns; a very long text; empty tables."""
    m = toxicity.fit([("you idiot fool", 1), ("a calm day", 0)] * 8)
    rows = toxicity.score(edge_docs(spark), m).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(rows) == 10 and by[3] == by[4] == by[5] and len(set(by[2])) == 1 and all(0 <= s <= 1 for v in by.values() for s in v)
    assert toxicity.reject_toxic(edge_docs(spark), m).columns == edge_docs(spark).columns
    assert toxicity.reject_toxic(empty_docs(spark), m).count() == 0
    assert toxicity.score(empty_docs(spark), toxicity.fit([])).count() == 0


def test_toxicity_whole_words_and_runs():
    """Marks whose letters ordinary words have too, and a run of ordinary words; texts share no other words by class."""
    rng = np.random.default_rng(7)
    common = [f"{a}{b}{c}" for a in ("achlich", "bomente", "tionerl", "veschau") for b in ("kei", "dor", "pfalt", "sei", "must", "vie") for c in ("ten", "ung", "er", "en", "el", "ster", "lich", "nis")]

    def text(extra=""):
        return " ".join([*rng.permutation(common)[:12], *([extra] if extra else []), f"n{rng.integers(10**6)}", f"m{rng.integers(10**6)}"])

    toxic = [text("achlichpfalte") if i % 2 else text("quiet lamp stone") for i in range(60)]
    plain = [text(("quiet stone", "lamp quiet", "stone lamp", "achlichpfalter")[i % 4]) for i in range(200)]
    m = toxicity.fit([(t, 1) for t in toxic] + [(t, 0) for t in plain])
    assert {b"achlichpfalte", b"quiet lamp"} <= set(m.dictionaries.wholes)
    d = toxicity.Distances(m.dictionaries)

    def score(t):
        return 1 / (1 + np.exp(-(np.array(toxicity.features(*d.of(t))) @ np.array(m.weights))))

    assert all(score(text(e)) >= 0.3 for e in ("achlichpfalte", "quiet lamp stone") for _ in range(20))
    assert all(score(text(e)) < 0.3 for e in ("", "quiet stone", "stone lamp quiet") for _ in range(20))


def test_toxicity_dictionary_grows():
    """All marks enter, however many bytes they take."""
    rng = np.random.default_rng(9)
    marks = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 14)) for _ in range(300)]
    t = toxicity.Tally.of([(" ".join(marks[i % 10 :: 10]), 1) for i in range(120)] + [(f"calm day {i}", 0) for i in range(300)], set())
    d = toxicity.train_dictionaries(t)
    assert len(d.toxic) - len(d.ordinary) > 2048 and all(w.encode() in d.toxic for w in marks)


def test_toxicity_copies_are_not_common_words():
    """Other texts of the same few words stay; an edited copy goes."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.permutation(40)) for _ in range(30)]
    edited = texts[0].split()
    edited[7] = "other"
    kept = toxicity.without_copies([(t, 0) for t in [*texts, texts[3], " ".join(edited)]])
    assert [t for t, _ in kept] == texts


def test_licences(spark, sf_dir):
    m = licences.fit([f"ordinary words number {i} about weather and food" for i in range(300)])
    rows = [(1, "x y z\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (None, "Licensed under the Apache License, Version 2.0."), (5, "The The The The The"), (6, "His driving license expired.")]
    got = {(r.doc_id, r.family, r.passage): r.confirmed for r in licences.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, family int"), m).collect()}
    assert got == {(1, "MIT", "Released under the MIT License."): True, (2, "CC-BY-NC", "Licensed under CC BY-NC 4.0."): True, (None, "Apache-2.0", "Licensed under the Apache License, Version 2.0."): True}


def test_licence_edges(spark):
    """A licence of no known family, a long line, a long text, repeated rows, null ids; an empty table."""
    m = licences.fit([f"ordinary words number {i} about weather and food" for i in range(300)])
    notice = "Released under the MIT License."
    filler = "The weather was calm and the food was good. " * 40
    rows = [(1, filler + notice + " " + filler), (2, notice), (2, notice), (None, notice), (3, "\n".join(["plain words about food"] * 20_000) + "\n" + notice)]
    rows += [(4, "Licensed under the Foobar Community License, Version 7.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = [(r.doc_id, r.family, r.confirmed, r.passage) for r in licences.scan(df, m).collect()]
    for doc in (1, 2, None, 3):
        assert [g for g in got if g[0] == doc] == [(doc, "MIT", True, notice)] * (2 if doc == 2 else 1)
    assert all(not confirmed for doc, _, confirmed, _ in got if doc == 4)
    assert licences.scan(df.limit(0), m).count() == 0


def test_licence_query_equals_plain_scan(spark, sf_dir):
    """Sentence by sentence, each classified alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = licences.fit(licences.ordinary_sample(docs))
    want = []
    for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        open_ = None
        for lo, hi in licences.paragraphs(r["text"]):
            (k,), (p,) = m.families([licences.words_of(r["text"][lo:hi])])
            if open_ and open_[0] == k:
                open_[2], open_[3] = hi, max(open_[3], p)
            else:
                if open_ and open_[0]:
                    want.append((r["doc_id"], open_))
                open_ = [k, lo, hi, p]
        if open_ and open_[0]:
            want.append((r["doc_id"], open_))
    name = lambda k: licences.CLASSES[k] if k < licences.OTHER_LICENCE else licences.UNKNOWN
    got = sorted((r.doc_id, r.start, r.end, r.family, round(r.probability, 6)) for r in queries.op10_license_scan(spark, sf_dir).collect())
    assert got == sorted((d, lo, hi, name(k), round(float(p), 6)) for d, (k, lo, hi, p) in want)


def test_licence_scan_finds_every_notice(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r.doc_id, m) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for m in re.findall(r"[^\n]*\b[Ll]icense[^\n]*", r.text)}
    got = {(r.doc_id, r.passage) for r in queries.op10_license_scan(spark, sf).where("confirmed").collect()}
    assert {(d, p.strip()) for d, p in want} == {(d, p.strip()) for d, p in got}


def test_pipeline_stages_edges(spark, sf_dir):
    """Nulls, repeats, clashing columns and an empty table go through every stage that keeps documents."""
    import corpus_pipeline

    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= 10
        assert stage(spark, empty_docs(spark), sf_dir).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect()}
    assert kept == {1, 3, 5, 6, 7}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()} >= {3, 4, 5, 6}


def test_pipeline_keeps_what_brute_force_keeps(spark, sf_dir):
    """The rows that survive exact dedup, the Jaccard join and decontamination, by plain loops after the toxicity stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    rows = {r.doc_id: r.text for r in clean.collect()}
    first = {}
    for d in sorted(rows):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", rows[d]), d)
    rows = {d: rows[d] for d in first.values()}
    comp = brute_components(sorted(rows.items()), 5, 80, 100)
    rows = {d: t for d, t in rows.items() if comp[d][1] == d}
    items = [decontamination.words_of(r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    grams = [{tuple(i[k : k + 3]) for k in range(len(i) - 2)} for i in items]

    def holds(text):
        words = decontamination.words_of(text)
        own = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        return any(g & own and decontamination.align(*map(np.array, _numbers(words, i)))[0] >= len(i) for g, i in zip(grams, items))

    want = {d for d, t in rows.items() if not holds(t)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == want


def _numbers(a, b):
    index = {w: k for k, w in enumerate({*a, *b})}
    return [index[w] for w in a], [index[w] for w in b]


def test_chat_long_text_and_clashing_columns(spark):
    long = "<|im_start|>" * 20_000
    df = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", long, "y")], "conv_id long, turn long, role string, text string, context string")
    r = chat.read_back(chat.expand_prefix_targets(df)).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_pipeline_keeps_and_drops(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() > 100


def test_record_widths():
    import numpy as np

    ids = np.array([0, 65_535, 7], np.uint32)
    assert records.id_width(50_257, 0) == records.id_width(65_536, 0) == 2
    assert records.id_width(65_537, 0) == records.id_width(100, 65_536) == 4
    for width in (2, 4):
        doc, back = records.unpack(records.payload_of(5, ids.astype(f"<u{width}").tobytes(), 3, width))
        assert doc == 5 and back.dtype == np.dtype("<u4") and back.tolist() == [0, 65_535, 7]
    doc, back = records.unpack(records.payload_of(None, np.array([70_000, 0], "<u4").tobytes(), 2))
    assert doc is None and back.tolist() == [70_000, 0]
