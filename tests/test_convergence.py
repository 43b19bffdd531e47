"""Merges, audits, elections and repairs against plain loops; stream sinks against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from pricelake.operators import convergence as C
from pricelake.operators import history
from pricelake.plans import converge as P
from pricelake.plans import ingest
from pricelake.sources.staged import staged
from pricelake.streaming import catalog as S


def test_closure(spark, monkeypatch):
    monkeypatch.setattr(C, "_ROUNDS", 8)
    pairs = [(i, i - 1) for i in range(2, 70)] + [(100, 70), (100, 101), (5, 5), (200, 201), (201, 202), (202, 200), (203, 200), (300, 301)]
    got = {r.id: r.survivor_id for r in C.closure(spark.createDataFrame(pairs, "id long, survivor_id long")).collect()}
    assert got == {i: 1 for i in range(2, 70)} | {100: 70, 300: 301}  # circles and what hangs on them are left out
    assert C.closure(spark.createDataFrame([], "id long, survivor_id long")).count() == 0


def small_catalog(spark):
    rng = random.Random(3)
    products = [(k, rng.choice([None, "", " ", f"img{k}"]), rng.choice([None, k])) for k in range(1, 31)]
    variants = [(k * 10 + v, k, f"c{(k * 7 + v * 3) % 5}") for k in range(1, 31) for v in range(3) if v == 0 or (k * 7 + v * 3) % 5 != (k * 7) % 5]
    ids = [v[0] for v in variants]
    offers = [(i, i, (v := rng.choice(ids)) // 10, v if i % 9 else None, i % 4 > 0, i % 5 == 0, rng.choice(["ACTIVE", "UPDATED"]), float(i % 3)) for i in range(400)]
    make = spark.createDataFrame
    o = make(offers, "offer_id long, raw_id long, product_id long, variant_id long, active boolean, hidden boolean, lifecycle string, price double")
    tables = {"products": make(products, "product_id long, image string, ram_gb long"), "variants": make(variants, "variant_id long, product_id long, variant_key string"), "raws": o.select("raw_id", "product_id", "variant_id"), "offers": o,
              "history": o.select("offer_id", "product_id", "variant_id")}
    return tables, products, variants, offers


def test_merge_equals_loops(spark):
    tables, products, variants, offers = small_catalog(spark)
    to = {4: 2, 2: 1, 9: 4, 12: 11, 13: 11, 30: 29, 28: 77}
    out = C.merge_catalog(tables, spark.createDataFrame(list(to.items()), "id long, survivor_id long"), ("image",), ("ram_gb",))
    end = {}
    for k in (p[0] for p in products):
        s = k
        while s in to and to[s] != 77:
            s = to[s]
        end[k] = s
    known = lambda v: (v.strip() or None) if isinstance(v, str) else v
    want = {}
    for s in set(end.values()):
        mine = [p for p in products if end[p[0]] == s]
        order = sorted(mine, key=lambda p: (p[0] != s, p[0]))
        raw = [o for o in offers if end[o[2]] == s]
        want[s] = tuple(next((known(p[i]) for p in order if known(p[i]) is not None), None) for i in (1, 2)) + (len(mine), len(raw), sum(o[4] and not o[5] and o[6] == "ACTIVE" and o[7] > 0 for o in raw))
    assert {r.product_id: (r.image, r.ram_gb, r.members, r.raw_product_count, r.active_offer_count) for r in out["products"].collect()} == want
    stands = {}
    for v, k, key in variants:
        group = [x for x in variants if end[x[1]] == end[k] and x[2] == key]
        stands[v] = min(group, key=lambda x: (x[1] != end[k], x[0]))[0]
    assert {r.variant_id: r.survivor_variant_id for r in out["variant_remap"].collect()} == stands
    assert sorted((r.offer_id, r.product_id, r.variant_id) for r in out["offers"].collect()) == sorted((o[0], end[o[2]], stands.get(o[3])) for o in offers)
    audit = C.health_audit(out, out["remap"]).first()
    assert audit.clean and audit.dangling == 0 and audit.duplicate_variant_keys == 0


def test_audit_finds_each_fault(spark):
    tables, products, variants, offers = small_catalog(spark)
    whole = C.merge_catalog(tables, spark.createDataFrame([], "id long, survivor_id long"), ("image",), ("ram_gb",))
    whole = {t: staged(df, t) for t, df in whole.items()}
    none = spark.createDataFrame([], "id long")
    assert C.health_audit(whole, none).first().clean
    one = F.col("offer_id") == 1
    faults = {
        "dangling": {"history": whole["history"].withColumn("variant_id", F.when(one, 9999).otherwise(F.col("variant_id")))}, "duplicate_variant_keys": {"variants": whole["variants"].withColumn("variant_key", F.lit("x"))},
        "active_variant_drift": {"raws": whole["raws"].withColumn("variant_id", F.lit(10).cast("long"))}, "raw_counter_drift": {"products": whole["products"].withColumn("raw_product_count", F.lit(-1).cast("long"))},
        "active_offer_counter_drift": {"products": whole["products"].withColumn("active_offer_count", F.lit(-1).cast("long"))}, "quarantine_violations": {"offers": whole["offers"].withColumn("lifecycle", F.lit("QUARANTINED"))},
        "raw_variant_wrong_product": {"raws": whole["raws"].withColumn("product_id", F.lit(1).cast("long"))}, "offer_variant_wrong_product": {"offers": whole["offers"].withColumn("product_id", F.lit(1).cast("long"))},
    }
    for fault, tables in faults.items():
        audit = C.health_audit(whole | tables, none).first()
        assert audit[fault] > 0 and not audit.clean, fault
    assert C.health_audit(whole, spark.createDataFrame([(3,)], "id long")).first().retired_rows_remaining == 1


GROUPS = "group_id long, group_key string, identity_source string, model string, canonical_name string, brand string, category string"


def test_watch_election(spark):
    lite, plain = "identity_v3:brand=xiaomi|family=redmi watch 5|variant=lite", "identity_v3:brand=xiaomi|family=redmi watch 5"
    rows = [
        (1, "a", None, "redmi watch 5 lite", "Redmi Watch 5", "Xiaomi", None), (2, "b", lite, None, "saat", "Xiaomi", "Akıllı Saat"), (3, "c", plain, None, "Redmi Watch 5", None, None), (4, None, None, "Redmi Watch 5", "x", None, None),
        (5, "d", None, "Watch GT5 Pro", "Galaxy Watch 7", None, None), (6, "e", None, "Huawei watch gt 5 pro", "", "Huawei", None), (7, "f", None, "no", "kulaklık", "Xiaomi", "Akıllı Saat"), (8, "g", None, "galaxy watchx", "galaxy watch", "LG", None),
    ]
    got = {r.id: (r.survivor_id, r.outcome, r.new_source, r.new_key) for r in C.converge_watches(spark.createDataFrame(rows, GROUPS), ["identity_source", "model", "canonical_name"]).collect()}
    # a packed source is read as words, in which the variant doesn't stand behind the family
    assert got[1][:3] == (1, "updated", lite) and len(got[1][3]) == 32 and got[2] == (3, "merged", plain, "merged:2:b")
    assert got[3][:3] == (3, "updated", plain) and got[4][:3] == (3, "merged", plain)
    assert got[5][:3] == (5, "updated", "identity_v3:brand=huawei|family=watch gt 5|variant=pro") and got[6][:2] == (5, "merged") and 7 not in got and 8 not in got


def test_watch_convergence_equals_loops(spark, sf_dir):
    """Survivors and keys by plain loops over the elected identities."""
    from pricelake.functions.text import identity_key

    rows = {r.group_id: r for r in P._watch_groups(spark, sf_dir).collect()}
    out = P.watch_convergence(spark, sf_dir).withColumn("key", identity_key(F.col("new_source"))).collect()
    buckets = {}
    for r in out:
        buckets.setdefault(r.new_source, []).append(r)
    for source, members in buckets.items():
        key = members[0]["key"]
        both = [r.id for r in members if rows[r.id].group_key == key and rows[r.id].identity_source == source]
        held = [r.id for r in members if rows[r.id].identity_source == source]
        stays = min(both or held or [r.id for r in members])
        for r in members:
            want = ("kept" if stays in both else "updated") if r.id == stays else "merged"
            assert (r.survivor_id, r.outcome) == (stays, want)
            assert r.new_key == (key if r.id == stays else f"merged:{r.id}:{rows[r.id].group_key}")
    assert {r.outcome for r in out} == {"kept", "updated", "merged"}


def test_accessory_convergence_fails_closed(spark):
    """Each reason by itself, and a repair."""
    from pricelake.functions import identity as I
    from pricelake.functions.text import identity_key

    case = lambda k, brand, name="iPhone 15 uyumlu kılıf", status="MATCHED": (k, status, name, brand)
    raws = [
        case(1, "Spigen"), case(1, "Spigen", "iPhone 15 kapak"), case(2, "Spigen", "iPhone 14 kılıf"), case(2, "Ringke", "iPhone 14 kılıf"), case(3, "Apple"), case(4, "Spigen", "iPhone 13 kılıf"), case(4, "Apple", "Apple iPhone 13 128 GB"), case(5, "Spigen", "iPhone 12 kılıf"),
        case(6, "Nillkin", "iPhone 11 kılıf"), case(7, "Baseus", "iPhone 10 kılıf"), case(8, "Baseus", "iPhone 9 kılıf"), case(9, "Baseus", "iPhone 8 kılıf", "REVIEW"), case(10, "Samsung", "iPhone 7 kılıf"), case(11, "Baseus", "iPhone 6 kılıf"),
    ]
    raw = spark.createDataFrame(raws, "product_id long, status string, name string, b string").select("product_id", "status", I.parse(F.col("name"), F.col("b"), F.lit("Telefon")).alias("p"))
    source = {r.k: r.s for r in raw.select(F.col("product_id").alias("k"), I.identity_source(F.col("p")).alias("s")).collect()}
    family = {1: 15, 2: 14, 3: 15, 4: 13, 5: 99, 6: 11, 7: 10, 8: 9, 9: 8, 10: 7, 11: 6}
    products = [(k, "apple", f"iphone {n}", f"k{k}", f"s{k}", "ACTIVE") for k, n in family.items()] + [(60, "nillkin", "x", "other", source[6], "ACTIVE"), (61, "baseus", "x", "other61", source[11], "MERGED"), (12, "lg", "iphone 1", "k12", "s12", "ACTIVE")]
    p = spark.createDataFrame(products, "product_id long, brand string, family string, identity_key string, identity_source string, status string")
    key = spark.range(1).select(identity_key(F.lit(source[8])).alias("k")).first().k
    g = spark.createDataFrame([(1, "g1", "s1", None, "iPhone 15"), (7, "g7", "s7", "LG", "other"), (8, key, "elsewhere", None, None)], "group_id long, group_key string, identity_source string, brand string, model string")
    got = {r.product_id: (r.reasons, r.repaired, r.new_brand, r.group_rows) for r in C.converge_accessories(p, raw, g).collect()}
    assert got[1] == ([], True, "spigen", 1) and got[11] == ([], True, "baseus", 0)
    assert got[2][0] == ["RAW_IDENTITY_KEY_DISAGREEMENT", "RAW_IDENTITY_SOURCE_DISAGREEMENT", "RAW_BRAND_DISAGREEMENT"] and got[5][0] == ["FAMILY_CONFLICT"]
    assert got[6][0] == ["GLOBAL_PRODUCT_COLLISION"] and got[7][0] == ["PRODUCT_GROUP_BRAND_CONFLICT", "PRODUCT_GROUP_MODEL_CONFLICT"] and got[8][0] == ["PRODUCT_GROUP_COLLISION"]
    assert got[10][0] == ["NO_NON_COMPATIBILITY_BRAND_EVIDENCE"] and not {3, 4, 9, 12} & set(got)


def test_variant_references(spark):
    v = spark.createDataFrame([(1, 1, "M1", "Mavi", "5G"), (2, 1, None, " mavi ", "5g"), (3, 1, "M2", "mavi", "5g"), (4, 1, "m1", None, None), (5, 2, None, None, None)], "variant_id long, product_id long, model_code string, color string, network string")
    o = spark.createDataFrame([(i, i, 1, 1, True) for i in range(6)] + [(7, 7, 1, 1, False), (8, 8, 1, 77, True)], "offer_id long, raw_id long, product_id long, variant_id long, active boolean")
    r = spark.createDataFrame([(0, 1, 2, "MATCHED"), (1, 1, 3, "MATCHED"), (2, 1, 4, "MATCHED"), (3, 2, 5, "MATCHED"), (4, 1, 2, "REVIEW"), (5, 1, 1, "MATCHED"), (7, 1, 2, "MATCHED"), (8, 1, 2, "MATCHED")], "raw_id long, product_id long, variant_id long, status string")
    drift = C.variant_drift(o, r, v)
    got = {x.offer_id: x.reasons for x in drift.collect()}
    assert got == {0: [], 1: ["MODEL_CONFLICT"], 2: ["COLOR_CONFLICT_OR_LOSS", "NETWORK_CONFLICT_OR_LOSS"], 3: ["RAW_GLOBAL_PRODUCT_MISMATCH", "NEW_VARIANT_GLOBAL_PRODUCT_MISMATCH", "COLOR_CONFLICT_OR_LOSS", "NETWORK_CONFLICT_OR_LOSS"], 8: ["MISSING_VARIANT"]}
    h = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "offer_id long, variant_id long")
    assert sorted((x.offer_id, x.variant_id, x.relinked) for x in C.relinked(h, drift).collect()) == [(0, 2, False), (0, 2, True), (1, 1, False)]
    codes = spark.createDataFrame([("uzunlugu1",), ("SM-A55",), (None,), ("2adet",), ("nesil12",), ("modeli x1",)], "model_code string")
    assert [(x.model_code, x.cleaned) for x in C.without_pseudo_codes(codes).collect()] == [(None, True), ("SM-A55", False), (None, False), (None, True), (None, True), (None, True)]


# streams


def observed(spark, sf_dir, n=40):
    return ingest.with_availability(__import__("pricelake.sources.tables", fromlist=["observations"]).observations(spark, sf_dir)).where(F.col("product_id") <= n)


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_history_stream_equals_batch(spark, sf_dir, tmp_path, rocks):
    """Two files, two batches, state between them; repeated and unpriced rows."""
    rows = observed(spark, sf_dir, 12).withColumn("price", F.when(F.col("line") % 5 == 4, 0.0).otherwise(F.floor(F.col("price") / 400) * 400)).withColumn("shipping", F.when(F.col("line") % 2 == 0, 1.0)).withColumn("total", F.col("price") + F.coalesce("shipping", F.lit(0.0)))
    early, late = rows.where("seen_at < '1995-06-01'"), rows.where("seen_at >= '1995-06-01'")
    early.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: S.history_stream(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    for more in (None, late):
        if more is not None:
            more.coalesce(1).write.parquet(f"{tmp_path}/in/b")
        q = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    key = lambda r: (r.product_id, r.store_id, str(r.seen_at), r.price, r.shipping, r.total, r.availability)
    want = sorted(map(key, history.offer_changes(rows).collect()))
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == want and 0 < len(want) < rows.count()


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_catalog_sink_replays(spark, sf_dir, tmp_path):
    """Batches that are run again change nothing, and the stream's end equals one upsert of each batch."""
    scanned = ingest.scanned(spark, sf_dir).where("cast(code as long) <= 30")
    parts = [scanned.where("seen_at < '1995-01-01'"), scanned.where("seen_at >= '1995-01-01' and seen_at < '1998-01-01'"), scanned.where("seen_at >= '1998-01-01'")]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    snaps = S.Snapshots(spark, f"file://{tmp_path}/catalog", S.CATALOG)
    files = spark.readStream.schema(scanned.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = files.writeStream.foreachBatch(S.catalog_sink(snaps)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(600)
    assert q.exception() is None
    end = {t: rows_of(df) for t, df in snaps.before().items()}
    S.catalog_sink(snaps)(parts[2], 2)  # the newest batch is run again
    assert {t: rows_of(df) for t, df in snaps.before().items()} == end
    tables = {t: spark.createDataFrame([], s) for t, s in S.CATALOG.items()}
    for p in parts:
        tables = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in S.upsert_catalog(tables, p).items()}
    assert {t: rows_of(df) for t, df in tables.items()} == end
    ids = [r.product_id for r in tables["products"].collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    assert tables["raws"].where("product_id is null").count() == 0
    snaps.prune()
    assert {t: rows_of(df) for t, df in snaps.before().items()} == end


def test_upsert_keeps_what_rows_leave_out(spark):
    schema = "fingerprint string, store string, code string, url string, title string, brand string, model string, seller string, stock string, image string, category string, price double, old_price double, seen_at timestamp, identity_key string, identity_source string"
    row = lambda f, day, title=None, brand=None, price=None, key="k", source="s": (f, "st", "c", "u", title, brand, None, None, None, None, None, price, None, __import__("datetime").datetime(2024, 1, day), key, source)
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    empty = {t: spark.createDataFrame([], s) for t, s in S.CATALOG.items()}
    one = S.upsert_catalog(empty, make(row("a", 1, "T", "B", 5.0), row("a", 2, " ", None, 0.0), row("b", 1, key="k2", source=None), row(None, 1), row("c", 1, key=None)))
    got = {r.fingerprint: r for r in one["raws"].collect()}
    assert set(got) == {"a", "b"} and (got["a"].title, got["a"].brand, got["a"].price) == ("T", "B", 5.0) and got["b"].title == "Bilinmeyen Ürün"
    two = S.upsert_catalog(one, make(row("a", 3, "U", price=7.0), row("d", 3, key="k", source="other")))
    got = {r.fingerprint: r for r in two["raws"].collect()}
    assert (got["a"].title, got["a"].brand, got["a"].price, got["a"].first_seen.day, got["a"].last_seen.day) == ("U", "B", 7.0, 1, 3)
    assert got["d"].product_id is None or got["d"].product_id == got["a"].product_id


def test_checkpoints(spark, tmp_path):
    schema = "plan string, store string, url string, page int, count long, status string, error string, updated_at timestamp"
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    snaps = S.Snapshots(spark, f"file://{tmp_path}/cp", S.CHECKPOINTS)
    sink = S.checkpoint_sink(snaps)
    first = spark.createDataFrame([("p", "s", "u", 1, 10, "OK", None, at(1)), ("p", "s", "u", 2, 20, "OK", None, at(2)), ("p", "s", "v", 1, 1, "FAILED", "x", at(1))], schema)
    second = spark.createDataFrame([("p", "s", "v", 2, 5, "OK", None, at(3))], schema)
    for batch, n in ((first, 0), (second, 1), (second, 1)):
        sink(batch, n)
    got = {(r.plan, r.store, r.url): (r.page, r["count"], r.status, r.error) for r in snaps.before()["checkpoints"].collect()}
    assert got == {("p", "s", "u"): (2, 20, "OK", None), ("p", "s", "v"): (2, 5, "OK", None)}
