"""Comparison by variant, marketplace offers, and text helpers by golden rows."""

from pyspark.sql import functions as F

from pricelake.functions import pages as G
from pricelake.operators import comparison as C


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_available(spark):
    rows = [(1.0, True, False, "ACTIVE", "Stokta"), (1.0, True, False, None, None), (0.0, True, False, "ACTIVE", None), (None, True, False, "ACTIVE", None), (1.0, False, False, "ACTIVE", None), (1.0, True, True, "ACTIVE", None), (1.0, True, False, "active", None),
            (1.0, True, False, "ACTIVE", "Ürün TÜKENDİ".replace("İ", "i")), (1.0, True, False, "ACTIVE", "Stok dışı"), (1.0, True, False, "ACTIVE", "Out of Stock")]
    df = spark.createDataFrame(rows, "price double, active boolean, hidden boolean, lifecycle string, availability string")
    got = [r.ok for r in df.select(C.available(*[F.col(c) for c in df.columns]).alias("ok")).collect()]
    assert got == [True, True] + [False] * 8


def test_selected_variant(spark):
    rows = [(1, 1, 10, 5.0, 0.0, False, True, ""), (1, 2, 11, 9.0, 1.0, True, False, "x"), (1, 2, 12, 10.0, 0.0, True, True, "x"), (1, 3, 13, 12.0, 0.0, True, False, None), (2, None, 20, 3.0, None, True, None, None), (2, None, 21, 3.0, 0.0, True, False, None), (3, 7, 30, 1.0, 0.0, False, False, None), (3, 6, 31, 2.0, 0.0, False, False, None)]
    df = spark.createDataFrame(rows, "product_id int, variant_id int, offer_id int, price double, shipping double, is_available boolean, official boolean, delivery string")
    rows = C.compared(df)
    got = {r.offer_id: (r.total, r.is_best, r.score) for r in rows.collect()}
    assert got == {11: (10.0, True, 80.0), 12: (10.0, True, 100.0), 20: (3.0, True, 85.0), 21: (3.0, True, 85.0), 31: (2.0, False, 0.0)}
    s = {r.product_id: (r.total_offers, r.offers, r.best_total, r.saving) for r in C.comparison_summary(rows.withColumn("store_id", F.col("offer_id"))).collect()}
    assert s == {1: (2, 2, 10.0, 0.0), 2: (2, 2, 3.0, 0.0), 3: (1, 0, None, 0.0)}
    assert C.compared(df.limit(0)).count() == 0


def test_marketplace_repeats(spark):
    rows = [(1, 1, "a", "/x", 5.0, 1), (1, 1, "a", "/y", 4.0, 2), (1, 1, " ", "/y", 9.0, 3), (1, 1, None, "/y", 8.0, 4), (1, 2, "a", "/x", 4.0, 5)]
    df = spark.createDataFrame(rows, "product_id int, store_id int, code string, url string, price double, offer_id int")
    assert {r.offer_id: (r.is_best, r.saving) for r in C.marketplace_offers(df).collect()} == {2: (True, 5.0), 4: (False, 1.0), 5: (True, 5.0)}


def test_low_price(spark):
    verdict = lambda kind, peers, ratio: one(spark, C.low_price_verdict(F.lit(kind), F.lit(peers), F.lit(ratio)))
    assert verdict("phone", 2, 0.549) == verdict("accessory", 5, 0.1) == "QUARANTINED"
    assert verdict("phone", 2, 0.55) is verdict("phone", 1, 0.1) is verdict("tablet", 9, 0.1) is verdict("phone", 3, None) is None


def test_page_texts(spark):
    assert one(spark, G.gallery(F.lit('["https://a/1.jpg","https://a/2.jpg"]'))) == ["https://a/1.jpg", "https://a/2.jpg"]
    assert one(spark, G.gallery(F.lit("https://a/1.jpg | https://a/2.jpg\nhttps://a/3.jpg"))) == ["https://a/1.jpg", "https://a/2.jpg", "https://a/3.jpg"]
    assert one(spark, G.gallery(F.lit("[broken"))) == one(spark, G.gallery(F.lit(None).cast("string"))) == []
    assert one(spark, G.money(F.lit(1234.5))) == "1.234,50 TL"
    assert one(spark, G.srcset(F.lit("https://a/1.jpg?x=1"), (320, 640))) == "https://a/1.jpg?x=1&w=320 320w, https://a/1.jpg?x=1&w=640 640w"
    deep = '{"a": [{"SKU": "1"}, {"b": {"sku": 2, "Sku": true}}]}'
    assert one(spark, G.json_values(F.lit(deep), F.lit("sku"))) == ["1", "2"] and one(spark, G.json_values(F.lit("{"), F.lit("sku"))) == []




def test_title_matches_equal_plain_rules(spark, sf_dir):
    """Weights and gates of two titles in plain Python; matches and non-matches occur."""
    import re
    from difflib import SequenceMatcher

    from pricelake.functions import identity as I
    from pricelake.functions.text import fold
    from pricelake.operators import linkage as L

    titles = [
        "Asus Vivobook X1504VA-BQ5391 Intel i5 1335U 16 GB RAM 512 GB SSD 15.6 inç", "ASUS Vivobook X1504VA-BQ5391 i5-1335U 16GB 512GB SSD 15.6 inç laptop", "Asus Vivobook X1504VA i5 1335U 16 GB RAM 512 GB SSD 15.6 inç", "Asus Vivobook X1504VA-NJ3665 i5 1335U 16 GB RAM 512 GB SSD",
        "Asus Vivobook X1504ZA i5 1235U 8 GB RAM 512 GB SSD", "Lenovo Loq X1504VA 16 GB RAM 1 TB SSD", "Philips airfryer siyah büyük hazneli", "Philips airfryer siyah hazneli", "Samsung Galaxy S21 8 GB RAM 256 GB", "Samsung Galaxy S21 Ultra 12 GB RAM 256 GB", "", "Asus X1504VA 14.0 inç",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", "t", fold(F.col("t")).alias("f"), I.parse(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p"))
    rows = df.collect()
    noise = set(L.TITLE_NOISE)

    def words(f):
        joined = re.sub(r"([0-9]+)\s*(gb|tb|mb)", r"\1\2", f)
        return sorted({w for w in re.sub("[^a-z0-9]+", " ", joined).split() if len(w) > 1 and w not in noise})

    def model(code):
        m = re.search(r"\b([a-z][0-9]{3,5}[a-z]{1,3})(?:-([a-z0-9]{3,}))?\b", code)
        return (m[1], m[2] or "") if m else (re.sub("[^a-z0-9]+", "", code), "")

    def cpus(f):
        return set(re.findall(r"\b(?:core\s*)?(?:i[3579][-\s]*)?([0-9]{3,5}[a-z]{1,3})\b", f)) | set(re.findall(r"\bryzen\s*[3579]?\s*([0-9]{3,5}[a-z]{0,2})\b", f))

    def plain(x, y):
        a, b, p, q = words(x.f), words(y.f), x.p, y.p
        ratio = SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()
        title = round(len(set(a) & set(b)) / len(set(a) | set(b)) * 0.7 + ratio * 0.3, 4) if a and b else 0.0
        (f, s), (g, t) = model(p.model_code), model(q.model_code)
        c, d = cpus(x.f), cpus(y.f)
        apart = lambda u, v: u is not None and v is not None and u != v
        if (p.brand and q.brand and p.brand != q.brand) or (f and g and (f != g or (s and t and s != t))) or apart(p.ram_gb, q.ram_gb) or apart(p.storage_gb, q.storage_gb) or (c and d and not c & d):
            return False, 0.0
        if p.screen_inch is not None and q.screen_inch is not None and abs(p.screen_inch - q.screen_inch) > 0.25:
            return False, 0.0
        exact = bool(f and f == g and s and s == t)
        known = [(p.ram_gb, q.ram_gb, 0.12), (p.storage_gb, q.storage_gb, 0.12), (p.screen_inch, q.screen_inch, 0.05)]
        score = (0.08 if p.brand and q.brand else 0.03) + (0.46 if exact else 0 if not (f and g) else 0.31 if not t else 0.25)
        score += sum(w if u is not None and v is not None else w / 4 for u, v, w in known) + (0.12 if c and d else 0.03) + min(0.15, title * 0.15)
        score = round(min(1.0, score), 4)
        hardware = sum(u is not None and v is not None for u, v, _ in known) + bool(c and d)
        fallback = f and f == g and not t and hardware >= 2 and title >= 0.32 and score >= 0.72
        return bool((exact and score >= 0.62) or fallback or (not f and score >= 0.84 and title >= 0.70)), score

    joined = lambda c: F.array_join(L.title_words(F.col(c)), " ")
    pairs = df.toDF("i", "ta", "fa", "p").crossJoin(df.toDF("j", "tb", "fb", "q")).withColumn("ratio", L.seq_ratio(joined("ta"), joined("tb")))
    got = {(r.i, r.j): (r.m.matched, r.m.score) for r in pairs.select("i", "j", L.weighted_match(F.col("p"), F.col("q"), F.col("ta"), F.col("tb"), F.col("ratio")).alias("m")).collect()}
    want = {(x.i, y.i): plain(x, y) for x in rows for y in rows}
    assert {k: (got[k], w) for k, w in want.items() if got[k][0] != w[0] or abs(got[k][1] - w[1]) > 2e-4} == {}
    assert {m for m, _ in want.values()} == {True, False} and len({s for _, s in want.values()}) > 8


def test_product_fixes_equal_plain_rules(spark, sf_dir):
    """Brand, model, category and cleaned name by plain Python over the query's own rows, and golden rows."""
    import re
    import unicodedata

    from pricelake.functions import inference as N
    from pricelake.plans import matching as P
    from pricelake.sources.market import market_cards

    bare = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(c)).casefold()
    clean = lambda v: re.sub(r"\s+([,.;:])", r"\1", re.sub(r"\s+", " ", v or "").strip(" -|,"))

    def plain(name, brand, model, category):
        n, t = clean(name), bare(clean(name))
        b = None if (brand or "").strip() else next((k for k in N.KNOWN_BRANDS if re.search(rf"(?<![a-z0-9]){re.escape(bare(k))}(?![a-z0-9])", t)), None)
        own, found = (brand or "").strip() or b, None
        if not (model or "").strip():
            hit = next((h[0] for p in N.MODELS if (h := re.search(p, n, re.I))), None)
            if hit is not None:
                found = clean(hit)
                if own and bare(found).startswith(bare(own)):
                    found = clean(found[len(own) :])
        c = None if (category or "").strip() else next((k for k, ws in N.CATEGORY_WORDS if any(bare(w) in t for w in ws)), None)
        return b, found, c, n if n and n != name else None

    golden = [("  Samsung Galaxy S24 Ultra , 256 GB -", None, None, None), ("AKILLI SAAT", None, None, None), ("akıllı saat Casper VIA20", "", "", ""), ("Arçelik 9123 bulaşık makinesi", None, None, "Mutfak"), ("RTX 5060 Ti MSI", "MSI", None, None), ("wdx", None, None, None), (None, None, None, None), ("HP-15 Victus", None, None, None)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(golden)], "i int, name string, brand string, model string, category string")
    got = {r.i: tuple(r.f) for r in df.select("i", N.suggested_fix(*[F.col(c) for c in ("name", "brand", "model", "category")]).alias("f")).collect()}
    assert {i: (got[i], plain(*g)) for i, g in enumerate(golden) if got[i] != plain(*g)} == {}
    assert got[0] == ("Samsung", "Galaxy S24 Ultra", "Telefon", "Samsung Galaxy S24 Ultra, 256 GB")
    cards = {r.card_id: r for r in market_cards(spark, sf_dir).where("product_id < 40").collect()}
    for r in P.product_fixes(spark, sf_dir).where(F.col("card_id") < 4000).collect():
        c, m = cards[r.card_id], r.card_id % 100
        name = f" -  {c.name} , |" if m == 6 else c.name
        assert (r.brand, r.model, r.category, r.name) == plain(name, c.brand if m % 3 else None, "X" if m == 5 else None, c.category if m % 2 else None)
