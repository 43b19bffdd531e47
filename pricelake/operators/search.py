"""Search over a catalog: query parsing, relevance, ranking, facets, filters, pages, cursors, autocomplete."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.functions import text as T
from pricelake.functions.let import let
from pricelake.operators.linkage import seq_ratio

#: Words of queries and what they mean, folded (fixed values).
CATEGORIES = {
    "laptop": ("laptop", "notebook", "dizustu", "oyuncu bilgisayari"),
    "telefon": ("telefon", "cep telefonu", "akilli telefon", "iphone", "android"),
    "monitor": ("monitor", "ekran"),
    "tablet": ("tablet", "ipad"),
    "televizyon": ("televizyon", "tv"),
    "kulaklik": ("kulaklik", "headset"),
}
PURPOSES = {
    "gaming": ("oyun", "oyuncu", "gaming", "fps"),
    "student": ("ogrenci", "okul", "ders"),
    "business": ("is bilgisayari", "ofis", "business"),
    "best_value": ("fiyat performans", "fiyat/performans", "en mantikli", "best value"),
}
BRANDS = {
    "apple": ("apple", "iphone", "macbook", "ipad"),
    "samsung": ("samsung", "galaxy"),
    "lenovo": ("lenovo", "loq", "legion", "thinkpad", "ideapad"),
    "asus": ("asus", "rog", "tuf", "zenbook", "vivobook"),
    "hp": ("hp", "victus", "omen", "pavilion"),
    "acer": ("acer", "nitro", "predator", "aspire"),
    "xiaomi": ("xiaomi", "redmi", "poco"),
}
CORRECTIONS = (
    ("samsng", "samsung"), ("iphne", "iphone"), ("lenovo log", "lenovo loq"), ("asus tufg", "asus tuf"), ("monitpr", "monitor"), ("lapotp", "laptop"), ("laptp", "laptop"),
)
SYNONYMS = (
    ("oyuncu bilgisayari", "gaming laptop"), ("cep telefonu", "telefon"), ("akilli telefon", "telefon"), ("dizustu", "laptop"), ("is bilgisayari", "business laptop"),
)
_RAM = "(4|6|8|12|16|24|32|48|64|96|128)"
_DISK = r"\b(128|256|480|512|1000|1024|2000|2048|4000|4096|1|2|4)\s*(tb|gb)\b(?!\s*ram)"
_GPU = r"\b(rtx\s*[0-9]{4}(?:\s*ti|\s*super)?|gtx\s*[0-9]{3,4}(?:\s*ti)?|rx\s*[0-9]{4}(?:\s*xt)?)\b"


def _first(text: Column, words: dict[str, tuple[str, ...]], whole: bool = False) -> Column:
    edge = r"\b" if whole else ""
    return F.coalesce(*[F.when(text.rlike(f"{edge}({'|'.join(w)}){edge}"), F.lit(k)) for k, w in words.items()])


def parse_query(c: Column) -> Column:
    """What a query asks for: normalized, search_text, category, brand, purpose, price_min, price_max, ram_gb, storage_gb, gpu, refresh_hz, network.

    Common misspellings are corrected and synonyms replaced first; unknown
    parts are null.
    """
    q = T.normalize_query(c)
    for wrong, right in (*CORRECTIONS, *SYNONYMS):
        q = F.replace(q, F.lit(wrong), F.lit(right))
    return let(q, _parsed)


def _parsed(q: Column) -> Column:
    def price(after: str) -> Column:
        pattern = rf"([0-9]+(?:\.[0-9]+)?)\s*(bin|k)?\s*(?:tl)?\s*(?:{after})"
        value = F.regexp_extract(q, pattern, 1).try_cast("double")
        return F.when(F.regexp_extract(q, pattern, 2) != "", value * 1000).otherwise(value)

    ram = rf"\b{_RAM}\s*(?:gb|g)?\s*ram\b|\bram\s*{_RAM}\b"
    number, unit = F.regexp_extract(q, _DISK, 1).try_cast("double"), F.regexp_extract(q, _DISK, 2)
    gpu = F.upper(F.regexp_replace(F.regexp_extract(q, _GPU, 1), r"\s+", " "))
    rest = F.trim(F.regexp_replace(F.regexp_replace(q, "altinda|alti|kadar|ustunde|ustu|uzeri|en iyi|fiyat performans", " "), r"\s+", " "))
    return F.struct(
        q.alias("normalized"), F.when(rest == "", q).otherwise(rest).alias("search_text"),
        _first(q, CATEGORIES).alias("category"), _first(q, BRANDS, whole=True).alias("brand"), _first(q, PURPOSES).alias("purpose"),
        price("ustunde|ustu|uzeri").alias("price_min"), price("altinda|alti|kadar").alias("price_max"),
        F.coalesce(F.regexp_extract(q, ram, 1).try_cast("int"), F.regexp_extract(q, ram, 2).try_cast("int")).alias("ram_gb"),
        F.when(unit == "tb", F.rint(number * 1024)).otherwise(F.rint(number)).cast("int").alias("storage_gb"),
        F.when(gpu != "", gpu).alias("gpu"), F.regexp_extract(q, r"\b(60|75|90|120|144|165|180|240|300|360)\s*hz\b", 1).try_cast("int").alias("refresh_hz"),
        F.when(q.rlike(r"\b5g\b"), "5g").when(q.rlike(r"\b4g\b"), "4g").alias("network"),
    )


def _has_word(text: Column, word: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), word, F.lit(" ")))


def relevance(query: Column, name: Column, brand: Column, model: Column, category: Column, identity: Column) -> Column:
    """How well fields fit a query: 1 for an empty one, 0 if any word is nowhere.

    Each word counts once, where it weighs most: the whole brand 42, the whole
    model 40, a word of the brand 34, the model 32, the name 24, the identity
    20, the category 12, inside the name 8, inside the identity 6.  The whole
    query as the name adds 120, as its start 70, inside it 35; as the model 90,
    as its start 50.
    """
    fields = {"q": query, "n": name, "b": brand, "m": model, "c": category, "i": identity}
    return let(F.struct(*[T.normalize_text(v).alias(k) for k, v in fields.items()]), _relevance)


def _relevance(t: Column) -> Column:
    q, n, b, m, c, i = (t[k] for k in "qnbmci")
    whole = F.concat_ws(" ", n, b, m, c, i)
    words = F.split(q, " ")

    def worth(w: Column) -> Column:
        return (
            F.when(w == b, 42).when(w == m, 40).when(_has_word(b, w), 34).when(_has_word(m, w), 32).when(_has_word(n, w), 24)
            .when(_has_word(i, w), 20).when(_has_word(c, w), 12).when(n.contains(w), 8).when(i.contains(w), 6).otherwise(0)
        )

    total = F.aggregate(words, F.lit(0), lambda acc, w: acc + worth(w))
    total = total + F.when(n == q, 120).when(n.startswith(q), 70).when(n.contains(q), 35).otherwise(0)
    total = total + F.when(m == q, 90).when(m.startswith(q), 50).otherwise(0)
    return F.when(q == "", 1).when(F.exists(words, lambda w: ~whole.contains(w)), 0).otherwise(total)


def smart_rank(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates that meet what the query demands, with `score` and `semantic_score` (0 to 100).

    Reads name, brand, category, price, offers, ram_gb, storage_gb, attributes
    (text), relevance.  Category, prices, memory, disk, graphics and network
    are demands; the brand and the refresh rate only move the score.
    """
    asked = parsed_once(candidates.sparkSession, query)
    folded = {f"_{c}": T.normalize_query(F.col(c)) for c in ("name", "brand", "category", "attributes")}
    rows = candidates.withColumns(folded)
    name, brand, category = F.col("_name"), F.col("_brand"), F.col("_category")
    hay = F.concat_ws(" ", *folded)
    compact = F.regexp_replace(hay, "[^a-z0-9]", "")
    holds = lambda f: F.coalesce(hay.contains(asked[f]) | compact.contains("".join(ch for ch in asked[f] if ch.isascii() and ch.isalnum())), F.lit(False))
    demands = {
        "category": lambda v: category.contains(v) | name.contains(v), "price_min": lambda v: F.col("price") >= v, "price_max": lambda v: F.col("price") <= v, "ram_gb": lambda v: F.col("ram_gb") == v,
        "storage_gb": lambda v: F.col("storage_gb") == v, "gpu": lambda v: holds("gpu_text"), "network": lambda v: holds("network"),
    }
    won = {"category": 28, "ram_gb": 24, "storage_gb": 24, "gpu": 32, "network": 20}
    ok, score = F.lit(True), F.col("relevance").cast("double")
    for field, met in demands.items():
        if asked[field] is not None:
            ok = ok & F.coalesce(met(asked[field]), F.lit(False))
            score = score + won.get(field, 0)
    if asked["brand"] is not None:
        score = score + F.when(brand.contains(asked["brand"]) | name.contains(asked["brand"]), 22).otherwise(-12)
    if asked["refresh_hz"] is not None:
        score = score + F.when(holds("refresh_text"), 16).otherwise(-6)
    if asked["purpose"] == "gaming":
        score = score + F.when(hay.rlike("rtx|gtx|rx|gaming|oyuncu"), 14).otherwise(0)
    elif asked["purpose"] == "student" and asked["category"] in ("laptop", "tablet"):
        score = score + 8
    elif asked["purpose"] == "best_value":
        score = score + F.least(F.lit(12), F.col("offers") * 3)
    whole = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(score))).cast("int")
    return rows.where(ok).withColumns({"score": score, "semantic_score": whole}).drop(*folded)


def parsed_once(spark: SparkSession, query: str) -> dict:
    """`parse_query` of one text as a plain dict, from one row, with the folded text of what is looked for in words."""
    p = F.col("p")
    row = spark.range(1).select(parse_query(F.lit(query)).alias("p")).select("p.*", T.normalize_query(p["gpu"]).alias("gpu_text"), F.concat(p["refresh_hz"].cast("string"), F.lit("hz")).alias("refresh_text"))
    return row.first().asDict()


def like_all(words: list[str], columns: list[str]) -> Column:
    """Every word (two letters or more, eight at most, the rule's own bound) stands in one of the columns, case folded."""
    ok = F.lit(True)
    for w in [w for w in words if len(w) >= 2][:8]:
        one = F.lit(False)
        for c in columns:
            one = one | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w.lower())
        ok = ok & one
    return ok


def in_choice(c: Column, chosen: list[str]) -> Column:
    """Among the chosen values, folded; no choice passes all."""
    wanted = [v for v in chosen if v.strip()]
    return F.lit(True) if not wanted else T.normalize_text(c).isin(*[T.normalize_text(F.lit(v)) for v in wanted])


def attribute_filter(attributes: Column, chosen: dict[str, list[str]]) -> Column:
    """Every chosen key of a map has one of its chosen values."""
    ok = F.lit(True)
    for key, values in chosen.items():
        wanted = [v.strip().lower() for v in values if v.strip()]
        if wanted:
            ok = ok & F.lower(F.trim(F.coalesce(F.try_element_at(attributes, F.lit(key)), F.lit("")))).isin(*wanted)
    return ok


def facets(candidates: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """facet, value, n of each column's values, all in one pass; with ``top`` the most frequent ones of a facet, ties by value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    n = candidates.select(pairs.alias("p")).where("p.value is not null and p.value <> ''").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return _top(n, top) if top else n


def _top(n: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


#: Attributes that a category's filters offer (fixed values).
CATEGORY_FILTERS = {
    "laptop": ("processor", "cpu", "gpu", "graphics", "screen", "display", "panel", "refresh_rate", "operating_system"),
    "telefon": ("network", "nfc", "esim", "wireless_charging", "camera", "battery", "color"),
    "monitor": ("screen", "display", "panel", "refresh_rate", "resolution", "hdr", "color"),
    "televizyon": ("screen", "display", "panel", "refresh_rate", "resolution", "hdr", "smart_tv"),
    "tablet": ("network", "screen", "display", "battery", "color"),
}


def dynamic_facets(candidates: DataFrame, categories: list[str], top: int = 20) -> DataFrame:
    """facet, value, n of the map `attributes`, for the attributes that the chosen categories offer (none chosen: all)."""
    allowed = sorted({a for c in categories or CATEGORY_FILTERS for a in CATEGORY_FILTERS.get(c, ())})
    rows = candidates.select(F.explode("attributes").alias("facet", "value")).where(F.col("facet").isin(*allowed) & (F.trim("value") != ""))
    return _top(rows.groupBy("facet", F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n")), top)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 24) -> DataFrame:
    """One page of a sorted list (the feature is the limit); numbers under 1 are page 1."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_items(current: Column, total: Column) -> Column:
    """The page numbers a pager shows: first, last, and two to each side of the current one."""
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: current + d)
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(1), total), near), lambda p: (p >= 1) & (p <= total))))


def encode_cursor(product_id: int) -> str:
    """A page's cursor: base64url of compact JSON, without padding."""
    raw = json.dumps({"id": product_id}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The id a cursor stands for; 0 for none or a damaged one."""
    try:
        return max(0, int(json.loads(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)))["id"]))
    except (ValueError, KeyError, TypeError):
        return 0


def cursor_of(c: Column) -> Column:
    """`encode_cursor` of an id column."""
    raw = F.base64(F.encode(F.concat(F.lit('{"id":'), c.cast("string"), F.lit("}")), "UTF-8"))
    return F.rtrim(F.translate(raw, "+/", "-_"), F.lit("="))


def keyset_page(rows: DataFrame, id_col: str, cursor: str | None = None, size: int = 24) -> DataFrame:
    """The page after a cursor, by id, with `has_more` and `next_cursor` on each row (the feature is the limit).

    One row more than the page is read to know whether another follows; only
    the page's rows are sorted.
    """
    more = rows.where(F.col(id_col) > decode_cursor(cursor)).orderBy(id_col).limit(size + 1)
    whole = Window.partitionBy()  # size + 1 rows at most
    marked = more.withColumns({"_n": F.row_number().over(Window.orderBy(id_col)), "_all": F.count(F.lit(1)).over(whole)})
    last = F.max(F.when(F.col("_n") <= size, F.col(id_col))).over(whole)
    out = marked.withColumns({"has_more": F.col("_all") > size, "next_cursor": F.when(F.col("_all") > size, cursor_of(last))})
    return out.where(F.col("_n") <= size).drop("_n", "_all")


def autocomplete(products: DataFrame, query: str, top: int = 8) -> DataFrame:
    """kind, name, score of the suggestions for a query (the feature is the limit), distinct names, best first.

    A name's score is its sequence ratio to the query, .6 more if the query
    stands in it, .45 at least; templates of a named category or graphics card
    score 2.
    """
    spark = products.sparkSession
    q = spark.range(1).select(parse_query(F.lit(query)).alias("q"))
    card = F.filter(F.array(
        F.concat(F.col("q.category"), F.lit(" fiyat performans")), F.concat(F.lit("30 bin altı "), F.col("q.category")),
        F.concat(F.col("q.gpu"), F.lit(" laptop")), F.concat(F.col("q.gpu"), F.lit(" fiyat performans laptop")),
    ), lambda t: t.isNotNull())
    templates = q.select(F.posexplode(card).alias("place", "name")).select(F.lit("query").alias("kind"), "name", F.lit(2.0).alias("score"), "place")
    asked = parsed_once(spark, query)["normalized"]
    named = products.select("name").distinct().withColumn("norm", T.normalize_query(F.col("name")))
    # a ratio is at most twice the letters in common over all letters, so most names need none
    letters = {ch: asked.count(ch) for ch in sorted(set(asked))}
    shared = sum((F.least(F.length("norm") - F.length(F.replace("norm", F.lit(ch), F.lit(""))), F.lit(n)) for ch, n in letters.items()), F.lit(0))
    near = F.col("norm").contains(asked) | (2 * shared >= 0.45 * (F.length("norm") + len(asked)))
    ratio = seq_ratio(F.lit(asked), F.col("norm")) + F.when(F.col("norm").contains(asked), 0.6).otherwise(0.0)
    scored = named.where(near).select("name", ratio.alias("score")).where("score >= 0.45")
    found = scored.select(F.lit("product").alias("kind"), "name", "score", F.lit(0).alias("place"))
    return templates.unionByName(found).orderBy(F.desc("score"), "kind", "place", "name").limit(top).drop("place")
