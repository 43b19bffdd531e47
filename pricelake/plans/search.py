"""Search queries over the device catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import offers as O
from pricelake.operators import scoring as S
from pricelake.operators import search as R
from pricelake.sources.listings import DEVICE, SQL_DEVICES
from pricelake.sources.tables import SQL_CUR, current_offers, products, read

#: The queries and filters of the registered searches (parameters of the operators).
TEXT_QUERY = "Samsung Galaxy S2"
SMART_QUERY = "akıllı telefon samsng 256 gb 8 gb ram 50 bin tl altı 5g"
FILTERS = {"brand": ["SAMSUNG", "apple"], "price": (0.0, 40_000.0), "attributes": {"color": ["siyah", "mavi"]}}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with their offers: product_id, name, brand, model, category, identity, ram_gb, storage_gb, attributes (map), price, old_price, offers, members, updated_at."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    dev = rows.selectExpr("*", *[f"{sql} AS {name}" for name, sql in DEVICE.items()])
    o = current_offers(spark, sf_dir).where(O.serving())
    best = o.groupBy("product_id").agg(F.min("price").alias("price"), F.max("old_price").alias("old_price"), F.count(F.lit(1)).alias("offers"), F.max("seen_at").alias("updated_at"))
    model = F.trim(F.concat_ws(" ", "model", "variant"))
    category = F.when(F.col("kind") == "phone", "Cep Telefonu").when(F.col("kind") == "tablet", "Tablet").otherwise("Kulaklık")
    dev = dev.select(
        F.col("k").alias("product_id"), F.concat_ws(" ", "brand", model, F.concat(F.col("storage"), F.lit(" GB"))).alias("name"), "brand", model.alias("model"), category.alias("category"),
        F.concat(F.lit("identity_v3:color="), F.lower("color")).alias("identity"), F.col("ram").alias("ram_gb"), F.col("storage").alias("storage_gb"),
        F.map_from_arrays(F.array(F.lit("color"), F.lit("network")), F.array("color", "network")).alias("attributes"),
    )
    return dev.join(best, "product_id").withColumn("members", F.col("offers"))


def _relevant(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    return rows.withColumn("relevance", R.relevance(F.lit(query), *[F.col(c) for c in ("name", "brand", "model", "category", "identity")])).where("relevance > 0")


def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products with every word of the query, by field weights."""
    return _relevant(spark, sf_dir, TEXT_QUERY).select("product_id", "name", F.col("relevance").cast("int").alias("relevance"))


def smart_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that meet all demands of a query in words."""
    rows = catalog(spark, sf_dir).withColumns({"relevance": F.lit(10), "attributes": F.concat_ws(" ", F.map_values("attributes"))})
    return R.smart_rank(rows, SMART_QUERY).select("product_id", F.col("score").cast("int").alias("score"), "semantic_score")


def query_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as users write them, one a device, and what they ask for."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).selectExpr("*", *[f"{sql} AS {name}" for name, sql in DEVICE.items()])
    asked = F.concat_ws(" ", F.concat(F.col("k") % 90 + 10, F.lit(" bin TL altı")), F.col("model"), F.concat(F.col("ram"), F.lit(" GB RAM")), F.concat(F.col("storage"), F.lit("GB")), "network", F.when(F.col("kind") == "tablet", "tablet oyun"))
    p = R.parse_query(asked)
    return rows.select("k", *[p[f].alias(f) for f in ("category", "brand", "purpose", "price_max", "ram_gb", "storage_gb", "network")])


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static facets of the search's candidates before any filter."""
    return R.facets(_relevant(spark, sf_dir, TEXT_QUERY).withColumn("storage", F.col("storage_gb")), ["brand", "category", "storage", "ram_gb"])


def dynamic_facets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes that telephones and tablets are filtered by, 20 values each."""
    return R.dynamic_facets(catalog(spark, sf_dir), ["telefon", "tablet"])


def search_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, price and attribute filters, the best value first, second page (the feature is the limit)."""
    lo, hi = FILTERS["price"]
    rows = _relevant(spark, sf_dir, "galaxy")
    rows = S.sort_metrics(rows).where(R.in_choice(F.col("brand"), FILTERS["brand"]) & F.col("price").between(lo, hi) & R.attribute_filter(F.col("attributes"), FILTERS["attributes"]))
    return R.page(rows, [*S.sort_order("best_value"), F.col("product_id")], 2).select("product_id", "best_value_score", "price")


def sorted_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each of the eight orders (the feature is the limit)."""
    rows = S.sort_metrics(_relevant(spark, sf_dir, "galaxy"))
    out = None
    for mode in ("relevance", "price_asc", "price_desc", "stores", "price_drop", "popular", "best_value", "newest"):
        top = R.page(rows, [*S.sort_order(mode), F.col("product_id")], 1, 3).select(F.lit(mode).alias("mode"), "product_id")
        out = top if out is None else out.unionByName(top)
    return out


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of products after a cursor (the feature is the limit)."""
    return R.keyset_page(products(spark, sf_dir).select("product_id", "name", "brand"), "product_id", R.encode_cursor(100))


def token_like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose name, brand or category hold every word; and those whose name or category match a pattern."""
    rows = products(spark, sf_dir)
    both = R.like_all(["ring", "small"], ["name", "brand", "category"])
    any_ = F.col("name").ilike("%RING%") | F.col("category").ilike("%TIN%")
    return rows.where(both | any_).select("product_id", both.alias("all_words"), any_.alias("pattern"))


def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.autocomplete(catalog(spark, sf_dir), "galaxy s21 telefon")


QUERIES = {f.__name__: f for f in (
    search_relevance, smart_search, query_log_parse, facet_counts, dynamic_facets_topk, search_filtered_page, sorted_tops, keyset_page, token_like_search, autocomplete,
)}

_CAT = f"""{SQL_DEVICES}, bst AS (SELECT product_id, min(price) AS price, max(old_price) AS old_price, count(*) AS offers, max(seen_at) AS updated_at FROM cur WHERE lifecycle = 'ACTIVE' AND NOT hidden AND price > 0 GROUP BY product_id),
cat AS (SELECT k AS product_id, brand || ' ' || trim(model || ' ' || variant) || CASE WHEN storage IS NULL THEN '' ELSE ' ' || storage || ' GB' END AS name, brand, trim(model || ' ' || variant) AS model,
        CASE kind WHEN 'phone' THEN 'cep telefonu' WHEN 'tablet' THEN 'tablet' ELSE 'kulaklik' END AS category, 'identity v3 color ' || lower(color) AS identity, ram AS ram_gb, storage AS storage_gb, color, network,
        bst.price, old_price, offers, updated_at FROM dev JOIN bst ON product_id = k)"""


def _rel(query: str) -> str:
    """SQL of the relevance of ``cat`` rows, word by word."""
    words = query.lower().split()
    n, b, m, c, i = "lower(name)", "lower(brand)", "lower(model)", "category", "identity"
    has = lambda f, w: f"contains(' ' || {f} || ' ', ' {w} ')"
    worth = " + ".join(
        f"CASE WHEN {b} = '{w}' THEN 42 WHEN {m} = '{w}' THEN 40 WHEN {has(b, w)} THEN 34 WHEN {has(m, w)} THEN 32 WHEN {has(n, w)} THEN 24 WHEN {has(i, w)} THEN 20 WHEN {has(c, w)} THEN 12 WHEN contains({n}, '{w}') THEN 8 WHEN contains({i}, '{w}') THEN 6 ELSE 0 END"
        for w in words
    )
    q = " ".join(words)
    whole = f"CASE WHEN {n} = '{q}' THEN 120 WHEN starts_with({n}, '{q}') THEN 70 WHEN contains({n}, '{q}') THEN 35 ELSE 0 END + CASE WHEN {m} = '{q}' THEN 90 WHEN starts_with({m}, '{q}') THEN 50 ELSE 0 END"
    ok = " AND ".join(f"contains({n} || ' ' || {b} || ' ' || {m} || ' ' || {c} || ' ' || {i}, '{w}')" for w in words)
    return f"CASE WHEN {ok} THEN {worth} + {whole} ELSE 0 END"


_METRICS = """m0 AS (SELECT *, min(price) OVER () AS lo, max(price) OVER () AS hi, CASE WHEN old_price > price THEN (old_price - price) / old_price * 100 ELSE 0.0 END AS dr, least(100.0, relevance::DOUBLE) AS rl FROM r),
met AS (SELECT *, floor(dr * 100 + 0.5) / 100 AS price_drop_percent, floor(least(100.0, offers * 12.0 + offers * 2.0 + rl * 0.35) * 100 + 0.5) / 100 AS popularity_score,
        floor((rl * 0.40 + CASE WHEN hi > lo THEN (hi - price) / greatest(hi - lo, 1.0) * 100 ELSE 50.0 END * 0.35 + least(100.0, offers * 18.0) * 0.15 + least(dr * 3.0, 100.0) * 0.10) * 100 + 0.5) / 100 AS best_value_score FROM m0)"""
_ORDERS = {
    "relevance": "relevance DESC, offers DESC, price, lower(name)", "price_asc": "price, lower(name)", "price_desc": "price DESC, lower(name)", "stores": "offers DESC, relevance DESC, lower(name)",
    "price_drop": "price_drop_percent DESC, price, lower(name)", "popular": "popularity_score DESC, offers DESC, lower(name)", "best_value": "best_value_score DESC, price, lower(name)", "newest": "updated_at DESC, lower(name)",
}
_RELEVANT = lambda q: f"WITH {SQL_CUR}, {_CAT}, r AS (SELECT *, {_rel(q)} AS relevance FROM cat WHERE {_rel(q)} > 0)"

SQL = {
    "search_relevance": _RELEVANT(TEXT_QUERY) + " SELECT product_id, name, relevance::INTEGER AS relevance FROM r",
    "smart_search": f"""WITH {SQL_CUR}, {_CAT} SELECT product_id, (10 + 28 + 24 + 24 + 20 + CASE WHEN brand = 'Samsung' THEN 22 ELSE -12 END)::INTEGER AS score, least(100, 10 + 28 + 24 + 24 + 20 + CASE WHEN brand = 'Samsung' THEN 22 ELSE -12 END)::INTEGER AS semantic_score
        FROM cat WHERE category = 'cep telefonu' AND storage_gb = 256 AND ram_gb = 8 AND price <= 50000 AND network = '5G'""",
    "query_log_parse": f"""WITH {SQL_DEVICES} SELECT k, CASE WHEN brand = 'Apple' THEN 'telefon' WHEN kind = 'tablet' THEN 'tablet' END AS category, lower(brand) AS brand, CASE WHEN kind = 'tablet' THEN 'gaming' END AS purpose,
        (k % 90 + 10) * 1000.0::DOUBLE AS price_max, ram AS ram_gb, CASE WHEN storage > 64 THEN storage END AS storage_gb, CASE WHEN network = '5G' THEN '5g' END AS network FROM dev""",
    "facet_counts": _RELEVANT(TEXT_QUERY)
    + """, raw AS (SELECT *, CASE category WHEN 'cep telefonu' THEN 'Cep Telefonu' WHEN 'tablet' THEN 'Tablet' ELSE 'Kulaklık' END AS shown FROM r)
        SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM raw GROUP BY brand UNION ALL SELECT 'category', shown, count(*) FROM raw GROUP BY shown
        UNION ALL SELECT 'storage', storage_gb::VARCHAR, count(*) FROM raw WHERE storage_gb IS NOT NULL GROUP BY storage_gb UNION ALL SELECT 'ram_gb', ram_gb::VARCHAR, count(*) FROM raw WHERE ram_gb IS NOT NULL GROUP BY ram_gb""",
    "dynamic_facets_topk": f"""WITH {SQL_CUR}, {_CAT}, n AS (SELECT 'color' AS facet, color AS value, count(*) AS n FROM cat GROUP BY color UNION ALL SELECT 'network', network, count(*) FROM cat WHERE network <> '' GROUP BY network)
        SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 20""",
    "search_filtered_page": _RELEVANT("galaxy")
    + f""", {_METRICS} SELECT product_id, best_value_score, price FROM met WHERE lower(brand) IN ('samsung', 'apple') AND price BETWEEN 0 AND 40000 AND lower(color) IN ('siyah', 'mavi')
        ORDER BY {_ORDERS['best_value']}, product_id LIMIT 24 OFFSET 24""",
    "sorted_tops": _RELEVANT("galaxy") + f", {_METRICS} " + " UNION ALL ".join(f"(SELECT '{k}' AS mode, product_id FROM met ORDER BY {o}, product_id LIMIT 3)" for k, o in _ORDERS.items()),
    "keyset_page": """WITH m AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, row_number() OVER (ORDER BY p_partkey) AS n, count(*) OVER () AS total FROM part WHERE p_partkey > 100)
        SELECT product_id, name, brand, total > 24 AS has_more, CASE WHEN total > 24 THEN rtrim(translate(base64(encode('{"id":' || (SELECT product_id FROM m WHERE n = 24) || '}')), '+/', '-_'), '=') END AS next_cursor FROM m WHERE n <= 24""",
    "token_like_search": """WITH w AS (SELECT *, lower(p_name || ' ' || p_brand || ' ' || p_type) AS hay FROM part), x AS (SELECT p_partkey AS product_id, contains(hay, 'ring') AND contains(hay, 'small') AS all_words,
        p_name ILIKE '%RING%' OR p_type ILIKE '%TIN%' AS pattern FROM w) SELECT * FROM x WHERE all_words OR pattern""",
}
