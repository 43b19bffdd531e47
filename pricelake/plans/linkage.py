"""Identities of listings and how they are linked: parsing, keys, confidence, gates, category matches, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.functions import identity as I
from pricelake.functions import text as T
from pricelake.operators import groups as G
from pricelake.operators import linkage as L
from pricelake.sources.listings import SQL_LISTINGS, listings
from pricelake.sources.staged import staged


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return rows.withColumn("p", I.parse(F.col("title"), F.col("brand"), F.col("category")))


def identity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listing's title says."""
    p = F.col("p")
    fields = ("brand", "family", "variant", "ram_gb", "storage_gb", "color", "network", "model_code", "kind")
    return _parsed(spark, sf_dir).select("listing_id", *[p[f].alias(f) for f in fields], I.identity_source(p).alias("identity_source"))


def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that share an identity key."""
    rows = _parsed(spark, sf_dir).select("listing_id", I.identity_source(F.col("p")).alias("source"), "price")
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("listings"), F.min("listing_id").alias("first_id"), F.min("price").alias("best_price"))
    return out.select(T.identity_key(F.col("source")).alias("identity_key"), "listings", "first_id", "best_price")


def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the titles tell: listings by confidence and class."""
    rows = _parsed(spark, sf_dir).select(I.confidence(F.col("p")).alias("confidence"))
    return rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("listings")).withColumn("class", I.confidence_class(F.col("confidence")))


def variant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of each identity: listings and least price, by price."""
    rows = _parsed(spark, sf_dir).select(I.key_of(F.col("p")).alias("identity_key"), I.variant_key(F.col("p")).alias("variant_key"), "price")
    out = rows.groupBy("identity_key", "variant_key").agg(F.count(F.lit(1)).alias("listings"), F.min("price").alias("best_price"))
    order = Window.partitionBy("identity_key").orderBy("best_price", "variant_key")
    return out.withColumn("place", F.row_number().over(order))


def _folded(parsed: DataFrame, copy: int) -> DataFrame:
    """The distinct identities of one copy of the listings."""
    rows = parsed.where(F.col("copy") == copy)
    return rows.groupBy("p").agg(F.min("listing_id").alias("id"), F.max("title").alias("title"), F.min("price").alias("price"), F.min("category").alias("category"))


def category_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing of one copy against its product's listing of the other, by the matcher of its category."""
    rows = _parsed(spark, sf_dir).select("product_id", "copy", "p", "price", T.normalize_token(F.col("title")).alias("text"))
    a, b = (rows.where(F.col("copy") == c).select("product_id", *[F.col(n).alias(f"{n}_{c}") for n in ("p", "price", "text")]) for c in (0, 1))
    m = L.category_match(F.col("p_0"), F.col("p_1"), F.col("price_1"), F.col("text_0"), F.col("text_1"))
    return a.join(b, "product_id").select("product_id", m.alias("m")).select("product_id", "m.matcher", "m.score")


def _incoming(parsed: DataFrame) -> DataFrame:
    """Identities of copy 1; a third with another disk, a third with a longer family, so that every decision occurs."""
    third = F.col("id") % 3
    rows = _folded(parsed, 1)
    p = F.col("p").withField("storage_gb", F.when(third == 1, 1024).otherwise(F.col("p.storage_gb")))
    p = p.withField("family", F.when(third == 2, F.concat(F.col("p.family"), F.lit(" x9"))).otherwise(F.col("p.family")))
    p = p.withField("model_code", F.when(third == 2, "").otherwise(F.col("p.model_code")))
    return rows.select(F.col("id").alias("incoming_key"), p.alias("p"), "category").withColumn("identity_key", I.key_of(F.col("p")))


def link_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with each distinct incoming identity."""
    rows = staged(_parsed(spark, sf_dir), "parsed")
    catalog = _folded(rows, 0).select(F.col("id").alias("candidate_id"), F.col("p").alias("q"), I.key_of(F.col("p")).alias("identity_key"))
    return L.decide(_incoming(rows), catalog)


def group_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best group of each distinct incoming identity among all groups of its brand and category, its score, the second one's, and the confidence."""
    rows = staged(_parsed(spark, sf_dir), "parsed")
    groups = _folded(rows, 0).select(F.col("id").alias("candidate_id"), F.col("p").alias("q"), "category")
    return G.best_groups(_incoming(rows), groups)


def seller_and_store_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of stores as shops write them, folded, and store codes by name and by address."""
    from pricelake.sources.tables import stores

    name = F.concat_ws(" ", F.col("store"), F.element_at(F.array(F.lit("LTD"), F.lit("Mağazası"), F.lit("A.Ş."), F.lit("Store")), (F.col("store_id") % 4 + 1).cast("int")))
    shop = F.element_at(F.array(F.lit("Trendyol"), F.lit("www.hepsiburada.com"), F.lit("Çiçek Sepeti"), F.lit("Bakkal")), (F.col("store_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://"), F.element_at(F.array(F.lit("www.n11.com"), F.lit("amazon.com.tr"), F.lit("shop.example.org")), (F.col("store_id") % 3 + 1).cast("int")), F.lit("/p/"), F.col("store_id"))
    return stores(spark, sf_dir).select("store_id", T.normalize_seller(name).alias("seller"), T.store_code(shop).alias("code"), T.store_of_url(url).alias("url_code"))


QUERIES = {f.__name__: f for f in (
    identity_parse, identity_groups, identity_audit, variant_rollup, category_matches, link_decisions, group_matches, seller_and_store_names,
)}

_FAMILY = "lower(CASE WHEN kind = 'audio' AND variant <> '' THEN model || ' ' || variant ELSE model END)"
_VARIANT = "lower(CASE WHEN kind = 'audio' THEN '' ELSE variant END)"
_COLOR = "lower(color)"
_P = f"""p AS (SELECT *, lower(brand) AS b, {_FAMILY} AS f, {_VARIANT} AS v, {_COLOR} AS c, lower(network) AS n,
    CASE WHEN {_VARIANT} = '' THEN {_FAMILY} ELSE {_FAMILY} || '-' || {_VARIANT} END AS code FROM lst),
src AS (SELECT *, 'identity_v3:brand=' || b || '|family=' || f || CASE WHEN v = '' THEN '' ELSE '|variant=' || v END
    || CASE WHEN kind = 'tablet' THEN '|ram=' || ram || 'gb' ELSE '' END || CASE WHEN storage IS NULL THEN '' ELSE '|storage=' || storage || 'gb' END
    || CASE WHEN kind = 'phone' AND n = '5g' THEN '|network=5g' ELSE '' END AS source FROM p)"""
_KEY = "substring(sha256(source), 1, 32)"
_VKEY = "'color=' || c || CASE WHEN n = '' THEN '' ELSE '|network=' || n END || '|model_code=' || code"

SQL = {
    "identity_parse": f"WITH {SQL_LISTINGS}, {_P} SELECT listing_id, b AS brand, f AS family, v AS variant, ram AS ram_gb, storage AS storage_gb, c AS color, n AS network, code AS model_code, kind, source AS identity_source FROM src",
    "identity_groups": f"WITH {SQL_LISTINGS}, {_P} SELECT {_KEY} AS identity_key, count(*) AS listings, min(listing_id) AS first_id, min(price) AS best_price FROM src GROUP BY source",
    "identity_audit": f"""WITH {SQL_LISTINGS}, {_P}, c AS (SELECT 18 + 22 + 28 + CASE WHEN v = '' THEN 0 ELSE 7 END + 10 + CASE WHEN storage IS NULL THEN 0 ELSE 8 END + CASE WHEN ram IS NULL THEN 0 ELSE 5 END AS confidence FROM src)
        SELECT confidence::INTEGER AS confidence, count(*) AS listings, CASE WHEN confidence >= 80 THEN 'strong' WHEN confidence >= 58 THEN 'review' ELSE 'weak' END AS class FROM c GROUP BY confidence""",
    "variant_rollup": f"""WITH {SQL_LISTINGS}, {_P}, g AS (SELECT {_KEY} AS identity_key, {_VKEY} AS variant_key, count(*) AS listings, min(price) AS best_price FROM src GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY best_price, variant_key)::INTEGER AS place FROM g""",
    "category_matches": f"WITH {SQL_LISTINGS} SELECT k AS product_id, kind AS matcher, CASE kind WHEN 'phone' THEN 0.98 WHEN 'tablet' THEN 0.99 ELSE 0.995 END::DOUBLE AS score FROM dev",
    "seller_and_store_names": """SELECT s_suppkey AS store_id, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') || CASE s_suppkey % 4 WHEN 2 THEN ' a s' ELSE '' END, ' +', ' ', 'g')) AS seller,
        CASE s_suppkey % 4 WHEN 0 THEN 'trendyol' WHEN 1 THEN 'hepsiburada' WHEN 2 THEN 'ciceksepeti' END AS code, CASE s_suppkey % 3 WHEN 0 THEN 'n11' WHEN 1 THEN 'amazon' ELSE 'shop' END AS url_code FROM supplier""",
}
