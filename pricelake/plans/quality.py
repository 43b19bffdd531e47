"""Quality, integrity and convergence queries.

The driver's tables have no gaps, so records get some by rule: what a key is
divisible by decides which field is missing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import history as H
from pricelake.operators import merge as M
from pricelake.operators import offers as O
from pricelake.operators import quality as Q
from pricelake.plans.scoring import AGE_SCALE, detailed_offers
from pricelake.sources.tables import NOW, SQL_CUR, SQL_OBS, current_offers, observations, products, read, stores


def _missing(c: str, every: int, column) -> F.Column:
    return F.when(F.col(c) % every != 0, column)


def product_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = observations(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("history_count"))
    p, k = products(spark, sf_dir), "product_id"
    rows = p.select(
        "product_id", "name", _missing(k, 17, F.col("brand")).alias("brand"), _missing(k, 5, F.col("size").cast("string")).alias("model"), F.lit(None).cast("string").alias("product_code"),
        _missing(k, 23, F.col("category")).alias("category"), _missing(k, 3, F.lit("{}")).alias("specifications"), (F.col("size") % 4).alias("images"), (F.col(k) % 11 == 0).alias("broken_images"),
        F.when(F.col(k) % 29 == 0, 0.0).otherwise(F.col("list_price")).alias("price"), (F.col("list_price") * (1 + F.col(k) % 12)).alias("old_price"), (F.col(k) % 100).alias("score"),
    )
    return rows.join(n, "product_id", "left").fillna(0, ["history_count"])


def product_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's quality of 100 and the checks it fails."""
    rows = product_records(spark, sf_dir).select("product_id", Q.product_quality().alias("quality"), Q.product_issues().alias("issues"))
    return rows.select("product_id", "quality", Q.quality_level(F.col("quality")).alias("level"), F.array_join("issues", ",").alias("issues"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many products fail each check, with the mean quality of those."""
    rows = product_records(spark, sf_dir).select(Q.product_quality().alias("quality"), F.explode(Q.product_issues()).alias("issue"))
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("products"), F.sum("quality").cast("bigint").alias("quality_sum"), F.count_if(F.col("quality") < 45).alias("weak"))


def _offers_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "order_id"
    named = stores(spark, sf_dir).select("store_id", "store")
    rows = detailed_offers(spark, sf_dir).join(named, "store_id").join(products(spark, sf_dir).select("product_id", "brand"), "product_id")
    seen = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.timestamp_diff("SECOND", "seen_at", F.lit(NOW).cast("timestamp_ntz")) / AGE_SCALE)
    return rows.withColumns({
        "seller": _missing(k, 13, F.col("store")), "url": F.when(F.col(k) % 19 == 0, "ftp:/x").otherwise("https://shop.example/p"), "availability": _missing(k, 7, F.lit("stokta")), "shipping_method": F.lit(None).cast("string"),
        "warranty_type": _missing(k, 2, F.lit("2y")), "installment_text": _missing(k, 3, F.lit("3x")), "campaign_text": _missing(k, 5, F.lit("sepette")), "image": _missing(k, 11, F.lit("i")), "model": F.lit("m"),
        "brand": _missing("product_id", 17, F.col("brand")), "seen_at": seen,
    })


def offer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each current offer lacks, and its completeness of 100."""
    rows = _offers_with_gaps(spark, sf_dir).withColumn("issues", Q.offer_issues(F.lit(NOW).cast("timestamp_ntz")))
    return rows.select("product_id", "store_id", F.array_join(F.col("issues.code"), ",").alias("issues"), Q.completeness(F.col("issues")).alias("completeness"), Q.health_bucket(Q.completeness(F.col("issues")), F.col("issues")).alias("bucket"))


def offer_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.health_by_store(_offers_with_gaps(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


def listing_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by the first rule they break."""
    k = F.col("product_id")
    p = products(spark, sf_dir)
    name = F.when(k % 7 == 0, "ab").when(k % 31 == 0, F.repeat(F.lit("x"), F.lit(600))).otherwise(F.col("name"))
    price = F.when(k % 5 == 0, "n/a").when(k % 11 == 0, "-3").when(k % 13 == 0, "1e12").otherwise(F.col("list_price").cast("string"))
    url = F.when(k % 3 == 0, "javascript:x").otherwise("http://shop.example/1")
    return p.select(F.coalesce(Q.listing_fault(name, price, url), F.lit("valid")).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("listings"))


def counter_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counters (wrong for every tenth product) against a recount."""
    raw = observations(spark, sf_dir).select("product_id")
    shown = current_offers(spark, sf_dir).where(O.serving()).select("product_id")
    of = lambda df, n: df.groupBy("product_id").agg(F.count(F.lit(1)).alias(n))
    stored = products(spark, sf_dir).select("product_id").join(of(raw, "raw_count"), "product_id", "left").join(of(shown, "offer_count"), "product_id", "left")
    stored = stored.withColumn("raw_count", F.when(F.col("product_id") % 10 == 0, F.coalesce("raw_count", F.lit(0)) + 1).otherwise(F.col("raw_count")))
    return Q.rebuilt_counters(stored, raw, shown)


def quarantine_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the price audit quarantines is neither active nor shown."""
    o = current_offers(spark, sf_dir).select("product_id", "store_id", "price", "hidden")
    judged = H.quarantine(o).select("product_id", "store_id", "status").join(o, ["product_id", "store_id"])
    rows = judged.select("product_id", "store_id", F.col("status").alias("lifecycle"), (~F.col("hidden")).alias("active"), "hidden")
    return Q.quarantine_convergence(rows).select("product_id", "store_id", "lifecycle", "active", "hidden", "changed")


def restored_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh hid every shown offer of stores 0 to 4 by mistake (store % 3 = 0 failed): those come back."""
    o = current_offers(spark, sf_dir).select((F.col("product_id") * 100_000 + F.col("store_id")).alias("offer_id"), "store_id", "product_id", (~F.col("hidden")).alias("active"))
    before = o.where("active").select("offer_id")
    after = o.withColumns({"active": F.col("active") & (F.col("store_id") > 4), "hidden": F.lit(True)})
    out = Q.restored_offers(after, before, stores(spark, sf_dir).where("store_id % 3 = 0").select("store_id"))
    return out.groupBy("store_id").agg(F.count_if("restored").alias("restored"), F.count_if("active").alias("active"))


def offer_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations as offers: which products serve more than one a store, and whether the stored count fits."""
    o = observations(spark, sf_dir).select("product_id", "store_id", O.serving().alias("active"))
    stored = current_offers(spark, sf_dir).where(O.serving()).groupBy("product_id").agg(F.count(F.lit(1)).alias("offer_count"))
    return Q.reliability(o, products(spark, sf_dir).select("product_id").join(stored, "product_id", "left").fillna(0, ["offer_count"]))


def invariant_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row evidence of violated checks only: orders without lines, products without offers, repeated (product, store), suppliers in debt, parts without a name."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("id")).where("n > 1")
    return Q.evidence({
        "orders_without_lines": o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id")),
        "repeated_pairs": pairs.select("id"), "stores_in_debt": stores(spark, sf_dir).where("balance < 0").select(F.col("store_id").alias("id")),
        "nameless_products": products(spark, sf_dir).where(F.trim("name") == "").select(F.col("product_id").alias("id")),
    })


def release_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that decide a release, and the verdict."""
    obs = observations(spark, sf_dir)
    cur = current_offers(spark, sf_dir)
    p = products(spark, sf_dir)
    shown = cur.groupBy("product_id").agg(F.count(F.lit(1)).alias("offers"), F.count_if(O.serving()).alias("active"))
    by_product = p.join(shown, "product_id", "left").agg(
        F.count(F.lit(1)).alias("products"), F.count_if(F.coalesce("active", F.lit(0)) >= 2).alias("multi_store_products"), F.count_if(F.col("offers").isNull()).alias("products_without_offers"),
        F.coalesce(F.sum("offers"), F.lit(0)).alias("offers"), F.coalesce(F.sum("active"), F.lit(0)).alias("active_offers"),
    )
    raw = obs.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("price") <= 0).alias("invalid_prices"), F.count_if(F.col("seen_at") > F.lit(NOW).cast("timestamp_ntz")).alias("future_rows"))
    stale = cur.agg(F.count_if(O.serving() & ~O.fresh(NOW, 24 * 1200.0)).alias("stale_active_offers"))
    one = by_product.crossJoin(raw).crossJoin(stale)  # one row each
    critical = F.col("invalid_prices") + F.col("future_rows")
    warnings = F.col("products_without_offers") + F.col("stale_active_offers")
    verdict = F.when(critical > 0, "BLOCKED").when(warnings > 0, "READY_WITH_WARNINGS").otherwise("READY")
    return one.withColumns({"critical": critical, "warnings": warnings, "status": verdict})


def _offer_id(obs: DataFrame) -> F.Column:
    """An observation's number: product, store, order and line side by side.

    Stores have five places and orders with their lines eight, in a bigint;
    where the largest keys don't fit, they have more, in a decimal.
    """
    keys = ("product_id", "store_id", "order_id")
    product, store, order = (v or 0 for v in obs.agg(*[F.max(k) for k in keys]).first())
    stores, orders = 10**5 if store < 10**5 else 10**10, 10**8 if order * 10 + 9 < 10**8 else 10**16
    if stores == 10**5 and orders == 10**8 and ((product + 1) * stores) * orders <= 2**63:
        return (F.col("product_id") * stores + F.col("store_id")) * orders + F.col("order_id") * 10 + F.col("line")
    number = lambda n: F.lit(Decimal(n))
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    return ((wide("product_id", 12) * number(stores * orders)).cast("decimal(38,0)") + (wide("store_id", 10) * number(orders)).cast("decimal(38,0)") + (wide("order_id", 15) * number(10)).cast("decimal(17,0)") + wide("line", 5)).cast("decimal(38,0)")


def _as_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as offer rows; a product's observations in a store are copies of one offer."""
    obs = observations(spark, sf_dir)
    return obs.select(
        _offer_id(obs).alias("offer_id"), "product_id", "store_id", "price", "shipping", F.col("seen_at").alias("checked_at"), F.col("seen_at").alias("updated_at"),
        (F.col("lifecycle") == "ACTIVE").alias("active"), "hidden",
    )


def archived_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of copied offers: the elected row's id with the latest checked copy's prices."""
    elected = M.offer_survivors(_as_offers(spark, sf_dir), ["product_id", "store_id"])
    return M.freshest(elected, ["product_id", "store_id", "price", "shipping", "checked_at"])


def moved_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each survivor's history after its copies' points have moved to it."""
    offers = _as_offers(spark, sf_dir)
    elected = M.offer_survivors(offers, ["product_id", "store_id"])
    points = offers.select("offer_id", "price", F.date_trunc("year", "checked_at").alias("recorded_at"))
    moved = M.moved_history(points, elected.select("offer_id", "survivor_id"))
    return moved.groupBy("survivor_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("moved").alias("moved"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    source = F.when(F.col("product_id") % 9 != 0, F.concat(F.col("brand"), F.lit("|"), F.col("size")))
    key = F.when(F.col("product_id") % 2 == 0, F.md5(source)).otherwise(F.md5(F.col("name")))
    return p.select("product_id", source.alias("identity_source"), key.alias("identity_key"), F.md5(source).alias("canonical_key"), "name", "brand", "category")


def alias_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with one identity source: the survivor, and its texts with its members' filling the gaps."""
    rows = _aliases(spark, sf_dir)
    of = M.alias_survivors(rows)
    full = of.join(rows, "product_id").withColumns({"brand": _missing("product_id", 4, F.col("brand")), "category": F.when(F.col("product_id") % 3 == 0, "  ").otherwise(F.col("category"))})
    return M.enrich(full, ["brand", "category"])


def variant_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants (offers by product and store) with one canonical key, the store's id modulo 3, collapse to the most seen one."""
    obs = observations(spark, sf_dir).select("product_id", "store_id", (F.col("product_id") * 100_000 + F.col("store_id")).alias("variant_id"))
    variants = obs.select("variant_id", "product_id", (F.col("store_id") % 3).alias("variant_key")).distinct()
    return M.collapse_variants(variants, obs.select("variant_id"))


def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which product an incoming identity belongs to: odd products are the catalog, even ones come in."""
    rows = _aliases(spark, sf_dir).select("product_id", F.coalesce("identity_source", F.lit("")).alias("source"), F.coalesce("canonical_key", F.lit("")).alias("key"))
    catalog = rows.where("product_id % 2 = 1").withColumn("status", F.when(F.col("product_id") % 5 == 0, "RETIRED").otherwise("ACTIVE"))
    catalog = catalog.withColumn("source", F.when(F.col("product_id") % 7 == 0, F.lit("other")).otherwise(F.col("source")))
    return M.resolve(rows.where("product_id % 2 = 0").select(F.col("product_id").alias("incoming_id"), "source", "key"), catalog)


def staged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations staged over the stores' earlier items; a third has no code and is matched by its address."""
    obs = observations(spark, sf_dir)
    rows = obs.select(
        F.col("store_id").cast("string").alias("store"), F.when(F.col("product_id") % 3 != 0, F.col("product_id").cast("string")).alias("code"), F.concat(F.lit("u/"), F.col("product_id")).alias("url"),
        F.rint(F.col("price") / 1000).cast("int").alias("price"), F.col("order_id").alias("item_id"), (F.col("order_id") * 10 + F.col("line")).alias("seq"), "seen_at",
    )
    split = F.lit("1997-01-01").cast("timestamp_ntz")
    base = rows.where(F.col("seen_at") < split).groupBy("store", "code", "url").agg(F.min("item_id").alias("item_id"), F.max_by("price", "seq").alias("price"))
    out = M.stage_items(base.withColumn("payload_hash", M.payload_hash("price")), rows.where(F.col("seen_at") >= split).drop("item_id"), ["price"])
    return out.groupBy("store", "outcome").agg(F.count(F.lit(1)).alias("items"), F.sum("item_id").alias("ids"))


QUERIES = {f.__name__: f for f in (
    product_quality, quality_report, offer_issues, offer_health, listing_validation, counter_rebuild, quarantine_lifecycle, restored_offers, offer_reliability, invariant_evidence,
    release_diagnostics, archived_duplicates, moved_history, alias_convergence, variant_collapse, catalog_resolve, staged_items,
)}

_SERVING = "lifecycle = 'ACTIVE' AND NOT hidden AND price > 0"
_REC = """rec AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS brand, p_partkey % 5 <> 0 AS model, p_partkey % 23 <> 0 AS category, p_partkey % 3 <> 0 AS specs, p_size % 4 AS images,
    p_partkey % 11 = 0 AS broken, CASE WHEN p_partkey % 29 = 0 THEN 0.0 ELSE p_retailprice END AS price, p_retailprice * (1 + p_partkey % 12) AS old_price, p_partkey % 100 AS score,
    EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AS hist FROM part)"""
_SUSPICIOUS = "(price <= 0 OR (old_price > 0 AND old_price >= price * 10) OR (old_price > 0 AND price < old_price AND (old_price - price) / old_price >= 0.96))"
_CHECKS = [
    ("missing_image", 14, "images > 0"), ("thin_gallery", 6, "images >= 2"), ("broken_image", 5, "NOT broken"), ("missing_brand", 11, "brand IS NOT NULL"), ("missing_model", 11, "model"), ("missing_category", 11, "category"),
    ("missing_specs", 13, "specs"), ("suspicious_price", 10, f"NOT {_SUSPICIOUS}"), ("missing_history", 9, "hist"), ("low_ai_score", 10, "score >= 40"),
]
_QUALITY = f"""{_REC}, qual AS (SELECT product_id, ({' + '.join(f'CASE WHEN {ok} THEN {n} ELSE 0 END' for _, n, ok in _CHECKS)})::INTEGER AS quality,
    list_filter([{', '.join(f"CASE WHEN {ok} THEN NULL ELSE '{c}' END" for c, _, ok in _CHECKS)}], lambda x: x IS NOT NULL) AS issues FROM rec)"""
_GAPS = f"""gap AS (SELECT cur.*, s_name, p_brand, order_id AS o, date_diff('second', seen_at, TIMESTAMP '{NOW}') / {AGE_SCALE} / 3600 AS age FROM cur JOIN supplier ON s_suppkey = store_id JOIN part ON p_partkey = product_id)"""
_OFFER_CHECKS = [
    ("seller", 8, "o % 13 = 0"), ("price", 18, "price <= 0"), ("url", 18, "o % 19 = 0"), ("availability", 8, "o % 7 = 0"), ("delivery", 3, "line % 2 = 0"), ("warranty", 3, "o % 2 = 0"), ("installment", 3, "o % 3 = 0"),
    ("campaign", 3, "o % 5 = 0"), ("image", 8, "o % 11 = 0"), ("brand", 8, "product_id % 17 = 0"), ("match_score_low", 18, "match_score < 70"), ("stale", 18, "age > 48"), ("aging", 8, "age > 24 AND age <= 48"), ("hidden", 3, "hidden"),
]
_ISSUES = f"""{_GAPS}, iss AS (SELECT product_id, store_id, o, line, list_filter([{', '.join(f"CASE WHEN {bad} THEN '{c}' END" for c, _, bad in _OFFER_CHECKS)}], lambda x: x IS NOT NULL) AS codes,
    greatest(0, 100 - ({' + '.join(f'CASE WHEN {bad} THEN {n} ELSE 0 END' for _, n, bad in _OFFER_CHECKS)}))::INTEGER AS completeness, {' + '.join(f'CASE WHEN {bad} THEN 1 ELSE 0 END' for _, n, bad in _OFFER_CHECKS if n == 18)} AS crit FROM gap),
buck AS (SELECT *, CASE WHEN crit >= 2 OR completeness < 50 THEN 'broken' WHEN crit = 0 AND completeness >= 80 THEN 'ready' ELSE 'incomplete' END AS bucket FROM iss)"""
_OFFERS = """ofr AS (SELECT (product_id * 100000 + store_id) * 100000000 + order_id * 10 + line AS offer_id, product_id, store_id, price, shipping, seen_at AS checked_at, lifecycle = 'ACTIVE' AS active, hidden FROM obs),
ele AS (SELECT *, first_value(offer_id) OVER (PARTITION BY product_id, store_id ORDER BY active DESC, hidden, checked_at DESC, offer_id) AS survivor_id FROM ofr)"""
_ALIAS = """ali AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 9 <> 0 THEN p_brand || '|' || p_size END AS source, p_name, p_brand, p_type FROM part)"""

SQL = {
    "product_quality": f"WITH {_QUALITY} SELECT product_id, quality, CASE WHEN quality >= 85 THEN 'very good' WHEN quality >= 65 THEN 'good' WHEN quality >= 45 THEN 'needs work' ELSE 'weak' END AS level, array_to_string(issues, ',') AS issues FROM qual",
    "quality_report": f"WITH {_QUALITY}, x AS (SELECT quality, unnest(issues) AS issue FROM qual) SELECT issue, count(*) AS products, sum(quality)::BIGINT AS quality_sum, count_if(quality < 45)::BIGINT AS weak FROM x GROUP BY issue",
    "offer_issues": f"WITH {SQL_CUR}, {_ISSUES} SELECT product_id, store_id, array_to_string(codes, ',') AS issues, completeness, bucket FROM buck",
    "offer_health": f"""WITH {SQL_CUR}, {_ISSUES}, c AS (SELECT store_id, unnest(codes) AS code FROM buck), k AS (SELECT store_id, code, count(*) AS k FROM c GROUP BY ALL),
        t AS (SELECT store_id, code AS top_issue, k AS top_issue_count FROM k QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY k DESC, code DESC) = 1),
        g AS (SELECT store_id, count(*) AS offers, count_if(bucket = 'ready')::BIGINT AS ready, count_if(bucket = 'incomplete')::BIGINT AS incomplete, count_if(bucket = 'broken')::BIGINT AS broken,
              floor(sum(completeness) / count(*) * 10 + 0.5) / 10 AS score, floor(count_if(bucket = 'ready') / count(*) * 1000 + 0.5) / 10 AS success_percent,
              floor(count_if(line % 2 = 1) / count(*) * 1000 + 0.5) / 10 AS delivery_coverage, floor(count_if(o % 13 <> 0) / count(*) * 1000 + 0.5) / 10 AS seller_coverage FROM buck GROUP BY store_id)
        SELECT g.*, top_issue, top_issue_count FROM g LEFT JOIN t USING (store_id)""",
    "listing_validation": """SELECT CASE WHEN p_partkey % 7 = 0 THEN 'name_short' WHEN p_partkey % 31 = 0 THEN 'name_long' WHEN p_partkey % 5 = 0 THEN 'price_missing' WHEN p_partkey % 11 = 0 THEN 'price_not_positive'
        WHEN p_partkey % 13 = 0 THEN 'price_too_high' WHEN p_partkey % 3 = 0 THEN 'url' ELSE 'valid' END AS fault, count(*) AS listings FROM part GROUP BY 1""",
    "counter_rebuild": f"""WITH {SQL_CUR}, r AS (SELECT product_id, count(*) AS n FROM obs GROUP BY ALL), s AS (SELECT product_id, count(*) AS n FROM cur WHERE {_SERVING} GROUP BY ALL)
        SELECT p_partkey AS product_id, coalesce(r.n, 0) AS raw_count, coalesce(s.n, 0) AS offer_count, p_partkey % 10 = 0 AS drifted FROM part LEFT JOIN r ON r.product_id = p_partkey LEFT JOIN s ON s.product_id = p_partkey""",
    "quarantine_lifecycle": f"""WITH {SQL_CUR}, q AS (SELECT a.product_id, a.store_id, a.price, a.hidden, count(b.price) AS peers, median(b.price) AS ref FROM cur a LEFT JOIN cur b ON a.product_id = b.product_id AND a.store_id <> b.store_id GROUP BY ALL),
        v AS (SELECT *, CASE WHEN price <= 0 THEN 'QUARANTINED' WHEN peers < 2 THEN 'TRUSTED_LOW_EVIDENCE' WHEN price / ref < 0.35 OR price / ref > 2.75 THEN 'QUARANTINED' ELSE 'TRUSTED' END AS lifecycle FROM q)
        SELECT product_id, store_id, lifecycle, NOT hidden AND lifecycle <> 'QUARANTINED' AS active, hidden OR lifecycle = 'QUARANTINED' AS hidden, lifecycle = 'QUARANTINED' AND NOT hidden AS changed FROM v""",
    "restored_offers": f"WITH {SQL_CUR} SELECT store_id, count_if(NOT hidden AND store_id <= 4 AND store_id % 3 = 0)::BIGINT AS restored, count_if(NOT hidden AND (store_id > 4 OR store_id % 3 = 0))::BIGINT AS active FROM cur GROUP BY store_id",
    "offer_reliability": f"""WITH {SQL_CUR}, s AS (SELECT product_id, store_id, count(*) AS n, count_if({_SERVING}) AS a FROM obs GROUP BY ALL), g AS (SELECT product_id, sum(n)::BIGINT AS offers, sum(a)::BIGINT AS active_offers, count_if(a > 0)::BIGINT AS active_stores, count_if(a > 1) AS crowded FROM s GROUP BY ALL),
        t AS (SELECT product_id, count(*) AS stored FROM cur WHERE {_SERVING} GROUP BY ALL)
        SELECT p_partkey AS product_id, coalesce(offers, 0)::BIGINT AS offers, coalesce(active_offers, 0)::BIGINT AS active_offers, coalesce(active_stores, 0)::BIGINT AS active_stores, coalesce(stored, 0) = coalesce(active_offers, 0) AS count_consistent,
               coalesce(crowded, 0) = 0 AS one_offer_per_store, coalesce(stored, 0) = coalesce(active_offers, 0) AND coalesce(crowded, 0) = 0 AS serving_consistent
        FROM part LEFT JOIN g ON g.product_id = p_partkey LEFT JOIN t ON t.product_id = p_partkey""",
    "invariant_evidence": """WITH v AS (SELECT 'orders_without_lines' AS invariant, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT 'repeated_pairs', min(l_orderkey) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1 UNION ALL SELECT 'stores_in_debt', s_suppkey FROM supplier WHERE s_acctbal < 0
        UNION ALL SELECT 'nameless_products', p_partkey FROM part WHERE trim(p_name) = ''),
        n AS (SELECT *, row_number() OVER (PARTITION BY invariant ORDER BY id) AS rn FROM v)
        SELECT invariant, count(*) AS violations, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (rn <= 20) AS ids FROM n GROUP BY invariant""",
    "release_diagnostics": f"""WITH {SQL_CUR}, s AS (SELECT product_id, count(*) AS offers, count_if({_SERVING}) AS active FROM cur GROUP BY ALL),
        p AS (SELECT count(*) AS products, count_if(coalesce(active, 0) >= 2)::BIGINT AS multi_store_products, count_if(offers IS NULL)::BIGINT AS products_without_offers, coalesce(sum(offers), 0)::BIGINT AS offers, coalesce(sum(active), 0)::BIGINT AS active_offers FROM part LEFT JOIN s ON product_id = p_partkey),
        r AS (SELECT count(*) AS raw, count_if(price <= 0)::BIGINT AS invalid_prices, count_if(seen_at > TIMESTAMP '{NOW}')::BIGINT AS future_rows FROM obs),
        t AS (SELECT count_if({_SERVING} AND NOT date_diff('second', seen_at, TIMESTAMP '{NOW}') / 3600 <= 28800)::BIGINT AS stale_active_offers FROM cur)
        SELECT *, invalid_prices + future_rows AS critical, products_without_offers + stale_active_offers AS warnings,
               CASE WHEN invalid_prices + future_rows > 0 THEN 'BLOCKED' WHEN products_without_offers + stale_active_offers > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status FROM p, r, t""",
    "archived_duplicates": f"""WITH {SQL_OBS}, {_OFFERS} SELECT survivor_id, arg_max(product_id, (checked_at, offer_id = survivor_id, -offer_id)) AS product_id, arg_max(store_id, (checked_at, offer_id = survivor_id, -offer_id)) AS store_id,
        arg_max(price, (checked_at, offer_id = survivor_id, -offer_id)) AS price, arg_max(shipping, (checked_at, offer_id = survivor_id, -offer_id)) AS shipping, max(checked_at) AS checked_at, count_if(offer_id <> survivor_id)::BIGINT AS archived FROM ele GROUP BY survivor_id""",
    "moved_history": f"""WITH {SQL_OBS}, {_OFFERS}, hm AS (SELECT survivor_id, offer_id <> survivor_id AS moved, row_number() OVER (PARTITION BY survivor_id, round_even(price * 100, 0), date_trunc('year', checked_at) ORDER BY offer_id <> survivor_id, offer_id) AS rn FROM ele)
        SELECT survivor_id, count(*) AS points, count_if(moved)::BIGINT AS moved FROM hm WHERE rn = 1 GROUP BY survivor_id""",
    "alias_convergence": f"""WITH {_ALIAS}, s AS (SELECT *, CASE WHEN source IS NULL THEN product_id ELSE coalesce(min(CASE WHEN product_id % 2 = 0 THEN product_id END) OVER w, min(product_id) OVER w) END AS survivor_id FROM ali WINDOW w AS (PARTITION BY source)),
        g AS (SELECT *, CASE WHEN product_id % 4 <> 0 THEN p_brand END AS b, CASE WHEN product_id % 3 <> 0 THEN p_type END AS c FROM s)
        SELECT survivor_id, coalesce(max(b) FILTER (product_id = survivor_id), arg_min(b, product_id) FILTER (b IS NOT NULL)) AS brand, coalesce(max(c) FILTER (product_id = survivor_id), arg_min(c, product_id) FILTER (c IS NOT NULL)) AS category, count(*) AS members
        FROM g GROUP BY survivor_id""",
    "variant_collapse": f"""WITH {SQL_OBS}, v AS (SELECT product_id, store_id, product_id * 100000 + store_id AS variant_id, count(*) AS refs FROM obs GROUP BY ALL)
        SELECT variant_id, product_id, first_value(variant_id) OVER (PARTITION BY product_id, store_id % 3 ORDER BY refs DESC, variant_id) AS survivor_variant_id, refs FROM v""",
    "catalog_resolve": f"""WITH {_ALIAS}, r AS (SELECT product_id, coalesce(source, '') AS source, coalesce(md5(source), '') AS key FROM ali),
        c AS (SELECT product_id, CASE WHEN product_id % 7 = 0 THEN 'other' ELSE source END AS source, key, product_id % 5 = 0 AS retired FROM r WHERE product_id % 2 = 1),
        i AS (SELECT product_id AS incoming_id, source, key, (SELECT min(c.product_id) FROM c WHERE c.source = r.source AND c.source <> '' AND NOT retired) AS a,
              (SELECT min(c.product_id) FROM c WHERE c.key = r.key AND c.key <> '') AS b FROM r WHERE product_id % 2 = 0),
        j AS (SELECT i.*, c.source AS bs FROM i LEFT JOIN c ON c.product_id = b),
        h AS (SELECT *, CASE WHEN a IS NOT NULL THEN 'source' WHEN b IS NOT NULL AND bs <> '' AND bs <> source THEN 'conflict' WHEN b IS NOT NULL THEN 'key' ELSE 'create' END AS how FROM j)
        SELECT incoming_id, CASE WHEN how IN ('source', 'key') THEN coalesce(a, b) END AS product_id, how FROM h""",
    "staged_items": f"""WITH {SQL_OBS}, r AS (SELECT store_id::VARCHAR AS store, CASE WHEN product_id % 3 <> 0 THEN product_id::VARCHAR END AS code, 'u/' || product_id AS url, round_even(price / 1000, 0)::INTEGER AS price, order_id AS item_id, order_id * 10 + line AS seq, seen_at FROM obs),
        b AS (SELECT store, code, url, min(item_id) AS item_id, arg_max(price, seq) AS price FROM r WHERE seen_at < TIMESTAMP '1997-01-01' GROUP BY ALL),
        s AS (SELECT * FROM r WHERE seen_at >= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY store, code, CASE WHEN code IS NULL THEN url END ORDER BY seq DESC) = 1),
        j AS (SELECT s.store, s.price AS now, b.item_id, b.price AS old FROM s LEFT JOIN b ON b.store = s.store AND (b.code = s.code OR (s.code IS NULL AND b.url = s.url)))
        SELECT store, CASE WHEN item_id IS NULL THEN 'inserted' WHEN now = old THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS items, sum(item_id)::BIGINT AS ids FROM j GROUP BY ALL""",
}
