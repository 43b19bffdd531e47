"""Convergence of the catalog: merges of products with all that points at them, audits, watches, accessories, variant references.

Products of one brand and size are one product: each is retired into the one
before it, so that merges come in chains.  An offer of a store is a raw row
and an offer; its variant is one of the product's three by the store's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.functions import identity as I
from pricelake.functions import text as T
from pricelake.operators import convergence as C
from pricelake.sources.market import market_cards, market_products
from pricelake.sources.staged import staged
from pricelake.sources.tables import SQL_CUR, current_offers, observations, read

_COLORS = ("siyah", "beyaz", "mavi", "gri")


def _color(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _COLORS)), (n % 4 + 1).cast("int"))


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("product_id"), "p_brand", "p_size")
    k = F.col("product_id")
    products = part.select("product_id", "p_brand", "p_size", F.when(k % 3 != 0, F.concat(F.lit("img"), k)).alias("image"), F.when(k % 4 != 0, F.concat(F.lit("c"), k % 9)).alias("category"), F.when(k % 5 != 0, k % 64).alias("ram_gb"))
    variants = part.select("product_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
    variants = variants.select((k * 4 + F.col("v")).alias("variant_id"), "product_id", F.concat(F.lit("color="), _color(k + F.col("v"))).alias("variant_key"))
    of_offer = [F.col("store_id") + k * 10_000_000, (k * 4 + F.col("store_id") % 3).alias("variant_id")]
    offers = staged(current_offers(spark, sf_dir), "offers").select(of_offer[0].alias("offer_id"), of_offer[0].alias("raw_id"), "product_id", of_offer[1], F.lit(True).alias("active"), "hidden", "lifecycle", "price")
    history = observations(spark, sf_dir).select(of_offer[0].alias("offer_id"), "product_id", of_offer[1], "price", "seen_at")
    return {"products": products, "variants": variants, "raws": offers.select("raw_id", "product_id", "variant_id"), "offers": offers, "history": history}


def _pairs(products: DataFrame) -> DataFrame:
    before = F.lag("product_id").over(Window.partitionBy("p_brand", "p_size").orderBy("product_id"))
    return products.select(F.col("product_id").alias("id"), before.alias("survivor_id")).where("survivor_id is not null")


def _merged(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    catalog = _catalog(spark, sf_dir)
    return catalog, C.merge_catalog(catalog, _pairs(catalog["products"]), texts=("image", "category"), numbers=("ram_gb",))


def merged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surviving product with its filled gaps and counters."""
    return _merged(spark, sf_dir)[1]["products"]


def merged_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant and the one that stands for it after the merges."""
    return _merged(spark, sf_dir)[1]["variant_remap"]


def merged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each child table by the product and variant that they point at after the merges."""
    merged = _merged(spark, sf_dir)[1]
    rows = [merged[t].groupBy(F.lit(t).alias("child"), "product_id", "variant_id").agg(F.count(F.lit(1)).alias("n")) for t in ("raws", "offers", "history")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def merge_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the merged catalog, and of one where products moved but variants and counters were forgotten."""
    catalog, merged = _merged(spark, sf_dir)
    of = merged["remap"].select(F.col("id").alias("product_id"), "survivor_id")
    move = lambda df: df.join(of, "product_id", "left").withColumn("product_id", F.coalesce("survivor_id", "product_id")).drop("survivor_id")
    n = catalog["offers"].groupBy("product_id").agg(F.count(F.lit(1)).alias("raw_product_count"), F.count_if(~F.col("hidden") & (F.col("lifecycle") == "ACTIVE") & (F.col("price") > 0)).alias("active_offer_count"))
    old = catalog["products"].join(of, "product_id", "left_anti").join(n, "product_id", "left").fillna(0, ["raw_product_count", "active_offer_count"])
    naive = {t: move(catalog[t]) for t in ("raws", "offers", "history")} | {"products": old, "variants": catalog["variants"]}
    audits = [C.health_audit(c, merged["remap"]).withColumn("catalog", F.lit(name)) for name, c in (("merged", merged), ("naive", naive))]
    return audits[0].unionByName(audits[1])


def variant_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active offers whose raw row has another variant, what is repaired and why the rest is not."""
    catalog = _catalog(spark, sf_dir)
    k, v = F.col("product_id"), F.col("variant_id") % 4
    known = catalog["variants"].select(
        "variant_id", F.when(v == 2, k + k % 2).otherwise(k).alias("product_id"), F.when((k + v) % 3 == 0, F.concat(F.lit("SM-"), k % 7 + v)).alias("model_code"), F.when(k % 4 != v, F.concat(F.lit(" Mavi "), k % 2)).alias("color"),
        F.when((k + v) % 5 == 0, "5G").alias("network"),
    )
    store = F.col("raw_id") % 10_000_000
    moved = F.col("variant_id") - F.col("variant_id") % 4 + (F.col("variant_id") % 4 + store) % 4
    raws = catalog["raws"].select("raw_id", F.when(store % 11 == 0, k + 1).otherwise(k).alias("product_id"), F.when(store % 2 == 0, moved).otherwise(F.col("variant_id")).alias("variant_id"), F.when(store % 7 == 0, "REVIEW").otherwise("MATCHED").alias("status"))
    out = C.variant_drift(catalog["offers"], raws, known)
    return out.select("offer_id", "old_variant_id", "new_variant_id", F.array_join("reasons", ",").alias("reasons"), "repaired")


def _watch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of watches whose fields say different things; some hold the canonical source or key already."""
    rows = market_cards(spark, sf_dir).where("kind = 'watch'").select(F.col("card_id").alias("group_id"), "m", "name", "brand", "category")
    rows = staged(rows.withColumn("told", I.identity_source(I.parse(F.col("name"), F.col("brand"), F.col("category")))), "told")
    source = F.when(F.col("m") == 1, F.col("told")).when(F.col("m") == 6, F.concat("told", F.lit("|variant=se")))
    rows = rows.withColumn("identity_source", source).withColumn("group_key", F.when(F.col("m") == 1, T.identity_key(F.col("identity_source"))).otherwise(F.concat(F.lit("old:"), F.col("group_id"))))
    model = F.when(F.col("m") == 8, "Watch GT 5 Pro").when(F.col("m") == 9, "redmi watch 5 lite")
    return rows.select("group_id", "group_key", "identity_source", model.alias("model"), F.col("name").alias("canonical_name"), F.when(F.col("m") != 10, F.col("brand")).alias("brand"), F.when(F.col("m") != 3, F.col("category")).alias("category"))


def watch_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of watches by the identity that their fields elect: who stays, who is merged, who takes which key."""
    return C.converge_watches(_watch_groups(spark, sf_dir), ["identity_source", "model", "canonical_name"])


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products under the brand that they fit, their raw rows, and groups of the old identities."""
    k = F.col("product_id")
    raws = market_cards(spark, sf_dir).where("kind in ('iphone', 'android') and m in (3, 4)").withColumn("product_id", k)
    maker = F.element_at(F.array(F.lit("Spigen"), F.lit("Ringke"), F.lit("Baseus")), (k % 3 + 1).cast("int"))
    brand = F.when((k % 5 == 4) & (F.col("m") == 4), F.lit("Nillkin")).when(k % 7 == 3, F.lit(None)).otherwise(maker)
    name = F.when((F.col("m") == 4) & (k % 4 != 1), F.concat(F.col("name"), F.lit(" kapak"))).otherwise(F.col("name"))
    name = F.regexp_replace(name, "^(Apple|Samsung|Huawei) ", "")
    raws = staged(raws.select("product_id", F.when((k % 6 == 5) & (F.col("m") == 4), "REVIEW").otherwise("MATCHED").alias("status"), I.parse(name, brand, F.col("category")).alias("p")), "raws")
    own = market_products(spark, sf_dir).where("kind in ('iphone', 'android')")
    family = I.parse(F.col("name"), F.col("brand"), F.col("category"))["family"]
    products = own.select("product_id", F.lower("brand").alias("brand"), F.when(k % 13 == 12, "galaxy x").otherwise(family).alias("family"), F.when(k % 17 == 0, "MERGED").otherwise("ACTIVE").alias("status"))
    products = products.withColumns({"identity_source": F.concat(F.lit("identity_v3:old="), k), "identity_key": F.concat(F.lit("old"), k)})
    # one in nineteen holds another one's corrected identity already
    there = raws.where(k % 19 == 1).select((k + 1_000_000_000).alias("product_id"), F.lit("spigen").alias("brand"), F.col("p.family").alias("family"), F.lit("ACTIVE").alias("status"), I.identity_source(F.col("p")).alias("identity_source")).distinct()
    products = products.unionByName(there.withColumn("identity_key", T.identity_key(F.col("identity_source"))))
    groups = own.select(k.alias("group_id"), F.concat(F.lit("g"), k).alias("group_key"), F.concat(F.lit("identity_v3:old="), k).alias("identity_source"), F.when(k % 8 == 0, "LG").otherwise(F.lit(None)).alias("brand"), F.when(k % 9 == 0, "other").otherwise(F.lit(None)).alias("model"))
    return staged(products, "products"), raws, groups


def accessory_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessories under the brand that they fit: what is repaired, and what speaks against the rest."""
    out = C.converge_accessories(*_fitted(spark, sf_dir))
    return out.withColumn("reasons", F.array_join("reasons", ","))


QUERIES = {f.__name__: f for f in (merged_products, merged_variants, merged_references, merge_health, variant_drift, watch_convergence, accessory_convergence)}

_G = f"""WITH {SQL_CUR}, g AS (SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS s, CASE WHEN p_partkey % 3 <> 0 THEN 'img' || p_partkey END AS image,
        CASE WHEN p_partkey % 4 <> 0 THEN 'c' || (p_partkey % 9) END AS category, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 64 END AS ram_gb FROM part),
    vr AS (SELECT k * 4 + v AS variant_id, k, s, ['siyah', 'beyaz', 'mavi', 'gri'][(k + v) % 4 + 1] AS color FROM g, (SELECT unnest([0, 1, 2]) AS v)),
    vm AS (SELECT variant_id, first_value(variant_id) OVER (PARTITION BY s, color ORDER BY k = s DESC, variant_id) AS survivor_variant_id FROM vr),
    o AS (SELECT cur.*, s, product_id * 4 + store_id % 3 AS variant_id, lifecycle = 'ACTIVE' AND NOT hidden AND price > 0 AS live FROM cur JOIN g ON g.k = cur.product_id),
    ho AS (SELECT obs.product_id, s, obs.product_id * 4 + store_id % 3 AS variant_id FROM obs JOIN g ON g.k = obs.product_id)"""
_FILLED = lambda c: f"coalesce(max({c}) FILTER (k = s), arg_min({c}, k) FILTER (k <> s AND {c} IS NOT NULL)) AS {c}"

SQL = {
    "merged_products": _G
    + f""", n AS (SELECT s AS ns, count(*) AS r, count(*) FILTER (live) AS l FROM o GROUP BY s) SELECT g.s AS product_id, {_FILLED('image')}, {_FILLED('category')}, {_FILLED('ram_gb')}, count(*) AS members,
        coalesce(max(r), 0) AS raw_product_count, coalesce(max(l), 0) AS active_offer_count FROM g LEFT JOIN n ON ns = g.s GROUP BY g.s""",
    "merged_variants": _G + " SELECT variant_id, survivor_variant_id FROM vm",
    "merged_references": _G
    + """ SELECT child, s AS product_id, survivor_variant_id AS variant_id, count(*) AS n FROM (SELECT 'raws' AS child, s, variant_id FROM o UNION ALL SELECT 'offers', s, variant_id FROM o UNION ALL SELECT 'history', s, variant_id FROM ho) JOIN vm USING (variant_id) GROUP BY ALL""",
    "merge_health": _G
    + """, c AS (SELECT s, count(*) AS r, count(*) FILTER (live) AS l, count(*) FILTER (product_id = s) AS r0, count(*) FILTER (live AND product_id = s) AS l0 FROM o GROUP BY s)
        SELECT 'naive' AS catalog, (SELECT count(*) FROM o WHERE product_id <> s) AS raw_variant_wrong_product, (SELECT count(*) FROM o WHERE product_id <> s) AS offer_variant_wrong_product, 0::BIGINT AS duplicate_variant_keys, 0::BIGINT AS active_variant_drift,
            (SELECT count(*) FROM c WHERE r <> r0) AS raw_counter_drift, (SELECT count(*) FROM c WHERE l <> l0) AS active_offer_counter_drift, 0::BIGINT AS quarantine_violations, 0::BIGINT AS retired_rows_remaining,
            (SELECT count(*) FROM vr WHERE k <> s) AS dangling, false AS clean
        UNION ALL SELECT 'merged', 0, 0, 0, 0, 0, 0, 0, 0, 0, true""",
    "variant_drift": f"""WITH {SQL_CUR}, v AS (SELECT p_partkey * 4 + v AS variant_id, p_partkey AS k, v, CASE WHEN v = 2 THEN p_partkey + p_partkey % 2 ELSE p_partkey END AS gp, CASE WHEN (p_partkey + v) % 3 = 0 THEN 'sm-' || (p_partkey % 7 + v) END AS model,
            CASE WHEN p_partkey % 4 <> v THEN 'mavi ' || (p_partkey % 2) END AS color, CASE WHEN (p_partkey + v) % 5 = 0 THEN '5g' END AS network FROM part, (SELECT unnest([0, 1, 2]) AS v)),
        o AS (SELECT product_id * 10000000 + store_id AS offer_id, product_id, store_id, product_id * 4 + store_id % 3 AS old_id, product_id * 4 + (store_id % 3 + store_id) % 4 AS new_id FROM cur WHERE store_id % 2 = 0 AND store_id % 7 <> 0),
        j AS (SELECT o.*, a.variant_id IS NOT NULL AND b.variant_id IS NOT NULL AS there, a.gp AS ag, b.gp AS bg, a.model AS am, b.model AS bm, a.color AS ac, b.color AS bc, a.network AS an, b.network AS bn
              FROM o LEFT JOIN v a ON a.variant_id = old_id LEFT JOIN v b ON b.variant_id = new_id WHERE old_id <> new_id),
        r AS (SELECT offer_id, old_id AS old_variant_id, new_id AS new_variant_id, concat_ws(',', CASE WHEN NOT there THEN 'MISSING_VARIANT' END, CASE WHEN there AND store_id % 11 = 0 THEN 'RAW_GLOBAL_PRODUCT_MISMATCH' END,
            CASE WHEN there AND ag <> product_id THEN 'OLD_VARIANT_GLOBAL_PRODUCT_MISMATCH' END, CASE WHEN there AND bg <> product_id THEN 'NEW_VARIANT_GLOBAL_PRODUCT_MISMATCH' END, CASE WHEN there AND am <> bm THEN 'MODEL_CONFLICT' END,
            CASE WHEN there AND ac IS NOT NULL AND ac IS DISTINCT FROM bc THEN 'COLOR_CONFLICT_OR_LOSS' END, CASE WHEN there AND an IS NOT NULL AND an IS DISTINCT FROM bn THEN 'NETWORK_CONFLICT_OR_LOSS' END) AS reasons FROM j)
        SELECT *, reasons = '' AS repaired FROM r""",
}
