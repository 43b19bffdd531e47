"""Comparison queries: specifications, matrix, similarity, recommendations, alternatives, details of brands and categories, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.operators import compare as C
from pricelake.operators import history as H
from pricelake.operators import offers as O
from pricelake.operators import scoring as S
from pricelake.plans.scoring import detailed_offers, product_facts
from pricelake.sources.listings import DEVICE, SQL_DEVICES
from pricelake.sources.tables import SQL_CUR, SQL_OBS, cents, current_offers, observations, products, read


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return rows.selectExpr("*", *[f"{sql} AS {name}" for name, sql in DEVICE.items()])


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's specification JSON as rows: product_id, section, name, value."""
    d = _devices(spark, sf_dir)
    inner = F.struct(F.concat(F.col("ram"), F.lit(" GB")).alias("RAM Kapasitesi"), F.concat(F.col("storage"), F.lit(" GB")).alias("Depolama Kapasitesi"))
    spec = F.to_json(F.struct(inner.alias("Bellek"), F.when(F.col("network") == "5G", "Var").otherwise("Yok").alias("NFC"), F.concat(F.col("k") % 300 + 100, F.lit(" g")).alias("Ağırlık"), F.col("color").alias("Renk")))
    return C.specification_rows(d.select(F.col("k").alias("product_id"), spec.alias("spec")), "product_id", "spec")


def specification_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications with their types and the direction in which they are better."""
    rows = specifications(spark, sf_dir).withColumn("v", C.feature_value(F.col("value")))
    return rows.select("product_id", "section", "name", "v.*").withColumn("direction", C.comparison_direction(F.col("name"), F.col("value_type")))


def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in sets of four neighbours, side by side."""
    rows = specifications(spark, sf_dir).withColumn("v", C.feature_value(F.col("value"))).select("product_id", "section", "name", "value", "v.value_type", "v.value_number", "v.value_boolean")
    rows = rows.withColumns({"set_id": F.floor(F.col("product_id") / 4), "direction": C.comparison_direction(F.col("name"), F.col("value_type"))})
    return C.matrix(rows, 4)


def matrix_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chosen products as columns."""
    out = C.pivoted(specifications(spark, sf_dir), [1, 2, 3, 5])
    return out.select("section", "name", *[F.col(str(i)).alias(f"p{i}") for i in (1, 2, 3, 5)])


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = product_facts(spark, sf_dir)
    c = [F.col(n) for n in ("best", "saving", "offers", "average", "lowest", "trend", "change", "fake")]
    confidence = S.deal_confidence(F.col("records"), F.col("offers"), F.col("average"), F.col("lowest"))
    deals = facts.select("product_id", "best", "offers", S.deal_score(*c).alias("deal"), confidence.alias("confidence"))
    d = _devices(spark, sf_dir).withColumnRenamed("k", "product_id")
    gpu, cpu, none = F.lit(None).cast("string"), F.concat(F.lit("cpu "), F.col("product_id") % 7), F.lit(None).cast("double")
    return d.join(deals, "product_id").select(
        "product_id", F.concat_ws(" ", "brand", "model", "variant").alias("name"), "brand", F.trim(F.concat_ws(" ", "model", "variant")).alias("model"), F.col("kind").alias("family"),
        F.col("ram").cast("double").alias("ram"), F.col("storage").cast("double").alias("storage"), none.alias("screen"), none.alias("refresh"), cpu.alias("cpu"), gpu.alias("gpu"), (F.col("network") == "5G").alias("network"),
        F.col("best").alias("price"), "offers", "deal", "confidence", (F.col("product_id") % 1000).alias("updated_at"),
    )


def similar_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product against its category family's ten newest: similarity and how much of it is known."""
    p = C.profiled(_profiles(spark, sf_dir))
    a = p.select("family", F.struct(*p.columns).alias("a"))
    b = C.newest_of_family(p, 10).select("family", F.struct(*p.columns).alias("b"))
    rows = a.join(b, "family").where("a.product_id <> b.product_id").withColumn("s", C.similarity(F.col("a"), F.col("b")))
    return rows.select(F.col("a.product_id").alias("product_id"), F.col("b.product_id").alias("candidate_id"), "s.score", "s.compatible", "s.coverage")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recommendations(_profiles(spark, sf_dir))


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _profiles(spark, sf_dir).select("product_id", "price", "deal", "confidence", "offers", "updated_at")
    return C.alternatives(cards.join(products(spark, sf_dir).select("product_id", "category"), "product_id"))


def category_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's card in its category: least price, largest crossed-out price, the drop between, offers, and the cheapest store."""
    o = current_offers(spark, sf_dir).where(O.eligible())
    cards = o.groupBy("product_id").agg(
        F.min(F.struct("price", "store_id")).alias("b"), F.max("old_price").alias("old_price"), F.count(F.lit(1)).alias("offers"),
    )
    cards = cards.join(products(spark, sf_dir).select("product_id", "category", "brand"), "product_id").select("product_id", "category", "brand", F.col("b.price").alias("price"), F.col("b.store_id").alias("store_id"), "old_price", "offers")
    return cards.withColumn("drop_percent", F.when(F.col("old_price") > F.col("price"), cents((F.col("old_price") - F.col("price")) / F.col("old_price") * 100)).otherwise(0.0))


def brand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each brand by series, the first two words after the brand."""
    d = _devices(spark, sf_dir)
    rows = d.select("brand", C.series_name(F.col("brand"), F.concat_ws(" ", "brand", "model", "variant")).alias("series"))
    return rows.groupBy("brand", "series").agg(F.count(F.lit(1)).alias("products"))


def market_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row without a key: offers, products, stores, least and largest price, mean of prices above 0, largest discount."""
    o = current_offers(spark, sf_dir).where(O.eligible())
    by_product = o.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum(F.rint(F.col("price") * 100).cast("bigint")).alias("cents"), F.max((F.col("old_price") - F.col("price")) / F.col("old_price") * 100).alias("d"))
    one = by_product.agg(F.sum("n").alias("offers"), F.count(F.lit(1)).alias("products"), F.min("lo").alias("min_price"), F.max("hi").alias("max_price"), (F.floor(F.sum("cents") / F.sum("n") + 0.5) / 100).alias("mean_price"), cents(F.max("d")).alias("max_discount"))
    shops = o.select("store_id").distinct().agg(F.count(F.lit(1)).alias("stores"))
    return one.crossJoin(shops)  # one row each


def popular_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight stores with most offers, and what each one's 80 cheapest offers cost in all (the feature is the limit)."""
    o = current_offers(spark, sf_dir).where(O.eligible())
    cheap = Window.partitionBy("store_id").orderBy("price", "product_id")
    top = o.withColumn("n", F.row_number().over(cheap)).where("n <= 80").groupBy("store_id").agg(F.sum(F.rint(F.col("price") * 100).cast("bigint")).alias("cents_of_80"))
    n = o.groupBy("store_id").agg(F.count(F.lit(1)).alias("offers")).orderBy(F.desc("offers"), "store_id").limit(8)
    return n.join(top, "store_id")


def variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers of each product's selected variant, the cheapest available one, with their scores.

    A variant is the store's id modulo 3; 50 points, 25 at the best total, 10
    free shipping (under 1 stands for it), 10 official, 5 with a delivery text.
    """
    o = detailed_offers(spark, sf_dir).where(O.serving()).withColumn("variant", F.col("store_id") % 3)
    least = Window.partitionBy("product_id").orderBy("total", "variant")
    chosen = o.groupBy("product_id", "variant").agg(F.min("total").alias("total"), F.count(F.lit(1)).alias("offers"))
    chosen = chosen.withColumn("n", F.row_number().over(least)).where("n = 1").select("product_id", "variant", F.col("total").alias("best"))
    rows = o.join(chosen, ["product_id", "variant"])
    score = 50 + F.when(F.col("total") == F.col("best"), 25).otherwise(0) + F.when(F.col("shipping") < 1, 10).otherwise(0) + F.when(F.col("official"), 10).otherwise(0) + F.when(F.col("delivery_text").isNotNull(), 5).otherwise(0)
    return rows.select("product_id", "store_id", "variant", "total", (F.col("total") == F.col("best")).alias("is_best"), score.alias("score"))


def new_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each product was first seen and in which store, and how new that makes it."""
    rows = observations(spark, sf_dir)
    first = rows.groupBy("product_id").agg(F.min(F.struct("seen_at", "order_id", "line", "store_id")).alias("f"))
    age = F.floor(F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("f.seen_at"), F.lit("1992-06-01").cast("timestamp_ntz"))) / 86400)
    newness = F.when(age <= 7, "very_new").when(age <= 30, "new").when(age <= 90, "recent").otherwise("older")
    return first.select("product_id", F.col("f.seen_at").alias("first_seen"), F.col("f.store_id").alias("store_id"), age.alias("age_days"), newness.alias("newness"))


def price_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's chart by year: all years it was seen in with all its stores, gaps where a store wasn't."""
    points = observations(spark, sf_dir).select("product_id", F.date_trunc("year", "seen_at").alias("day"), "store_id", "price").where("product_id % 50 = store_id % 50 or store_id % 5 = 0")
    return C.chart_series(points)


def history_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest, highest and mean price of each product in each store, and how far the store's last price is from the product's mean."""
    rows = observations(spark, sf_dir)
    of_store = rows.groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("points"), F.min("price").alias("lowest"), F.max("price").alias("highest"), H.mean(F.col("price")).alias("average"))
    of_product = rows.groupBy("product_id").agg(H.mean(F.col("price")).alias("product_average"))
    return of_store.join(of_product, "product_id")


def quarantine_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer against its peers and, where it fits them, its own history; phones and accessories are held under .55 already."""
    rows = H.evidence_status(current_offers(spark, sf_dir).select("product_id", "store_id", "price"), observations(spark, sf_dir))
    kind = F.when(F.col("product_id") % 5 < 3, F.lit("phone")).otherwise("generic")
    low = kind.isin("phone", "accessory") & (F.col("peers") >= 2) & (F.col("ratio") < 0.55)
    return rows.select("product_id", "store_id", "price", "peers", F.when(low, "QUARANTINED").otherwise(F.col("status")).alias("status"))


QUERIES = {f.__name__: f for f in (
    specifications, specification_values, comparison_matrix, matrix_of_four, similar_products, recommendations, alternatives, category_cards, brand_series, market_totals, popular_stores, variant_comparison,
    new_products, price_chart, history_by_store, quarantine_with_history,
)}

_SPEC = f"""{SQL_DEVICES}, spc AS (SELECT k AS product_id, 'Bellek' AS section, 'RAM Kapasitesi' AS name, ram || ' GB' AS value FROM dev WHERE ram IS NOT NULL UNION ALL SELECT k, 'Bellek', 'Depolama Kapasitesi', storage || ' GB' FROM dev WHERE storage IS NOT NULL
    UNION ALL SELECT k, 'Genel', 'NFC', CASE WHEN network = '5G' THEN 'Var' ELSE 'Yok' END FROM dev UNION ALL SELECT k, 'Genel', 'Ağırlık', (k % 300 + 100) || ' g' FROM dev UNION ALL SELECT k, 'Genel', 'Renk', color FROM dev),
typ AS (SELECT *, CASE name WHEN 'NFC' THEN 'boolean' WHEN 'Renk' THEN 'text' ELSE 'number' END AS value_type, CASE WHEN name NOT IN ('NFC', 'Renk') THEN split_part(value, ' ', 1)::DOUBLE END AS value_number,
        CASE WHEN name = 'NFC' THEN value = 'Var' END AS value_boolean, CASE name WHEN 'NFC' THEN 'yes_better' WHEN 'Renk' THEN 'neutral' WHEN 'Ağırlık' THEN 'lower_better' ELSE 'higher_better' END AS direction FROM spc)"""
_ELIGIBLE = "lifecycle IN ('ACTIVE', 'UPDATED') AND NOT hidden AND price > 0"

SQL = {
    "specifications": f"WITH {_SPEC} SELECT * FROM spc",
    "specification_values": f"WITH {_SPEC} SELECT product_id, section, name, value_type, CASE WHEN name = 'Renk' THEN value END AS value_text, value_number, value_boolean, CASE WHEN value_number IS NOT NULL THEN split_part(value, ' ', 2) END AS unit, direction FROM typ",
    "comparison_matrix": f"""WITH {_SPEC}, r AS (SELECT *, CAST(floor(product_id / 4) AS BIGINT) AS set_id, coalesce(value_number, value_boolean::INTEGER::DOUBLE) AS raw FROM typ),
        b AS (SELECT *, count(raw) OVER w AS n, CASE direction WHEN 'lower_better' THEN min(raw) OVER w WHEN 'yes_better' THEN 1.0 ELSE max(raw) OVER w END AS best FROM r WINDOW w AS (PARTITION BY set_id, section, name)),
        g AS (SELECT set_id, section, name, count(DISTINCT product_id) AS present, count(DISTINCT lower(value)) AS distinct_values, coalesce(string_agg(product_id::VARCHAR, ',' ORDER BY product_id) FILTER (direction <> 'neutral' AND n >= 2 AND raw = best), '') AS winners FROM b GROUP BY ALL)
        SELECT *, distinct_values > 1 OR present <> 4 AS is_different, present = 4 AND distinct_values = 1 AS is_equal FROM g""",
    "matrix_of_four": f"WITH {_SPEC} SELECT section, name, " + ", ".join(f"max(value) FILTER (product_id = {i}) AS p{i}" for i in (1, 2, 3, 5)) + " FROM spc WHERE product_id IN (1, 2, 3, 5) GROUP BY section, name",
    "category_cards": f"""WITH {SQL_CUR}, g AS (SELECT product_id, min(price) AS price, arg_min(store_id, (price, store_id)) AS store_id, max(old_price) AS old_price, count(*) AS offers FROM cur WHERE {_ELIGIBLE} GROUP BY product_id)
        SELECT product_id, p_type AS category, p_brand AS brand, price, store_id, old_price, offers, CASE WHEN old_price > price THEN floor((old_price - price) / old_price * 100 * 100 + 0.5) / 100 ELSE 0.0 END AS drop_percent FROM g JOIN part ON p_partkey = product_id""",
    "brand_series": f"WITH {SQL_DEVICES} SELECT brand, split_part(model, ' ', 1) || ' ' || split_part(model, ' ', 2) AS series, count(*) AS products FROM dev GROUP BY ALL",
    "market_totals": f"""WITH {SQL_CUR} SELECT count(*) AS offers, count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores, min(price) AS min_price, max(price) AS max_price, floor(sum(round_even(price * 100, 0)::BIGINT) / count(*) + 0.5) / 100 AS mean_price,
        floor(max((old_price - price) / old_price * 100) * 100 + 0.5) / 100 AS max_discount FROM cur WHERE {_ELIGIBLE}""",
    "popular_stores": f"""WITH {SQL_CUR}, e AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY price, product_id) AS n FROM cur WHERE {_ELIGIBLE}),
        g AS (SELECT store_id, count(*) AS offers, sum(round_even(price * 100, 0)::BIGINT) FILTER (n <= 80)::BIGINT AS cents_of_80 FROM e GROUP BY store_id) SELECT * FROM g ORDER BY offers DESC, store_id LIMIT 8""",
    "variant_comparison": f"""WITH {SQL_CUR}, d AS (SELECT cur.*, store_id % 3 AS variant, s_acctbal >= 5000 AS official FROM cur JOIN supplier ON s_suppkey = store_id WHERE lifecycle = 'ACTIVE' AND NOT hidden AND price > 0),
        v AS (SELECT product_id, variant, min(total) AS best FROM d GROUP BY product_id, variant QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY min(total), variant) = 1)
        SELECT product_id, store_id, variant, total, total = best AS is_best, (50 + CASE WHEN total = best THEN 25 ELSE 0 END + CASE WHEN shipping < 1 THEN 10 ELSE 0 END + CASE WHEN official THEN 10 ELSE 0 END + CASE WHEN line % 2 = 1 THEN 5 ELSE 0 END)::INTEGER AS score
        FROM d JOIN v USING (product_id, variant)""",
    "new_products": f"""WITH {SQL_OBS}, f AS (SELECT product_id, min(seen_at) AS first_seen, arg_min(store_id, (seen_at, order_id, line)) AS store_id FROM obs GROUP BY product_id),
        a AS (SELECT *, CAST(floor(greatest(0, date_diff('second', first_seen, TIMESTAMP '1992-06-01')) / 86400) AS BIGINT) AS age_days FROM f)
        SELECT *, CASE WHEN age_days <= 7 THEN 'very_new' WHEN age_days <= 30 THEN 'new' WHEN age_days <= 90 THEN 'recent' ELSE 'older' END AS newness FROM a""",
    "price_chart": f"""WITH {SQL_OBS}, p AS (SELECT product_id, date_trunc('year', seen_at)::TIMESTAMP AS day, store_id, min(price) AS price FROM obs WHERE product_id % 50 = store_id % 50 OR store_id % 5 = 0 GROUP BY ALL)
        SELECT d.product_id, d.day, s.store_id, p.price FROM (SELECT DISTINCT product_id, day FROM p) d JOIN (SELECT DISTINCT product_id, store_id FROM p) s USING (product_id) LEFT JOIN p ON p.product_id = d.product_id AND p.day = d.day AND p.store_id = s.store_id""",
    "history_by_store": f"""WITH {SQL_OBS}, m AS (SELECT product_id, floor(sum(round(price * 100)::BIGINT) / count(price) + 0.5) / 100 AS product_average FROM obs GROUP BY product_id)
        SELECT product_id, store_id, count(*) AS points, min(price) AS lowest, max(price) AS highest, floor(sum(round(price * 100)::BIGINT) / count(price) + 0.5) / 100 AS average, any_value(product_average) AS product_average FROM obs JOIN m USING (product_id) GROUP BY product_id, store_id""",
    "quarantine_with_history": f"""WITH {SQL_CUR}, hm AS (SELECT product_id, store_id, median(price) AS own FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen_at DESC, order_id DESC, line DESC) AS back FROM obs) WHERE back <= 20 GROUP BY ALL),
        q AS (SELECT a.product_id, a.store_id, a.price, list(b.price) FILTER (b.price IS NOT NULL) AS peers FROM cur a LEFT JOIN cur b ON a.product_id = b.product_id AND a.store_id <> b.store_id GROUP BY ALL),
        e AS (SELECT q.*, CASE WHEN len(peers) >= 1 AND own / list_median(peers) BETWEEN 0.60 AND 1.67 THEN list_append(peers, own) ELSE coalesce(peers, []) END AS ev FROM q JOIN hm USING (product_id, store_id)),
        r AS (SELECT *, len(ev) AS n, price / list_median(ev) AS ratio FROM e)
        SELECT product_id, store_id, price, n AS peers, CASE WHEN product_id % 5 < 3 AND n >= 2 AND ratio < 0.55 THEN 'QUARANTINED' WHEN price <= 0 THEN 'QUARANTINED' WHEN n < 2 THEN 'TRUSTED_LOW_EVIDENCE'
               WHEN ratio < 0.35 OR ratio > 2.75 THEN 'QUARANTINED' ELSE 'TRUSTED' END AS status FROM r""",
}
