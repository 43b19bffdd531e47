"""Attributes and kinds of titles, title matchers, the marketplace list, landing pages, maintenance, reviews, the category tree, operations of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.functions import attributes as A
from pricelake.functions import pages as G
from pricelake.functions import prices as R
from pricelake.functions import text as T
from pricelake.operators import linkage as L
from pricelake.operators import offers as O
from pricelake.operators import operations as P
from pricelake.plans.linkage import _parsed
from pricelake.sources.listings import SQL_LISTINGS, listings
from pricelake.sources.staged import once
from pricelake.sources.tables import EVENTS_NOW, NOW, SQL_CUR, SQL_OBS, current_offers, observations, products, read


def listing_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listing's title says, as rows; equal titles are read once."""
    rows = listings(spark, sf_dir).select("listing_id", F.coalesce("title", F.lit("")).alias("title"))
    told = once(rows, ["title"], lambda titles: titles.select("title", A.attributes(F.col("title")).alias("a")), "attributes")
    return told.select("listing_id", F.explode("a").alias("a")).select("listing_id", "a.section", "a.name", "a.value")


def listing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by kind, with covers and power banks among them."""
    t = F.when(F.col("listing_id") % 7 == 0, F.concat("title", F.lit(" uyumlu kılıf"))).when(F.col("listing_id") % 11 == 0, F.lit("Redmi 20000 mAh Powerbank")).otherwise(F.col("title"))
    category = F.when((F.col("listing_id") % 7 == 0) | (F.col("listing_id") % 11 == 0), "Aksesuar").otherwise(F.col("category"))
    k = A.product_kind(t, category, F.lit(""))
    return listings(spark, sf_dir).select(k.alias("k")).groupBy("k.kind", "k.subkind").agg(F.count(F.lit(1)).alias("listings"))


def offer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of offers out of their texts."""
    i = F.col("order_id") % 6
    text = F.element_at(F.array(*[F.lit(t) for t in ("Ücretsiz kargo, yarın kapında", "2 yıl distribütör garantisi", "Peşin fiyatına 3 taksit", "Sponsorlu", "Resmi satıcı, aynı gün teslimat", "")]), (i + 1).cast("int"))
    d = A.offer_details(text, F.when(F.col("order_id") % 4 == 0, "Shop One Ltd"), F.lit("shop one"), F.when(F.col("line") == 1, 0.0))
    return current_offers(spark, sf_dir).select("product_id", "store_id", d.alias("d")).select("product_id", "store_id", "d.*")


def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both listings of each product by the weighted matcher."""
    rows = _parsed(spark, sf_dir).select("product_id", "copy", "p", "title", F.array_join(L.title_words(F.col("title")), " ").alias("words"))
    a, b = (rows.where(F.col("copy") == c).select("product_id", *[F.col(n).alias(f"{n}_{c}") for n in ("p", "title", "words")]) for c in (0, 1))
    both = a.join(b, "product_id").withColumn("ratio", L.seq_ratio("words_0", "words_1"))
    m = L.weighted_match(F.col("p_0"), F.col("p_1"), F.col("title_0"), F.col("title_1"), F.col("ratio"))
    return both.select("product_id", m.alias("m")).select("product_id", "m.matched", "m.score")


def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose address or title contradicts the product they were put under."""
    i = F.col("listing_id")
    path = F.when(i % 5 == 0, "/kilif/").when(i % 5 == 1, "/powerbank/").otherwise("/p/")
    url = F.concat(F.lit("https://shop.example"), path, i)
    canonical = F.when(i % 4 == 0, "Çamaşır deterjanı 5 kg bahar kokulu").otherwise(F.col("title"))
    store = F.when(i % 3 == 0, "amazon").otherwise("shop")
    c = L.source_conflicts(store, url, F.col("title"), canonical, i % 2 == 0)
    return listings(spark, sf_dir).select("listing_id", F.array_join(c, ",").alias("conflicts"))


def phone_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical identities of phones, memory and colour dropped; other kinds have none."""
    rows = listings(spark, sf_dir)
    packed = F.concat(F.lit("identity_v2:color=x|ram=8gb|storage="), F.col("product_id") % 512, F.lit("gb|family=f|brand="), F.lower(F.coalesce("brand", F.lit("b"))))
    return rows.select("listing_id", L.canonical_phone_source(T.identity_map(packed), F.col("category").contains("Telefon")).alias("source"))


def marketplace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the marketplace by popularity (the feature is the limit), with the number of all products."""
    o = current_offers(spark, sf_dir).where(O.serving()).groupBy("product_id").agg(F.min("price").alias("best_price"), F.max("price").alias("highest_price"), F.count(F.lit(1)).alias("offers"))
    variants = observations(spark, sf_dir).select("product_id", (F.col("store_id") % 3).alias("v")).distinct().groupBy("product_id").agg(F.count(F.lit(1)).alias("variants"))
    rows = o.join(products(spark, sf_dir).select("product_id", "name"), "product_id")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("offers"), "best_price", "product_id").offset(24).limit(24)
    saving = F.when(F.col("highest_price") > F.col("best_price"), F.floor((F.col("highest_price") - F.col("best_price")) / F.col("highest_price") * 10000 + 0.5) / 100).otherwise(0.0)
    return page.join(variants, "product_id", "left").crossJoin(total).select("product_id", "name", "best_price", "offers", F.coalesce("variants", F.lit(0)).alias("variants"), saving.alias("saving_percent"), "total")  # one row


def landing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing page: categories that hold a term or are held by it, any of the words, a price band, falling prices, 72 cards (the feature is the limit)."""
    terms, words, band = ("promo", "economy anodized steel and more"), ("widget", "bolt", "cold"), (100.0, 60_000.0)
    o = current_offers(spark, sf_dir).where("price > 0").groupBy("product_id").agg(F.min("price").alias("price"), F.max("old_price").alias("old_price"), F.count(F.lit(1)).alias("offers"))
    c = F.lower("category")
    fits = F.lit(False)
    for t in terms:
        fits = fits | c.contains(t) | F.lit(t).contains(c)
    said = F.lit(False)
    for w in words:
        said = said | F.lower("name").contains(w) | c.contains(w)
    rows = o.join(products(spark, sf_dir).select("product_id", "name", "category"), "product_id").where(fits & said & F.col("price").between(*band))
    drop = F.when(F.col("old_price") > F.col("price"), F.floor((F.col("old_price") - F.col("price")) / F.col("old_price") * 10000 + 0.5) / 100).otherwise(0.0)
    return rows.withColumn("drop_percent", drop).where("drop_percent > 0").orderBy(F.desc("drop_percent"), "price", "name", "product_id").limit(72).select("product_id", "price", "drop_percent", "offers")


def maintenance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance of all offers: copies are archived, lifecycles reconciled, best offers chosen again; counts by lifecycle."""
    rows = O.lifecycle(current_offers(spark, sf_dir), NOW, 24 * 1500.0, 24 * 2500.0).withColumn("lifecycle", F.col("next_lifecycle"))
    can = O.eligible()
    first = F.row_number().over(Window.partitionBy("product_id", can).orderBy("total", "store_id")) == 1
    rows = rows.withColumn("best", can & first)
    return rows.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("offers"), F.count_if("best").alias("best_offers"))


def legacy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's offers as they are listed: available first, then by total, store and seller; offers out of stock are shown too."""
    rows = O.lifecycle(current_offers(spark, sf_dir), NOW, 1e9, 1e9).withColumn("lifecycle", F.col("next_lifecycle"))
    shown = rows.where(F.col("lifecycle").isin("ACTIVE", "UPDATED", "OUT_OF_STOCK")).withColumn("available", F.col("lifecycle") != "OUT_OF_STOCK")
    order = Window.partitionBy("product_id").orderBy(F.desc("available"), F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(float("inf"))), "store_id")
    return shown.withColumn("place", F.row_number().over(order)).select("product_id", "store_id", "available", "total", "place")


def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings (assistants' text lengths modulo 5 stand for them): how many conversations gave each of 5 to 1, with zeros, and the mean."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.length("text") % 5 + 1).alias("rating"))
    n = c.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    stars = spark.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    mean = n.agg((F.floor(F.sum(F.col("rating") * F.col("n")) / F.sum("n") * 10 + 0.5) / 10).alias("mean"))
    return stars.join(n, "rating", "left").fillna(0, ["n"]).crossJoin(mean)  # one row


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by main category, brand and size, and the totals above: counted fine first, then rolled up."""
    rows = products(spark, sf_dir).select(F.col("category").alias("main"), F.col("brand").alias("part"), F.col("size").cast("string").alias("leaf"))
    fine = rows.groupBy("main", "part", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return fine.rollup("main", "part", "leaf").agg(F.sum("n").alias("products"))


def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's events by level: errors, signups as warnings, the rest information."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    e = read(spark, sf_dir, "events").where(F.col("ts") > F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS"))
    return e.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > 50).alias("large"))


def bounded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 tasks of a log, a task's latest entry each (the feature is the bound): events by user as task."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", "event_type")
    last = P.last_runs(e, ["task_id"], ["ts", "event_id"], 1).drop("back")
    return last.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("task_id", "event_id", "event_type")


#: Products of a category page, by ranges of ids.
PAGE = 500


def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of category pages, each page's payload one JSON text: address, name, prices, code; of a brand's repeated addresses the first."""
    p = products(spark, sf_dir)
    card = F.struct(F.concat(F.lit("https://shop.example/"), F.col("product_id") % 1000).alias("url"), F.col("name").alias("name"), F.array(G.money(F.col("list_price")), G.money(F.col("list_price") * 2)).alias("price_candidates"), F.col("product_id").cast("string").alias("product_code"))
    page = F.floor(F.col("product_id") / PAGE).alias("page")
    payload = p.groupBy("brand", page).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("product_id", card.alias("c")))), lambda x: x["c"])).alias("payload"))
    rows = payload.select("brand", "page", F.posexplode(G.card_rows(F.col("payload"))).alias("place", "card"))
    first = rows.groupBy("brand", "card.url").agg(F.min_by("card", F.struct("page", "place")).alias("c"))
    s = R.select_prices(F.array_distinct(F.flatten(F.transform("c.price_candidates", R.currency_prices))))
    return first.select("brand", "url", F.col("c.product_code").alias("code"), s["current"].alias("price"), s["old"].alias("old_price"))


def unseen_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of stores that were scanned in the last year of the data without being seen in it, by store."""
    cur = current_offers(spark, sf_dir)
    scanned = observations(spark, sf_dir).where(F.col("seen_at") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("store_id", "product_id").distinct()
    return cur.join(scanned, ["store_id", "product_id"], "left_anti").groupBy("store_id").agg(F.count(F.lit(1)).alias("unseen"))


QUERIES = {f.__name__: f for f in (
    listing_attributes, listing_kinds, offer_texts, title_matches, source_checks, phone_sources, marketplace_list, landing_page, maintenance_run, legacy_comparison, review_rollup, category_tree, day_summary, bounded_tasks,
    product_cards, unseen_offers,
)}

_SERVING = "lifecycle = 'ACTIVE' AND NOT hidden AND price > 0"
SQL = {
    "listing_attributes": f"""WITH {SQL_LISTINGS} SELECT listing_id, 'Bellek' AS section, 'RAM' AS name, ram || ' GB' AS value FROM lst WHERE ram IS NOT NULL UNION ALL SELECT listing_id, 'Depolama', 'Depolama Kapasitesi', storage || ' GB' FROM lst WHERE storage IS NOT NULL
        UNION ALL SELECT listing_id, 'Bağlantılar', '5G', 'Var' FROM lst WHERE network = '5G' UNION ALL SELECT listing_id, 'Tasarım', 'Renk', color FROM lst""",
    "listing_kinds": f"""WITH {SQL_LISTINGS}, t AS (SELECT CASE WHEN listing_id % 7 = 0 THEN CASE kind WHEN 'tablet' THEN 'tablet' WHEN 'audio' THEN 'headphone' ELSE 'accessory' END WHEN listing_id % 11 = 0 THEN 'powerbank' WHEN kind = 'audio' THEN 'headphone' ELSE kind END AS subkind FROM lst)
        SELECT CASE subkind WHEN 'powerbank' THEN 'accessory' WHEN 'headphone' THEN 'audio/headphone' ELSE subkind END AS kind, subkind, count(*) AS listings FROM t GROUP BY ALL""",
    "offer_texts": f"""WITH {SQL_CUR} SELECT product_id, store_id, line = 1 OR order_id % 6 = 0 AS free_shipping, order_id % 6 = 3 AS sponsored, order_id % 6 = 4 OR order_id % 4 = 0 AS official, CASE order_id % 6 WHEN 0 THEN 'yarin kapinda' WHEN 4 THEN 'ayni gun teslimat' END AS delivery,
        CASE WHEN order_id % 6 = 1 THEN '2 yil distributor garantisi' END AS warranty, CASE WHEN order_id % 6 = 2 THEN 'pesin fiyatina 3 taksit' END AS installment FROM cur""",
    "source_checks": f"""WITH {SQL_LISTINGS} SELECT listing_id, array_to_string(list_filter([CASE WHEN listing_id % 3 <> 0 AND ((listing_id % 5 = 0 AND (model LIKE 'iPhone%' OR model LIKE 'Redmi Note%')) OR (listing_id % 5 = 1 AND (model LIKE 'iPhone%' OR model LIKE 'Redmi Note%'))) THEN 'URL_CLASS' END,
        CASE WHEN listing_id % 4 = 0 AND len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(replace(replace(title, 'ı', 'i'), 'ü', 'u')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$')))) >= 3 THEN 'LOW_OVERLAP' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM lst""",
    "phone_sources": f"""WITH {SQL_LISTINGS} SELECT listing_id, CASE WHEN kind = 'phone' THEN 'identity_v3:brand=' || CASE WHEN (k + copy) % 4 = 1 THEN 'b' ELSE lower(brand) END || '|family=f|storage=' || k % 512 || 'gb' END AS source FROM lst""",
    "marketplace_list": f"""WITH {SQL_CUR}, o AS (SELECT product_id, min(price) AS best_price, max(price) AS highest_price, count(*) AS offers FROM cur WHERE {_SERVING} GROUP BY product_id), v AS (SELECT product_id, count(DISTINCT store_id % 3) AS variants FROM obs GROUP BY product_id),
        p AS (SELECT o.*, p_name AS name, count(*) OVER () AS total FROM o JOIN part ON p_partkey = product_id ORDER BY offers DESC, best_price, product_id LIMIT 24 OFFSET 24)
        SELECT product_id, name, best_price, offers, coalesce(variants, 0) AS variants, CASE WHEN highest_price > best_price THEN floor((highest_price - best_price) / highest_price * 10000 + 0.5) / 100 ELSE 0.0 END AS saving_percent, total FROM p LEFT JOIN v USING (product_id)""",
    "landing_page": f"""WITH {SQL_CUR}, o AS (SELECT product_id, min(price) AS price, max(old_price) AS old_price, count(*) AS offers FROM cur WHERE price > 0 GROUP BY product_id),
        r AS (SELECT o.*, p_name, lower(p_type) AS c, lower(p_name) AS n FROM o JOIN part ON p_partkey = product_id),
        f AS (SELECT *, CASE WHEN old_price > price THEN floor((old_price - price) / old_price * 10000 + 0.5) / 100 ELSE 0.0 END AS drop_percent FROM r
              WHERE (contains(c, 'promo') OR contains('promo', c) OR contains('economy anodized steel and more', c)) AND regexp_matches(n || ' ' || c, 'widget|bolt|cold') AND price BETWEEN 100 AND 60000)
        SELECT product_id, price, drop_percent, offers FROM f WHERE drop_percent > 0 ORDER BY drop_percent DESC, price, p_name, product_id LIMIT 72""",
    "maintenance_run": f"""WITH {SQL_CUR}, l AS (SELECT product_id, store_id, total, price, hidden, CASE WHEN date_diff('second', seen_at, TIMESTAMP '{NOW}') / 3600 > 60000 THEN 'ARCHIVED' WHEN date_diff('second', seen_at, TIMESTAMP '{NOW}') / 3600 > 36000 THEN 'MISSING' WHEN hidden THEN 'OUT_OF_STOCK' ELSE lifecycle END AS lifecycle FROM cur),
        b AS (SELECT product_id, arg_min(store_id, (total, store_id)) AS best FROM l WHERE lifecycle IN ('ACTIVE', 'UPDATED') AND NOT hidden AND price > 0 GROUP BY product_id)
        SELECT lifecycle, count(*) AS offers, count_if(best = store_id AND lifecycle IN ('ACTIVE', 'UPDATED'))::BIGINT AS best_offers FROM l LEFT JOIN b USING (product_id) GROUP BY lifecycle""",
    "legacy_comparison": f"WITH {SQL_CUR} SELECT product_id, store_id, NOT hidden AS available, total, row_number() OVER (PARTITION BY product_id ORDER BY NOT hidden DESC, total, store_id)::INTEGER AS place FROM cur",
    "review_rollup": """WITH n AS (SELECT (length(text) % 5 + 1)::INTEGER AS rating, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL)
        SELECT s.rating::INTEGER AS rating, coalesce(n.n, 0) AS n, (SELECT floor(sum(rating * n) / sum(n) * 10 + 0.5) / 10 FROM n) AS mean FROM (SELECT unnest([1, 2, 3, 4, 5]) AS rating) s LEFT JOIN n USING (rating)""",
    "category_tree": "SELECT p_type AS main, p_brand AS part, p_size::VARCHAR AS leaf, count(*)::BIGINT AS products FROM part GROUP BY ROLLUP (p_type, p_brand, p_size::VARCHAR)",
    "day_summary": f"""SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, count(*) AS events, count_if(value > 50)::BIGINT AS large FROM events WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOURS GROUP BY 1""",
    "bounded_tasks": """WITH l AS (SELECT user_id AS task_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT task_id, event_id, event_type FROM l ORDER BY ts DESC, event_id DESC LIMIT 500""",
    "product_cards": """WITH f AS (SELECT p_brand AS brand, 'https://shop.example/' || p_partkey % 1000 AS url, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_partkey % 1000 ORDER BY p_partkey) = 1)
        SELECT brand, url, p_partkey::VARCHAR AS code, round(p_retailprice, 2) AS price, round(p_retailprice * 2, 2) AS old_price FROM f""",
    "unseen_offers": f"WITH {SQL_CUR} SELECT store_id, count(*) AS unseen FROM cur WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.store_id = cur.store_id AND obs.product_id = cur.product_id AND seen_at >= TIMESTAMP '1998-01-01') GROUP BY store_id",
}
