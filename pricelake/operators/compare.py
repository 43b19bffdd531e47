"""Comparison of products side by side: specifications, features, the matrix, similarity, recommendations, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import text as T
from pricelake.functions.let import let
from pricelake.operators import scoring as S

#: Words that stand for yes and no, and what makes a feature better (fixed values, folded).
YES = ("var", "evet", "mevcut", "destekliyor", "destekleniyor", "true", "yes")
NO = ("yok", "hayir", "mevcut degil", "desteklemiyor", "desteklenmiyor", "false", "no")
LOWER_BETTER = ("agirlik", "kalinlik", "gecikme", "tepki suresi", "guc tuketimi", "ses seviyesi")
HIGHER_BETTER = (
    "ram kapasitesi", "ram hizi", "bellek kapasitesi", "bellek hizi", "ssd kapasitesi", "hdd kapasitesi", "depolama kapasitesi", "ekran karti bellegi", "vram",
    "cekirdek sayisi", "thread sayisi", "islemci maksimum hizi", "maksimum hiz", "yenileme hizi", "parlaklik", "batarya kapasitesi", "pil kapasitesi", "usb c",
    "usb sayisi", "kamera cozunurlugu",
)
YES_BETTER = ("wi fi 6", "wifi 6", "wi fi 7", "wifi 7", "ethernet", "hdmi 2 1", "nfc", "bluetooth", "hdr", "esim")
#: Words that say nothing about how alike two products are (fixed values, folded).
STOP_WORDS = (
    "ve", "ile", "icin", "gb", "tb", "ram", "ssd", "nvme", "urun", "model", "yeni", "garantili", "turkiye", "renk", "siyah", "beyaz", "mavi", "gri", "gumus", "gold",
)
#: What each part of a similarity weighs (fixed values).
WEIGHTS = {"lexical": 25.0, "brand": 7.0, "model": 8.0, "ram": 9.0, "storage": 9.0, "cpu": 10.0, "gpu": 12.0, "screen": 5.0, "network": 5.0, "refresh": 3.0, "price": 7.0}


def specification_rows(products: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, section, name, value of a JSON object's entries, objects inside it being sections; invalid JSON and empty values give none."""
    top = products.select(id_col, F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "raw"))
    nested = F.from_json("raw", "map<string,string>")
    section = F.col("raw").startswith("{")
    inner = top.where(section).select(id_col, F.col("key").alias("section"), F.explode(nested).alias("name", "value"))
    flat = top.where(~section).select(id_col, F.lit("Genel").alias("section"), F.col("key").alias("name"), F.col("raw").alias("value"))
    return inner.unionByName(flat).withColumn("value", F.trim("value")).where("value <> ''")


def feature_value(c: Column) -> Column:
    """value_type, value_text, value_number, value_boolean, unit of a raw value."""
    plain, text = T.normalize_text(c), F.trim(F.coalesce(c, F.lit("")))
    yes, no = plain.isin(*YES), plain.isin(*NO)
    pattern = r"^(-?[0-9]+(?:[.,][0-9]+)?)\s*([^0-9\s].*)?$"
    number = F.when(~yes & ~no, F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("."))).try_cast("double")
    unit = F.trim(F.regexp_extract(text, pattern, 2))
    return F.struct(
        F.when(yes | no, "boolean").when(number.isNotNull(), "number").otherwise("text").alias("value_type"), F.when(~yes & ~no & number.isNull(), text).alias("value_text"),
        number.alias("value_number"), F.when(yes, True).when(no, False).alias("value_boolean"), F.when(number.isNotNull() & (unit != ""), unit).alias("unit"),
    )


def comparison_direction(name: Column, value_type: Column) -> Column:
    """higher_better, lower_better, yes_better or neutral, by a feature's name."""
    n = T.normalize_text(name)
    has = lambda words: n.rlike("|".join(words))
    return (
        F.when(has(LOWER_BETTER) & (value_type == "number"), "lower_better").when(has(HIGHER_BETTER) & (value_type == "number"), "higher_better")
        .when((value_type == "boolean") | has(YES_BETTER), "yes_better").otherwise("neutral")
    )


def matrix(features: DataFrame, chosen: int, group: str = "set_id") -> DataFrame:
    """Features side by side: set, section, name, present, distinct_values, is_different, is_equal, winners.

    ``features``: set_id, product_id, section, name, value, value_number,
    value_boolean, direction; each set compares ``chosen`` products.  A
    feature's winners have its best value, if two or more have one; ties all win.
    """
    key = [group, "section", "name"]
    best_of = Window.partitionBy(*key)
    rows = features.withColumn("raw", F.when(F.col("direction") == "yes_better", F.col("value_boolean").cast("double")).otherwise(F.col("value_number")))
    best = F.when(F.first("direction").over(best_of) == "lower_better", F.min("raw").over(best_of)).otherwise(F.max("raw").over(best_of))
    best = F.when(F.first("direction").over(best_of) == "yes_better", 1.0).otherwise(best)
    wins = (F.col("direction") != "neutral") & (F.count("raw").over(best_of) >= 2) & (F.col("raw") == best)
    out = rows.withColumn("wins", F.coalesce(wins, F.lit(False))).groupBy(*key).agg(
        F.countDistinct("product_id").alias("present"), F.countDistinct(F.lower(F.trim("value"))).alias("distinct_values"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("wins"), F.col("product_id")))), lambda p: p.cast("string")), ",").alias("winners"),
    )
    different = (F.col("distinct_values") > 1) | (F.col("present") != chosen)
    return out.withColumns({"is_different": different, "is_equal": (F.col("present") == chosen) & (F.col("distinct_values") == 1)})


def pivoted(features: DataFrame, product_ids: list[int]) -> DataFrame:
    """section, name, and a column of values for each of the chosen products."""
    rows = features.where(F.col("product_id").isin(*product_ids))
    return rows.groupBy("section", "name").pivot("product_id", product_ids).agg(F.first("value"))


def profiled(profiles: DataFrame) -> DataFrame:
    """Profiles with the words that `similarity` compares, so that they are found once a product and not once a pair."""
    words = lambda c: F.array_distinct(T.similarity_tokens(c, STOP_WORDS))
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", words(F.col(c)))
    return profiles.withColumns({"_all": words(F.concat_ws(" ", "brand", "model", "name")), "_model": known("model"), "_cpu": known("cpu"), "_gpu": known("gpu"), "_brand": T.similarity_text(F.col("brand"))})


def similarity(a: Column, b: Column) -> Column:
    """score, compatible, coverage of two profiles (`profiled`); score 0 in different category families.

    A profile has product_id, name, brand, model, family (of its category),
    ram, storage, screen, refresh (numbers), cpu, gpu (texts), network
    (boolean), price.  Parts that both know are weighed and the rest is left
    out; another network or graphics card caps the score at 64, a far memory or
    disk at 69.
    """

    def words(name: str) -> Column:
        x, y = a[name], b[name]
        same = F.when(x == y, 1.0).otherwise(0.0)
        return F.when(x.isNull() | y.isNull(), None).when((F.size(x) == 0) | (F.size(y) == 0), same).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)))

    parts = F.struct(
        F.coalesce(words("_all"), F.lit(0.0)).alias("lexical"), F.when((a["_brand"] != "") & (a["_brand"] == b["_brand"]), 1.0).otherwise(0.0).alias("brand"), F.coalesce(words("_model"), words("_all"), F.lit(0.0)).alias("model"),
        S.numeric_similarity(a["ram"], b["ram"], 0.5).alias("ram"), S.numeric_similarity(a["storage"], b["storage"], 0.6).alias("storage"), words("_cpu").alias("cpu"), words("_gpu").alias("gpu"),
        S.numeric_similarity(a["screen"], b["screen"], 0.25).alias("screen"), F.when(a["network"].isNull() | b["network"].isNull(), None).when(a["network"] == b["network"], 1.0).otherwise(0.0).alias("network"),
        S.numeric_similarity(a["refresh"], b["refresh"], 0.5).alias("refresh"), S.price_similarity(a["price"], b["price"]).alias("price"),
    )
    apart = (a["family"] != b["family"]) | (a["product_id"] == b["product_id"])
    return let(F.struct(parts.alias("p"), apart.alias("apart")), lambda x: _weighed(x["p"], x["apart"]))


def _weighed(parts: Column, apart: Column) -> Column:
    weight = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    won = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    cap = F.when(is_(parts["network"] == 0) | is_(parts["gpu"] == 0), 64.0).otherwise(100.0)
    cap = F.when(is_(parts["ram"] < 0.25) | is_(parts["storage"] < 0.25), F.least(cap, F.lit(69.0))).otherwise(cap)
    score = F.least(won / weight * 100, cap)
    return F.struct(
        F.when(apart, 0.0).otherwise(S.half_up(S.clamp(score, 0, 100), 1)).alias("score"), (~apart & (score >= 35)).alias("compatible"), S.half_up(weight / sum(WEIGHTS.values()) * 100, 1).alias("coverage"),
    )


def newest_of_family(profiles: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest profiles of each category family (the rule's own bound on what a product is compared with)."""
    order = Window.partitionBy("family").orderBy(F.desc("updated_at"), F.desc("product_id"))
    return profiles.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def recommendations(profiles: DataFrame, most: int = 160, per_bucket: int = 4) -> DataFrame:
    """product_id, bucket, place, candidate_id, score: each product's best candidates by bucket.

    ``profiles`` has the columns of `similarity` and offers, deal, confidence,
    updated_at.  A product is compared with the ``most`` newest of all, itself
    left out, as far as they are of its category family; these are the rule's
    own bound and small enough to be sent to every task.
    """
    profiles = profiled(profiles)
    newest = profiles.orderBy(F.desc("updated_at"), F.desc("product_id")).limit(most + 1)
    newest = newest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("product_id"))))  # most + 1 rows
    own = newest.select("product_id", F.col("n").alias("own"))
    current = profiles.join(F.broadcast(own), "product_id", "left").select("family", F.struct(*profiles.columns).alias("a"), F.when(F.col("own") <= most, most + 1).otherwise(most).alias("upto"))
    cand = newest.select("family", F.struct(*profiles.columns).alias("b"), "n")
    pairs = current.join(F.broadcast(cand), "family").where((F.col("n") <= F.col("upto")) & (F.col("a.product_id") != F.col("b.product_id")))
    pairs = pairs.withColumn("s", similarity(F.col("a"), F.col("b"))).where("s.compatible")
    difference = (F.col("b.price") - F.col("a.price")) / F.col("a.price") * 100
    score = S.recommendation_score(F.col("s.score"), F.col("b.deal"), difference, F.col("b.offers"), F.col("b.confidence"))
    rows = pairs.select(F.col("a.product_id").alias("product_id"), F.col("b.product_id").alias("candidate_id"), score.alias("score"), F.col("s.score").alias("similarity"), difference.alias("difference"), F.col("b.deal").alias("deal"), F.col("b.confidence").alias("confidence"))
    bucket = S.recommendation_bucket(*[F.col(c) for c in ("score", "similarity", "deal", "difference", "confidence")])
    rows = rows.withColumn("bucket", bucket).where("bucket <> 'insufficient_data'")
    order = Window.partitionBy("product_id", "bucket").orderBy(F.desc("score"), "candidate_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_bucket).select("product_id", "bucket", "place", "candidate_id", "score")


def alternatives(cards: DataFrame, most: int = 30, top: int = 4) -> DataFrame:
    """product_id, place, candidate_id, cheapest, best_deal, closest: the alternatives of each product in its category.

    ``cards``: product_id, category, price, deal, confidence, offers,
    updated_at.  The ``most`` newest of the category, the product itself left
    out, stand for choice.  First the cheapest, the best deal and the closest price, then the best deals.
    """
    newest = Window.partitionBy("category").orderBy(F.desc("updated_at"), F.desc("product_id"))
    ranked = cards.withColumn("n", F.row_number().over(newest))
    cand = ranked.where(F.col("n") <= most + 1).select("category", *[F.col(c).alias(f"c_{c}") for c in ("product_id", "price", "deal", "confidence", "offers", "n")])
    upto = F.when(F.col("n") <= most, most + 1).otherwise(most)
    pairs = ranked.select("product_id", "category", "price", upto.alias("upto")).join(cand, "category").where("product_id <> c_product_id and c_n <= upto")
    pairs = pairs.withColumn("distance", F.abs(F.col("c_price") - F.col("price")) / F.col("price") * 100)
    whole = Window.partitionBy("product_id")
    first = lambda *by: F.row_number().over(whole.orderBy(*by, "c_product_id")) == 1
    pairs = pairs.withColumns({"cheapest": first("c_price"), "best_deal": first(F.desc("c_deal"), F.desc("c_confidence")), "closest": first("distance")})
    lead = F.when(F.col("cheapest"), 0).when(F.col("best_deal"), 1).when(F.col("closest"), 2).otherwise(3)
    place = F.row_number().over(whole.orderBy(lead, F.desc("c_deal"), "distance", F.desc("c_offers"), "c_product_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= top).select("product_id", "place", F.col("c_product_id").alias("candidate_id"), "cheapest", "best_deal", "closest")


def series_name(brand: Column, name: Column) -> Column:
    """The first two words of a name after the brand."""
    own = F.lower(name).startswith(F.lower(brand)) & (brand != "")
    rest = F.when(own, F.substring(name, F.length(brand) + 1, F.length(name))).otherwise(name)
    words = F.array_join(F.slice(F.filter(F.split(F.trim(F.regexp_replace(rest, r"^[ -]+", "")), r"\s+"), lambda w: w != ""), 1, 2), " ")
    return F.when(words == "", "Diğer").otherwise(words)


def chart_series(points: DataFrame) -> DataFrame:
    """product_id, day, store_id, price: every day any store was seen, with every store, prices as gaps where it wasn't.

    ``points``: product_id, day, store_id, price; days and stores of one product meet, no more.
    """
    days = points.select("product_id", "day").distinct()
    shops = points.select("product_id", "store_id").distinct()
    known = points.groupBy("product_id", "day", "store_id").agg(F.min("price").alias("price"))
    return days.join(shops, "product_id").join(known, ["product_id", "day", "store_id"], "left")
