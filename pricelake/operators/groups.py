"""Best group of a listing among all groups of its brand, without a bound on the candidates.

A score above 0 needs the brand (and the category, where the listing has
one), the variant, a shared word of the families, and equal model codes where
both have one.  So candidates come from equi joins alone: by model code where
both sides have one, by product code, and for the rest from posting lists of
family words.  Nothing is dropped: what the joins leave out scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions.text import normalize_token

from .linkage import group_score, match_confidence, seq_ratio, token_ratio

#: Families of one word's posting list that one task pairs at once.
LIST = 2048
#: Fields that a score reads; rows that agree in them score alike.
FIELDS = ("brand", "family", "variant", "ram_gb", "storage_gb", "screen_inch", "network", "model_code", "product_code")
#: The block of groups of any category; no category is written so.
_ANY = "\x00"


def _family_percent(a: Column, b: Column, ratio: Column) -> Column:
    """The families' likeness: .65 of the sequence ratio, .35 of the shared words."""
    return ratio * 100 * 0.65 + token_ratio(a, b) * 0.35


def _words(family: Column) -> Column:
    return F.array_distinct(F.split(family, " "))


def _classes(rows: DataFrame, name: str, id_col: str, block: Column) -> DataFrame:
    """One row a block and distinct set of scored fields: its smallest id and how many rows it stands for."""
    of = rows.select(id_col, block.alias("block"), F.struct(*[F.col(f"{name}.{f}") for f in FIELDS]).alias(name))
    of = of.withColumn(f"{name}_key", F.to_json(name))
    return of.groupBy("block", f"{name}_key").agg(F.first(name).alias(name), F.min(id_col).alias(id_col), F.count(F.lit(1)).alias(f"{name}_rows"))


def family_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct pairs fa, fb of families that share a word in a block and are alike by 70 %, with their sequence ratio.

    ``left`` and ``right`` have block, variant, family.  A pair is met once, by
    its first shared word.  A long posting list is dealt out in parts of LIST
    families.  Before the ratio is computed its bound by the lengths is tried
    (twice the shorter one over both).  A right family without words meets all
    of its block: nothing speaks against it.
    """
    by = ["block", "variant", "word"]
    a, b = (x.select("block", "variant", F.col("family").alias(f)).distinct() for x, f in ((left, "fa"), (right, "fb")))
    b = b.withColumn("word", F.explode(_words(F.col("fb"))))
    parts = b.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts"))
    b = b.join(parts, by).withColumn("part", F.pmod(F.xxhash64("fb"), F.col("parts")).cast("int")).drop("parts")
    a = a.withColumn("word", F.explode(F.array_distinct(F.concat(_words(F.col("fa")), F.array(F.lit(""))))))
    a = a.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    common = F.array_intersect(_words(F.col("fa")), _words(F.col("fb")))
    once = (F.col("fb") == "") | (F.col("word") == F.array_min(common))
    shorter, both = F.least(F.length("fa"), F.length("fb")), F.length("fa") + F.length("fb")
    near = (F.col("fb") == "") | (_family_percent(F.col("fa"), F.col("fb"), 2 * shorter / both) >= 70)
    pairs = a.join(b, [*by, "part"]).where(once & near).select("fa", "fb").distinct()
    same = F.col("fa") == F.col("fb")
    out = pairs.where(same).withColumn("ratio", F.lit(1.0)).unionByName(pairs.where(~same).withColumn("ratio", seq_ratio("fa", "fb")))
    return out.where((F.col("fb") == "") | (_family_percent(F.col("fa"), F.col("fb"), F.col("ratio")) >= 70))


def best_groups(incoming: DataFrame, groups: DataFrame) -> DataFrame:
    """incoming_key, candidate_id, score, second_score, confidence: one row a row of ``incoming``.

    ``incoming``: incoming_key, p (a parsed identity), category; ``groups``:
    candidate_id, q, category.  A listing with a category meets the groups of
    its brand with that category, one without meets all of its brand.  The
    best is the group of the highest score, the smallest id at ties; the second
    score is that of the next one, which may be equal.  A listing without
    brand or family, or that nothing fits, has no candidate, scores 0 and the
    confidence none.

    Both sides are folded to the distinct sets of scored fields first, so that
    thousands of equal listings are scored once.  The two best of a listing
    are found with a partial step before the shuffle (row_number under a
    limit).
    """
    asked = incoming.where((F.col("p.brand") != "") & (F.col("p.family") != ""))
    named = normalize_token(F.col("category")) != ""
    block = F.concat(F.col("p.brand"), F.lit("\x00"), F.when(named, F.col("category")).otherwise(_ANY))
    inn = _classes(asked, "p", "incoming_key", block)
    both = groups.where(F.col("q.brand") != "").withColumn("place", F.explode(F.array(F.col("category"), F.lit(_ANY)))).where("place is not null")
    cand = _classes(both, "q", "candidate_id", F.concat(F.col("q.brand"), F.lit("\x00"), F.col("place")))
    inn = inn.select("block", F.col("p.variant").alias("variant"), "p_key", "p")
    cand = cand.select("block", F.col("q.variant").alias("variant"), "q", F.col("candidate_id"), "q_rows")

    p_code, q_code = F.col("p.model_code"), F.col("q.model_code")
    by_product = (F.col("p.product_code") != "") & (F.col("p.product_code") == F.col("q.product_code"))
    product = inn.withColumn("code", F.col("p.product_code")).join(cand.withColumn("code", F.col("q.product_code")), ["block", "variant", "code"]).where("code <> ''")
    coded = inn.where(p_code != "").withColumn("code", p_code).join(cand.where(q_code != "").withColumn("code", q_code), ["block", "variant", "code"]).where(~by_product)
    alike = family_pairs(inn.select("block", "variant", "p.family"), cand.select("block", "variant", "q.family"))

    left, right = inn.withColumn("fa", F.col("p.family")), cand.withColumn("fb", F.col("q.family"))
    plain = left.where(p_code == "").join(alike, "fa").join(right, ["block", "variant", "fb"])
    plain = plain.unionByName(left.where(p_code != "").join(alike, "fa").join(right.where(q_code == ""), ["block", "variant", "fb"])).where(~by_product)
    known = coded.unionByName(product).withColumns({"fa": F.col("p.family"), "fb": F.col("q.family")}).join(alike, ["fa", "fb"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    columns = ["block", "p_key", "p", "q", "candidate_id", "q_rows", "ratio"]
    pairs = plain.select(*columns).unionByName(known.select(*columns))

    category = F.when(F.col("block").endswith(_ANY), "").otherwise("same")
    scored = pairs.select("block", "p_key", "candidate_id", "q_rows", group_score(F.col("p"), F.col("q"), F.col("ratio"), category, category).alias("score")).where("score > 0")
    order = Window.partitionBy("block", "p_key").orderBy(F.desc("score"), "candidate_id")
    two = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    first = F.col("place") == 1
    top = two.groupBy("block", "p_key").agg(*[F.max(F.when(first, F.col(c))).alias(c) for c in ("candidate_id", "score", "q_rows")], F.max(F.when(~first, F.col("score"))).alias("next"))
    second = F.when(F.col("q_rows") > 1, F.col("score")).otherwise(F.coalesce("next", F.lit(0.0)))
    top = top.select("block", "p_key", "candidate_id", "score", second.alias("second_score"))

    keyed = incoming.select("incoming_key", block.alias("block"), F.to_json(F.struct(*[F.col(f"p.{f}") for f in FIELDS])).alias("p_key"))
    score, next_ = F.coalesce("score", F.lit(0.0)), F.coalesce("second_score", F.lit(0.0))
    return keyed.join(top, ["block", "p_key"], "left").select("incoming_key", "candidate_id", score.alias("score"), next_.alias("second_score"), match_confidence(score, next_).alias("confidence"))
