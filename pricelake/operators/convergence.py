"""Convergence of a catalog: whole merges of products with all that points at them, their audit, and repairs that fail closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import identity as I
from pricelake.functions.let import let
from pricelake.functions.text import identity_key, normalize_token
from pricelake.sources.staged import staged

#: Brands that other makers' accessories name as what they fit (fixed values).
FITTED_BRANDS = ("apple", "samsung", "xiaomi")
#: Watches by the text of a field: pattern of family and variant, what stands before the family, the brand where none is given (fixed values).
WATCH_FAMILIES = (
    (r"\bredmi\s+watch\s+([0-9]{1,2})(?:\s+(active|lite|pro))?\b", "redmi watch ", "xiaomi"),
    (r"\bgalaxy\s+watch\s+([0-9]{1,2})(?:\s+(ultra|pro|classic|active))?\b", "galaxy watch ", "samsung"),
    (r"\bapple\s+watch\s+series\s+([0-9]{1,2})(?:\s+(ultra|se))?\b", "apple watch series ", "apple"),
    (r"\bwatch\s+((?:gt|fit)\s*[0-9]{1,2})(?:\s+(pro|active))?\b", "watch ", "huawei"),
)
_ROUNDS = 40


# --- merges ---------------------------------------------------------------------


def closure(pairs: DataFrame) -> DataFrame:
    """id, survivor_id of the last survivor of every retired id, through chains of merges (``pairs``: id, survivor_id).

    Each round follows twice as many steps as the one before, so a chain of n
    merges takes log n rounds; every round is written.  An id with several
    survivors goes to the smallest; an id that is its own survivor isn't
    retired.  Ids whose chain comes back to itself have no survivor and are
    left out.
    """
    now = staged(pairs.where("id <> survivor_id").groupBy("id").agg(F.min("survivor_id").alias("survivor_id")), "closure")
    for _ in range(_ROUNDS):
        up = now.select(F.col("id").alias("survivor_id"), F.col("survivor_id").alias("next"))
        now = staged(now.join(up, "survivor_id", "left").select("id", F.coalesce("next", "survivor_id").alias("survivor_id"), F.col("next").isNotNull().alias("moved")), "closure")
        if now.where("moved").isEmpty():
            break
        going = now.where("moved")
        now = now.drop("moved")
    else:
        now = now.join(going.select("id"), "id", "left_anti")
    return now.select("id", "survivor_id")


def _gap(texts: bool, c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit("")) if texts else F.col(c)


def merge_catalog(catalog: dict[str, DataFrame], pairs: DataFrame, texts: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The catalog after all merges of ``pairs`` (id, survivor_id) at once.

    ``catalog`` has products (product_id, ``texts``, ``numbers``), variants
    (variant_id, product_id, variant_key), and raws, offers and history, each
    with product_id and variant_id; offers have active, hidden, lifecycle,
    price.  Survivors keep what they know and take each gap from the retired
    product with the smallest id that fills it.  Of a survivor's variants with
    one key its own stays (the smallest id), else the smallest retired one;
    all rows that pointed at another point at it.  Every child table is
    rewritten by one remap of products and one of variants, both closed over
    chains, so no row can point at a retired one.  Counters are counted anew.

    The result also has `remap` (id, survivor_id) and `variant_remap`
    (variant_id, survivor_variant_id).  Nothing is changed in place: a result
    whose `health_audit` isn't clean is thrown away.
    """
    remap = staged(closure(pairs).join(catalog["products"].select(F.col("product_id").alias("survivor_id")), "survivor_id", "left_semi"), "remap")
    of = remap.select(F.col("id").alias("product_id"), "survivor_id")

    def moved(df: DataFrame) -> DataFrame:
        at = df.join(of, "product_id", "left")
        return at.withColumns({"own": F.col("survivor_id").isNull(), "product_id": F.coalesce("survivor_id", "product_id")}).drop("survivor_id")

    order = Window.partitionBy("product_id", "variant_key").orderBy(F.desc("own"), "variant_id")
    variants = moved(catalog["variants"]).withColumn("survivor_variant_id", F.first("variant_id").over(order))
    variant_remap = staged(variants.select("variant_id", "survivor_variant_id"), "variant-remap")
    kept = variants.where("variant_id = survivor_variant_id").drop("own", "survivor_variant_id")

    def pointed(df: DataFrame) -> DataFrame:
        columns = df.columns
        out = moved(df).drop("own").join(variant_remap, "variant_id", "left").withColumn("variant_id", F.coalesce("survivor_variant_id", "variant_id"))
        return out.select(*columns)

    raws, offers, history = (pointed(catalog[t]) for t in ("raws", "offers", "history"))
    old = moved(catalog["products"].withColumn("id", F.col("product_id")))
    filled = []
    for c in (*texts, *numbers):
        known = _gap(c in texts, c)
        filled.append(F.coalesce(F.max(F.when(F.col("own"), known)), F.min_by(known, F.when(~F.col("own") & known.isNotNull(), F.col("id")))).alias(c))
    products = old.groupBy("product_id").agg(*filled, F.count(F.lit(1)).alias("members"))
    live = F.col("active") & ~F.col("hidden") & (F.col("lifecycle") == "ACTIVE") & (F.col("price") > 0)
    n_raw = raws.groupBy("product_id").agg(F.count(F.lit(1)).alias("raw_product_count"))
    n_live = offers.where(live).groupBy("product_id").agg(F.count(F.lit(1)).alias("active_offer_count"))
    products = products.join(n_raw, "product_id", "left").join(n_live, "product_id", "left").fillna(0, ["raw_product_count", "active_offer_count"])
    return {"products": products, "variants": kept, "raws": raws, "offers": offers, "history": history, "remap": remap, "variant_remap": variant_remap}


def health_audit(catalog: dict[str, DataFrame], retired: DataFrame | None = None) -> DataFrame:
    """One row: the nine counts that must be 0 after a merge, and `clean`.

    dangling (rows that point at no product or no variant), duplicate variant
    keys, active offers whose variant isn't their raw row's, offers and raw
    rows whose variant is of another product, both counters, quarantined offers
    that are active or shown, retired products that are still there
    (``retired``: id).
    """
    products, variants, raws, offers = (catalog[t] for t in ("products", "variants", "raws", "offers"))
    v = variants.select("variant_id", F.col("product_id").alias("variant_product"))
    p = products.select("product_id", F.lit(True).alias("there"))

    def points(df: DataFrame) -> DataFrame:
        at = df.select("product_id", "variant_id").join(p, "product_id", "left").join(v, "variant_id", "left")
        lost = (F.col("product_id").isNotNull() & F.col("there").isNull()) | (F.col("variant_id").isNotNull() & F.col("variant_product").isNull())
        return at.agg(F.count_if(lost).alias("lost"), F.count_if(F.col("variant_product") != F.col("product_id")).alias("wrong"))

    of_raw, of_offer, of_history = points(raws), points(offers), points(catalog["history"])
    homeless = variants.join(p, "product_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    double = variants.groupBy("product_id", "variant_key").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    theirs = raws.select("raw_id", F.col("variant_id").alias("raw_variant"))
    drift = offers.where("active").join(theirs, "raw_id").agg(F.count_if(F.col("variant_id") != F.col("raw_variant")).alias("n"))
    live = F.col("active") & ~F.col("hidden") & (F.col("lifecycle") == "ACTIVE") & (F.col("price") > 0)
    counted = products.select("product_id", "raw_product_count", "active_offer_count")
    counted = counted.join(raws.groupBy("product_id").agg(F.count(F.lit(1)).alias("r")), "product_id", "left").join(offers.where(live).groupBy("product_id").agg(F.count(F.lit(1)).alias("o")), "product_id", "left")
    off = counted.agg(F.count_if(F.col("raw_product_count") != F.coalesce("r", F.lit(0))).alias("raw"), F.count_if(F.col("active_offer_count") != F.coalesce("o", F.lit(0))).alias("offer"))
    caught = offers.agg(F.count_if((F.col("lifecycle") == "QUARANTINED") & (F.col("active") | ~F.col("hidden"))).alias("n"))
    left = products.join(retired.select(F.col("id").alias("product_id")), "product_id", "left_semi").agg(F.count(F.lit(1)).alias("n")) if retired is not None else None
    named = [
        of_raw.select(F.col("lost").alias("a"), F.col("wrong").alias("raw_variant_wrong_product")), of_offer.select(F.col("lost").alias("b"), F.col("wrong").alias("offer_variant_wrong_product")), of_history.select(F.col("lost").alias("c")),
        homeless.select(F.col("n").alias("d")), double.select(F.col("n").alias("duplicate_variant_keys")), drift.select(F.col("n").alias("active_variant_drift")),
        off.select(F.col("raw").alias("raw_counter_drift"), F.col("offer").alias("active_offer_counter_drift")), caught.select(F.col("n").alias("quarantine_violations")),
        *([left.select(F.col("n").alias("retired_rows_remaining"))] if left is not None else []),
    ]
    one = reduce(lambda a, b: a.join(b, "_"), [_keyed(d) for d in named]).drop("_")
    if left is None:
        one = one.withColumn("retired_rows_remaining", F.lit(0).cast("bigint"))
    one = one.withColumn("dangling", F.col("a") + F.col("b") + F.col("c") + F.col("d")).drop("a", "b", "c", "d")
    return one.withColumn("clean", reduce(lambda x, y: x & y, [F.col(c) == 0 for c in one.columns]))


def _keyed(df: DataFrame) -> DataFrame:
    """A table of one row, with the key that all such tables share."""
    return df.withColumn("_", F.lit(0))


# --- watches ----------------------------------------------------------------------


def _watch_source(brand: Column, text: Column) -> Column:
    """source and whole (has a variant) of the watch that a folded text names; null without one."""
    hit = F.coalesce(*[F.when(F.regexp_extract(text, p, 0) != "", F.struct(F.lit(i).alias("i"), F.regexp_extract(text, p, 0).alias("m"))) for i, (p, _, _) in enumerate(WATCH_FAMILIES)])

    def packed(h: Column) -> Column:
        pick = lambda of: F.coalesce(*[F.when(h["i"] == i, of(*f)) for i, f in enumerate(WATCH_FAMILIES)])
        family = pick(lambda p, before, _: F.concat(F.lit(before), F.regexp_replace(F.regexp_extract(h["m"], p, 1), r"^(gt|fit)\s*", "$1 ")))
        made = F.when(brand != "", brand).otherwise(pick(lambda p, _, maker: F.lit(maker)))
        variant = pick(lambda p, _, __: F.regexp_extract(h["m"], p, 2))
        return F.when(h.isNotNull(), F.struct(F.concat(F.lit("identity_v3:brand="), made, F.lit("|family="), family, F.when(variant != "", F.concat(F.lit("|variant="), variant)).otherwise("")).alias("source"), (variant != "").alias("whole")))

    return let(hit, packed)


def strongest_watch(brand: Column, texts: list[Column], worn: Column) -> Column:
    """The identity that the fields of a row speak for most: one with a variant before one without, then the later field.

    A field speaks if the row's category is of watches (``worn``) or the word
    stands in it.  ``brand`` and ``texts`` are `normalize_token`.  Null if none
    speaks.
    """

    def told(i: int, text: Column) -> Column:
        speaks = F.when(worn | F.concat(F.lit(" "), text, F.lit(" ")).contains(" watch "), text)
        return let(_watch_source(brand, speaks), lambda w: F.when(w.isNotNull(), F.struct((F.when(w["whole"], 200).otherwise(100) + i).alias("strength"), w["source"].alias("source"))))

    return F.array_max(F.array_compact(F.array(*[told(i, t) for i, t in enumerate(texts)])))["source"]


def converge_watches(rows: DataFrame, texts: list[str], id_col: str = "group_id", key: str = "group_key", source: str = "identity_source") -> DataFrame:
    """id, survivor_id, outcome, new_key, new_source of every row whose fields name a watch.

    Rows that elect one identity are one watch.  The survivor is the smallest
    id that already holds both the canonical key and the source, else the
    smallest that holds the source, else the smallest.  It takes the canonical
    key: `updated` if it had another key or source, else `kept`; the others are
    `merged` and vacate their keys (merged:<id>:<key>, 255 signs), the one that
    held the canonical key first of all.  Reads brand and category too.
    """
    folded = rows.select(
        F.col(id_col).alias("id"), F.coalesce(key, F.lit("")).alias("key"), F.trim(F.coalesce(source, F.lit(""))).alias("held"), normalize_token(F.col("brand")).alias("own"),
        normalize_token(F.col("category")).rlike("akilli saat|giyilebilir teknoloji").alias("worn"), *[normalize_token(F.col(t)).alias(f"t{i}") for i, t in enumerate(texts)],
    )
    elected = strongest_watch(F.col("own"), [F.col(f"t{i}") for i in range(len(texts))], F.col("worn"))
    found = staged(folded.select("id", "key", "held", elected.alias("new_source")).where("new_source is not null"), "watches")
    found = found.withColumn("new_key", identity_key(F.col("new_source")))
    same = F.col("held") == F.col("new_source")
    best = F.coalesce(F.min(F.when(same & (F.col("key") == F.col("new_key")), F.col("id"))), F.min(F.when(same, F.col("id"))), F.min("id"))
    out = found.join(found.groupBy("new_source").agg(best.alias("survivor_id")), "new_source")
    mine = F.col("id") == F.col("survivor_id")
    settled = same & (F.col("key") == F.col("new_key"))
    outcome = F.when(~mine, "merged").when(settled, "kept").otherwise("updated")
    vacated = F.substring(F.concat(F.lit("merged:"), F.col("id"), F.lit(":"), F.col("key")), 1, 255)
    return out.select("id", "survivor_id", outcome.alias("outcome"), F.when(mine, F.col("new_key")).otherwise(vacated).alias("new_key"), "new_source")


# --- accessories --------------------------------------------------------------------


def converge_accessories(products: DataFrame, raws: DataFrame, groups: DataFrame) -> DataFrame:
    """product_id, reasons, repaired, new_brand, new_family, new_key, new_source, raw_rows, group_rows of every checked product.

    A product that carries the brand it only fits (`FITTED_BRANDS`) is checked
    if it has MATCHED raw rows and all of them are accessories.  It is repaired
    only if nothing speaks against it; the reasons otherwise: the raw rows
    disagree in key, source or brand, the brand is again one that is fitted,
    the family is another, the new identity belongs to another active product,
    a group of the old source has another brand or model, or the new group key
    belongs to another group.  A product whose brand is right already isn't
    listed.

    ``products``: product_id, brand, family, identity_key, identity_source,
    status; ``raws``: product_id, status, p (a parsed title); ``groups``:
    group_id, group_key, identity_source, brand, model.  All tests are joins
    and aggregates; texts are folded as in identities.
    """
    checked = products.where((F.col("status") == "ACTIVE") & F.col("brand").isin(*FITTED_BRANDS))
    told = raws.where("status = 'MATCHED'").select("product_id", (F.col("p.kind") == "accessory").alias("part"), I.identity_source(F.col("p")).alias("source"), F.col("p.brand").alias("b"), F.col("p.family").alias("f"))
    told = told.withColumn("key", identity_key(F.col("source")))
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != "")
    told = told.groupBy("product_id").agg(
        F.min("part").alias("all_parts"), one("key").alias("one_key"), one("source").alias("one_source"), one("b").alias("one_brand"), (F.min("f") == F.max("f")).alias("one_family"), F.min("source").alias("new_source"),
        F.min("key").alias("new_key"), F.min("b").alias("new_brand"), F.min("f").alias("new_family"), F.count(F.lit(1)).alias("raw_rows"),
    )
    rows = checked.join(told.where("all_parts"), "product_id")
    right = F.col("one_brand") & (F.col("new_brand") == normalize_token(F.col("brand")))
    rows = rows.where(~right)

    live = products.where("status = 'ACTIVE'")
    owned = lambda c, n: live.where(f"{c} <> ''").groupBy(F.col(c).alias(f"new_{n}")).agg(F.count(F.lit(1)).alias(f"{n}_owners"))
    rows = rows.join(owned("identity_key", "key"), "new_key", "left").join(owned("identity_source", "source"), "new_source", "left")
    mine = lambda held, new: F.when(F.col(held) == F.col(new), 1).otherwise(0)
    taken = (F.coalesce("key_owners", F.lit(0)) > mine("identity_key", "new_key")) | (F.coalesce("source_owners", F.lit(0)) > mine("identity_source", "new_source"))

    named = groups.where("identity_source <> ''").select("group_id", "group_key", "identity_source", normalize_token(F.col("brand")).alias("gb"), normalize_token(F.col("model")).alias("gm"))
    held = rows.select("product_id", "identity_source", "new_brand", "new_key", normalize_token(F.col("family")).alias("own")).join(named, "identity_source")
    held = held.groupBy("product_id").agg(
        F.max(~F.col("gb").isin("") & (F.col("gb") != F.col("new_brand"))).alias("other_brand"), F.max((F.col("gm") != "") & (F.col("gm") != F.col("own"))).alias("other_model"),
        F.count_if(F.col("group_key") == F.col("new_key")).alias("own_keys"), F.count(F.lit(1)).alias("group_rows"),
    )
    keys = groups.groupBy(F.col("group_key").alias("new_key")).agg(F.count(F.lit(1)).alias("group_owners"))
    rows = rows.join(held, "product_id", "left").join(keys, "new_key", "left")

    against = {
        "RAW_IDENTITY_KEY_DISAGREEMENT": ~F.col("one_key"), "RAW_IDENTITY_SOURCE_DISAGREEMENT": ~F.col("one_source"), "RAW_BRAND_DISAGREEMENT": ~F.col("one_brand"),
        "NO_NON_COMPATIBILITY_BRAND_EVIDENCE": F.col("new_brand").isin(*FITTED_BRANDS), "FAMILY_CONFLICT": ~F.col("one_family") | (normalize_token(F.col("family")) != F.col("new_family")),
        "GLOBAL_PRODUCT_COLLISION": taken, "PRODUCT_GROUP_BRAND_CONFLICT": F.coalesce("other_brand", F.lit(False)), "PRODUCT_GROUP_MODEL_CONFLICT": F.coalesce("other_model", F.lit(False)),
        "PRODUCT_GROUP_COLLISION": F.coalesce("group_owners", F.lit(0)) > F.coalesce("own_keys", F.lit(0)),
    }
    reasons = F.array_compact(F.array(*[F.when(held_, F.lit(reason)) for reason, held_ in against.items()]))
    out = rows.select("product_id", reasons.alias("reasons"), "new_brand", "new_family", "new_key", "new_source", "raw_rows", F.coalesce("group_rows", F.lit(0)).alias("group_rows"))
    return out.withColumn("repaired", F.size("reasons") == 0)


# --- references and evidence -----------------------------------------------------------


def variant_drift(offers: DataFrame, raws: DataFrame, variants: DataFrame) -> DataFrame:
    """offer_id, old_variant_id, new_variant_id, reasons, repaired of each active offer whose variant isn't its MATCHED raw row's.

    The offer takes the raw row's variant only if both variants are there and
    of the offer's product, as the raw row is, their model codes don't
    conflict, and no known colour or network is lost or changed.  What fails is
    listed with its reasons and left as it is.
    """
    word = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " "))), F.lit(""))
    side = lambda name: variants.select(F.col("variant_id").alias(f"{name}_variant_id"), F.struct("product_id", *[word(c).alias(c) for c in ("model_code", "color", "network")]).alias(name))
    raw = raws.where((F.col("status") == "MATCHED") & F.col("variant_id").isNotNull()).select("raw_id", F.col("variant_id").alias("new_variant_id"), F.col("product_id").alias("raw_product_id"))
    mine = offers.where(F.col("active") & F.col("variant_id").isNotNull()).select("offer_id", "raw_id", "product_id", F.col("variant_id").alias("old_variant_id"))
    rows = mine.join(raw, "raw_id").where("old_variant_id <> new_variant_id").join(side("old"), "old_variant_id", "left").join(side("new"), "new_variant_id", "left")
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    other = lambda c: F.coalesce(F.col(c) != F.col("product_id"), F.lit(True))
    changed = lambda c: F.col(f"old.{c}").isNotNull() & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    against = {
        "MISSING_VARIANT": ~there, "RAW_GLOBAL_PRODUCT_MISMATCH": there & other("raw_product_id"), "OLD_VARIANT_GLOBAL_PRODUCT_MISMATCH": there & other("old.product_id"), "NEW_VARIANT_GLOBAL_PRODUCT_MISMATCH": there & other("new.product_id"),
        "MODEL_CONFLICT": there & (F.col("old.model_code") != F.col("new.model_code")), "COLOR_CONFLICT_OR_LOSS": there & changed("color"), "NETWORK_CONFLICT_OR_LOSS": there & changed("network"),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(held, F.lit(False)), F.lit(reason)) for reason, held in against.items()]))
    return rows.select("offer_id", "old_variant_id", "new_variant_id", reasons.alias("reasons")).withColumn("repaired", F.size("reasons") == 0)


def relinked(rows: DataFrame, drift: DataFrame) -> DataFrame:
    """``rows`` (offers or their history: offer_id, variant_id, ...) with the repaired offers' new variants; `relinked` marks those that changed."""
    new = drift.where("repaired").select("offer_id", "new_variant_id")
    at = rows.join(new, "offer_id", "left")
    changed = F.col("new_variant_id").isNotNull() & ~F.col("new_variant_id").eqNullSafe(F.col("variant_id"))
    return at.withColumns({"relinked": changed, "variant_id": F.coalesce("new_variant_id", "variant_id")}).drop("new_variant_id")


def without_pseudo_codes(rows: DataFrame, column: str = "model_code") -> DataFrame:
    """``rows`` with model codes that are labels of a specification set to null, and `cleaned` where one was."""
    plain = F.replace(normalize_token(F.col(column)), F.lit(" "), F.lit(""))
    pseudo = F.coalesce(plain.rlike(f"^(?:{'|'.join(I.LABELLED)})$"), F.lit(False))
    return rows.withColumns({column: F.when(~pseudo, F.col(column)), "cleaned": pseudo})
