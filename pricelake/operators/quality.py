"""Quality of records, integrity of references and counters, and what brings them back in line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import text as T


def _has(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def suspicious_price(price: Column, old: Column) -> Column:
    """Not above 0, or the crossed-out price ten times as high, or a discount of 96 % or more."""
    p, o = F.coalesce(price, F.lit(0.0)), F.coalesce(old, F.lit(0.0))
    return (p <= 0) | ((o > 0) & (o >= p * 10)) | ((o > 0) & (p < o) & ((o - p) / o >= 0.96))


def product_issues() -> Column:
    """The codes of the ten checks that a product fails, in their order.

    Reads images, broken_images, brand, model, product_code, category,
    specifications, price, old_price, history_count, score.
    """
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, (_, ok) in _checks().items()]))


def _checks() -> dict[str, tuple[int, Column]]:
    c = F.col
    return {
        "missing_image": (14, c("images") > 0), "thin_gallery": (6, c("images") >= 2), "broken_image": (5, ~c("broken_images")), "missing_brand": (11, _has(c("brand"))),
        "missing_model": (11, _has(c("model")) | _has(c("product_code"))), "missing_category": (11, _has(c("category"))), "missing_specs": (13, _has(c("specifications"))),
        "suspicious_price": (10, ~suspicious_price(c("price"), c("old_price"))), "missing_history": (9, c("history_count") > 0), "low_ai_score": (10, c("score") >= 40),
    }


def product_quality() -> Column:
    """The points of the checks that a product passes, 0 to 100."""
    return sum((F.when(F.coalesce(ok, F.lit(False)), n).otherwise(0) for n, ok in _checks().values()), F.lit(0))


def quality_level(score: Column) -> Column:
    return F.when(score >= 85, "very good").when(score >= 65, "good").when(score >= 45, "needs work").otherwise("weak")


#: What an issue of each severity costs (fixed values).
COSTS = {"critical": 18, "warning": 8, "info": 3}


def offer_checks(now: Column) -> list[tuple[str, str, Column]]:
    """code, severity and whether an offer fails, of the checks in their order.

    Reads store, seller, price, url, availability, shipping, shipping_method,
    delivery_text, warranty_type, installment_text, campaign_text, image,
    brand, model, match_score, seen_at, lifecycle, hidden.
    """
    c = F.col
    unknown = lambda x: ~_has(x) | F.lower(x).isin("unknown", "bilinmiyor")
    age = F.timestamp_diff("SECOND", c("seen_at"), now) / 3600
    score = F.coalesce(c("match_score"), F.lit(0.0))
    checks = [
        ("store_name", "critical", unknown(c("store"))), ("seller", "warning", unknown(c("seller"))), ("price", "critical", F.coalesce(c("price"), F.lit(0.0)) <= 0), ("url", "critical", ~T.valid_url(c("url"))),
        ("availability", "warning", ~_has(c("availability"))), ("shipping", "warning", c("shipping").isNull() & ~_has(c("shipping_method"))), ("delivery", "info", ~_has(c("delivery_text"))),
        ("warranty", "info", ~_has(c("warranty_type"))), ("installment", "info", ~_has(c("installment_text"))), ("campaign", "info", ~_has(c("campaign_text"))), ("image", "warning", ~_has(c("image"))),
        ("brand", "warning", ~_has(c("brand"))), ("model", "warning", ~_has(c("model"))), ("match_score", "warning", score <= 0), ("match_score_low", "critical", (score > 0) & (score < 70)),
        ("last_checked", "warning", c("seen_at").isNull()), ("stale", "critical", age > 48), ("aging", "warning", (age > 24) & (age <= 48)),
        ("lifecycle", "warning", c("lifecycle").isin("MISSING", "ARCHIVED")), ("hidden", "info", c("hidden")),
    ]
    return [(code, level, F.coalesce(bad, F.lit(False))) for code, level, bad in checks]


def offer_issues(now: Column) -> Column:
    """code and severity of what an offer lacks, in the order of `offer_checks`."""
    return F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for code, level, bad in offer_checks(now)]))


def completeness(issues: Column) -> Column:
    """100 less the cost of each issue; 0 at least."""
    cost = lambda i: F.when(i["severity"] == "critical", COSTS["critical"]).when(i["severity"] == "warning", COSTS["warning"]).otherwise(COSTS["info"])
    return F.greatest(F.lit(0), 100 - F.aggregate(issues, F.lit(0), lambda acc, i: acc + cost(i)))


def health_bucket(score: Column, issues: Column) -> Column:
    """broken with two critical issues or under 50, ready from 80 without any, else incomplete."""
    critical = F.size(F.filter(issues, lambda i: i["severity"] == "critical"))
    return F.when((critical >= 2) | (score < 50), "broken").when((critical == 0) & (score >= 80), "ready").otherwise("incomplete")


def health_by_store(offers: DataFrame, now: Column) -> DataFrame:
    """Each store's offers by bucket, mean score, coverage in percent, and its most frequent issue.

    ``offers`` has store_id and what `offer_checks` reads.  Each check is one
    flag a row; scores and buckets are sums of flags, and one aggregate counts
    them all, so no list of issues is made.
    """
    checks = offer_checks(now)
    flags = offers.select("store_id", *[bad.alias(f"no_{code}") for code, _, bad in checks])
    count = lambda level: sum((F.when(F.col(f"no_{code}"), 1).otherwise(0) for code, severity, _ in checks if severity == level), F.lit(0))
    rows = flags.withColumns({level: count(level) for level in COSTS})
    rows = rows.withColumn("score", F.greatest(F.lit(0), 100 - sum((F.col(level) * n for level, n in COSTS.items()), F.lit(0))))
    rows = rows.withColumn("bucket", F.when((F.col("critical") >= 2) | (F.col("score") < 50), "broken").when((F.col("critical") == 0) & (F.col("score") >= 80), "ready").otherwise("incomplete"))
    n = F.col("offers")
    percent = lambda c: F.floor(c / n * 1000 + 0.5) / 10
    out = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("offers"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("ready", "incomplete", "broken")], F.sum("score").alias("points"), *[F.count_if(F.col(f"no_{code}")).alias(f"n_{code}") for code, _, _ in checks],
    )
    often = F.array_max(F.array_compact(F.array(*[F.when(F.col(f"n_{code}") > 0, F.struct(F.col(f"n_{code}").alias("k"), F.lit(code).alias("code"))) for code, _, _ in checks])))
    return out.withColumn("t", often).select(
        "store_id", "offers", "ready", "incomplete", "broken", (F.floor(F.col("points") / n * 10 + 0.5) / 10).alias("score"), percent(F.col("ready")).alias("success_percent"), percent(n - F.col("n_delivery")).alias("delivery_coverage"),
        percent(n - F.col("n_seller")).alias("seller_coverage"), F.col("t.code").alias("top_issue"), F.col("t.k").alias("top_issue_count"),
    )


def listing_fault(name: Column, price: Column, url: Column, shortest: int = 3, longest: int = 500, most: float = 100_000_000.0) -> Column:
    """The first rule a listing breaks: name_short, name_long, price_missing, price_not_positive, price_too_high, url; null if it is valid."""
    n = F.length(F.trim(F.coalesce(name, F.lit(""))))
    p = price.try_cast("double")
    return (
        F.when(n < shortest, "name_short").when(n > longest, "name_long").when(p.isNull(), "price_missing").when(p <= 0, "price_not_positive")
        .when(p > most, "price_too_high").when(~T.valid_url(url), "url")
    )


def rebuilt_counters(products: DataFrame, raw: DataFrame, offers: DataFrame) -> DataFrame:
    """product_id, raw_count, offer_count recounted, and whether the stored counters (raw_count, offer_count of ``products``) differ.

    ``raw`` and ``offers`` (those shown) have product_id.
    """
    of = lambda df, name: df.where("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias(name))
    both = products.join(of(raw, "raw_now"), "product_id", "left").join(of(offers, "offers_now"), "product_id", "left").fillna(0, ["raw_now", "offers_now"])
    drift = (F.coalesce("raw_count", F.lit(0)) != F.col("raw_now")) | (F.coalesce("offer_count", F.lit(0)) != F.col("offers_now"))
    return both.select("product_id", F.col("raw_now").alias("raw_count"), F.col("offers_now").alias("offer_count"), drift.alias("drifted"))


def quarantine_convergence(offers: DataFrame) -> DataFrame:
    """Quarantined offers are neither active nor shown; `changed` marks rows that were."""
    held = F.upper(F.coalesce("lifecycle", F.lit("ACTIVE"))) == "QUARANTINED"
    wrong = held & (F.col("active") | ~F.col("hidden"))
    return offers.withColumns({"changed": wrong, "active": F.col("active") & ~held, "hidden": F.col("hidden") | held})


def restored_offers(offers: DataFrame, before: DataFrame, failed_stores: DataFrame) -> DataFrame:
    """Offers that were active before a refresh and whose store failed in it are active again; `restored` marks them.

    ``before`` has offer_id of the active ones; ``failed_stores`` has store_id.
    """
    was = before.select("offer_id", F.lit(True).alias("was")).distinct()
    failed = failed_stores.select("store_id", F.lit(True).alias("failed")).distinct()
    rows = offers.join(was, "offer_id", "left").join(failed, "store_id", "left")
    back = F.coalesce(F.col("was") & F.col("failed"), F.lit(False)) & ~F.col("active")
    return rows.withColumns({"restored": back, "active": F.col("active") | back, "hidden": F.col("hidden") & ~back}).drop("was", "failed")


def reliability(offers: DataFrame, stored: DataFrame) -> DataFrame:
    """Per product: offers, active ones, stores with one, whether the stored count fits, and whether a store serves more than one.

    ``offers``: product_id, store_id, active; ``stored``: product_id, offer_count.
    """
    by_store = offers.groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("a"))
    out = by_store.groupBy("product_id").agg(
        F.sum("n").alias("offers"), F.sum("a").alias("active_offers"), F.count_if(F.col("a") > 0).alias("active_stores"), F.count_if(F.col("a") > 1).alias("crowded_stores"),
    )
    out = stored.join(out, "product_id", "left").fillna(0, ["offers", "active_offers", "active_stores", "crowded_stores"])
    fits, single = F.col("offer_count") == F.col("active_offers"), F.col("crowded_stores") == 0
    return out.select("product_id", "offers", "active_offers", "active_stores", fits.alias("count_consistent"), single.alias("one_offer_per_store"), (fits & single).alias("serving_consistent"))


def evidence(checks: dict[str, DataFrame], rows: int = 20) -> DataFrame:
    """invariant, violations, ids: for each check (a DataFrame of `id`) that has rows its number and the smallest ids, in a list of ``rows`` at most.

    Checks without rows give none.  The list is a report's sample; the number counts all.
    """
    out = None
    for name, bad in checks.items():
        ids = bad.select(F.col("id").cast("string").alias("id"), F.col("id").alias("_by"))
        first = ids.orderBy("_by").limit(rows).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_by", "id"))), lambda s: s["id"]), ",").alias("ids"))
        counted = ids.agg(F.count(F.lit(1)).alias("violations"))
        one = counted.crossJoin(first).where("violations > 0").select(F.lit(name).alias("invariant"), "violations", "ids")  # one row each
        out = one if out is None else out.unionByName(one)
    return out
