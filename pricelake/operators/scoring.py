"""Scores and verdicts over offers and price history, as Columns and keyed aggregates.

Every function names the columns it reads.  Weights, bands and thresholds are
fixed values of the catalog's rules.  Scores are rounded by double arithmetic:
half up to decimals, half to even to whole points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(c: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def points(c: Column) -> Column:
    """A score as whole points, half to even."""
    return F.rint(c).cast("int")


def banded(value: Column, bands: list[tuple[float, float]], above: float | Column = 0.0) -> Column:
    """The points of the first band whose limit is not below ``value``."""
    out = None
    for limit, won in bands:
        out = F.when(value <= limit, float(won)) if out is None else out.when(value <= limit, float(won))
    return out.otherwise(above if isinstance(above, Column) else float(above))


def from_top(value: Column, bands: list[tuple[float, float]], below: float = 0.0) -> Column:
    """The points of the first band whose limit ``value`` reaches."""
    out = None
    for limit, won in bands:
        out = F.when(value >= limit, float(won)) if out is None else out.when(value >= limit, float(won))
    return out.otherwise(float(below))


def percent_change(current: Column, reference: Column) -> Column:
    """(current - reference) / reference in percent, two decimals; null without a positive reference."""
    return F.when(reference > 0, half_up((current - reference) / reference * 100, 2))


# --- offers -----------------------------------------------------------------


def offer_score(offers: DataFrame, age: Column) -> DataFrame:
    """`offer_score` of available offers, 0 to 100, with the parts that the columns allow.

    Reads product_id, total, shipping; official, rating, match_score,
    delivery_text, campaign_text, installment_text, sponsored where they
    exist: a missing column gives no points.  ``age`` is in hours.
    """
    by = Window.partitionBy("product_id")
    low, high = F.min("total").over(by), F.max("total").over(by)
    price = F.when(high > low, clamp(42 * (high - F.col("total")) / (high - low), 0, 42)).otherwise(42.0)
    score = price + banded(F.col("shipping"), [(0, 14), (75, 8), (150, 4)]) + banded(age, [(3, 10), (12, 8), (24, 6), (48, 3)])
    has = set(offers.columns)
    if "official" in has:
        score = score + F.when(F.col("official"), 12.0).otherwise(0.0)
    if "rating" in has:
        score = score + F.when(F.col("rating") > 0, F.least(F.lit(10.0), F.col("rating") * 2)).otherwise(0.0)
    if "match_score" in has:
        score = score + from_top(F.col("match_score"), [(95, 8), (85, 6), (70, 3)])
    for text, won in (("delivery_text", 2.0), ("campaign_text", 1.0), ("installment_text", 1.0)):
        if text in has:
            score = score + F.when(F.coalesce(F.col(text), F.lit("")) != "", won).otherwise(0.0)
    if "sponsored" in has:
        score = score - F.when(F.col("sponsored"), 2.0).otherwise(0.0)
    return offers.withColumn("offer_score", half_up(clamp(score, 0, 100), 1)).withColumn("is_cheapest", F.col("total") == low)


def rank_by_score(offers: DataFrame, age: Column, id_cols: tuple[str, ...] = ("store_id",)) -> DataFrame:
    """`offer_score` and `rank` inside the product: by score, then total, then id."""
    order = Window.partitionBy("product_id").orderBy(F.desc("offer_score"), "total", *id_cols)
    return offer_score(offers, age).withColumn("rank", F.row_number().over(order))


def store_quality(offers: Column, active: Column, shipping: Column, delivery: Column, official: Column, priced: Column) -> Column:
    """Coverage of a store's offers, 0 to 100: each ratio in percent with one decimal, weighted .30 .30 .15 .15 .10."""
    whole = F.greatest(offers, F.lit(1))
    share = lambda c: half_up(c / whole * 100, 1)
    score = share(active) * 0.30 + share(priced) * 0.30 + share(shipping) * 0.15 + share(delivery) * 0.15 + share(official) * 0.10
    return clamp(F.rint(score), 0, 100).cast("int")


# --- history ----------------------------------------------------------------


def deal_parts(best: Column, saving: Column, offers: Column, average: Column, lowest: Column, trend: Column, change: Column, fake: Column) -> list[Column]:
    """The seven parts of a deal score, each with one decimal."""
    under = F.when((best > 0) & (average > 0), (average - best) / average * 100).otherwise(0.0)
    distance = F.when((best > 0) & (lowest > 0), (best - lowest) / lowest * 100)
    parts = [
        F.lit(30.0),
        F.when(saving > 0, F.least(saving * 1.2, F.lit(22.0))).otherwise(0.0),
        F.when(under > 0, F.least(under * 1.4, F.lit(22.0))).otherwise(F.greatest(under * 0.6, F.lit(-10.0))),
        F.when(distance <= 0.5, 10.0).when(distance <= 3, 7.0).when(distance <= 7, 3.0).when(distance >= 15, -5.0).otherwise(0.0),
        F.when(trend == "falling", F.least(5 + F.abs(change) * 0.5, F.lit(10.0)))
        .when(trend == "stable", 4.0)
        .when(trend == "rising", F.greatest(-5 - change * 0.4, F.lit(-10.0)))
        .otherwise(0.0),
        from_top(offers, [(6, 6), (4, 5), (2, 3), (1, 1)]),
        F.when(fake, -18.0).otherwise(0.0),
    ]
    return [half_up(p, 1) for p in parts]


def deal_score(best: Column, saving: Column, offers: Column, average: Column, lowest: Column, trend: Column, change: Column, fake: Column) -> Column:
    parts = deal_parts(best, saving, offers, average, lowest, trend, change, fake)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return points(clamp(total, 0, 100))


def deal_confidence(records: Column, offers: Column, average: Column, lowest: Column) -> Column:
    known = F.when((average > 0) & (lowest > 0), 15.0).otherwise(0.0)
    seen = from_top(records, [(12, 55), (6, 42), (3, 28), (1, 12)])
    return clamp(seen + from_top(offers, [(5, 30), (3, 22), (2, 15), (1, 7)]) + known, 0, 100).cast("int")


def deal_label(score: Column) -> Column:
    return F.when(score >= 85, "very good").when(score >= 70, "good").when(score >= 55, "average").when(score >= 40, "weak").otherwise("unfit")


def early_deal_score(best: Column, saving: Column, offers: Column, average: Column, trend: Column, fake: Column) -> Column:
    """The older score: 45 and up to 25, 20, 10, 5 points, less 20 for a doubtful discount."""
    score = F.lit(45.0) + F.when(saving > 0, F.least(saving * 1.5, F.lit(25.0))).otherwise(0.0)
    below = (best > 0) & (average > 0) & (best < average)
    score = score + F.when(below, F.least((average - best) / average * 100 * 1.4, F.lit(20.0))).otherwise(0.0)
    score = score + F.when(trend == "falling", 10.0).when(trend == "stable", 4.0).when(trend == "rising", -10.0).otherwise(0.0)
    return points(clamp(score - F.when(fake, 20.0).otherwise(0.0) + from_top(offers, [(4, 5), (2, 3)]), 0, 100))


def deal_badge(current: Column, low: Column, average: Column, saving: Column, records: Column) -> Column:
    """super, good, new, high or normal."""
    distance = F.when((current > 0) & (low > 0), F.greatest(F.lit(0.0), (current - low) / low * 100)).otherwise(100.0)
    over = F.when((current > 0) & (average > 0), (current - average) / average * 100).otherwise(0.0)
    return (
        F.when((records >= 2) & (distance <= 1) & (over <= 0), "super")
        .when(((records >= 2) & (distance <= 5)) | (saving >= 8), "good")
        .when(records < 2, "new")
        .when(over > 8, "high")
        .otherwise("normal")
    )


def price_analysis_score(current: Column, avg30: Column, avg90: Column, low90: Column, offers: Column, records: Column) -> Column:
    """50, moved by the price against the 30 and 90 day means, its distance to the 90 day low, and the number of offers."""
    v30, v90, far = percent_change(current, avg30), percent_change(current, avg90), percent_change(current, low90)
    score = F.lit(50.0) + F.coalesce(clamp(-v30 * 2.5, -20, 25), F.lit(0.0)) + F.coalesce(clamp(-v90 * 1.5, -12, 15), F.lit(0.0))
    score = score + F.coalesce(clamp(20 - far * 2.0, -18, 20), F.lit(0.0))
    score = score + F.when(offers >= 2, F.least(F.lit(8.0), (offers - 1) * 2.0)).otherwise(0.0)
    return clamp(F.rint(F.when(records < 3, F.least(score, F.lit(60.0))).otherwise(score)), 0, 100).cast("int")


def price_analysis_label(score: Column, records: Column) -> Column:
    return F.when(records < 3, "new").when(score >= 90, "super").when(score >= 75, "good").when(score >= 55, "normal").otherwise("high")


def deal_verdict(score: Column, records: Column, trend: Column) -> Column:
    """What to do, by the analysis score, how many prices stand behind it, and the trend."""
    plain = F.when(score >= 85, "strong buy").when(score >= 70, "buy").when(score >= 55, "by need").otherwise("wait for a better price")
    return (
        F.when(records < 3, "watch with an alarm")
        .when((trend == "falling") & (score < 85), "wait a little")
        .when((trend == "rising") & (score >= 70), "do not delay")
        .otherwise(plain)
    )


def insight(current: Column, average: Column, lowest: Column, highest: Column, records: Column, trend: Column) -> dict[str, Column]:
    """average_difference, low_distance and range_position in percent, and the action they advise."""
    over = F.when((current > 0) & (average > 0), (current - average) / average * 100).otherwise(0.0)
    far = F.when((current > 0) & (lowest > 0), (current - lowest) / lowest * 100).otherwise(0.0)
    inside = (highest > lowest) & (lowest > 0) & (current > 0)
    place = F.when(inside, clamp((current - lowest) / F.nullif(highest - lowest, F.lit(0.0)) * 100, 0, 100)).otherwise(0.0)
    action = (
        F.when(records < 3, "keep watching")
        .when((far <= 3) & (over <= 0) & (trend != "rising"), "buy now")
        .when((trend == "falling") & (far > 5), "wait a little")
        .when((over > 5) | (far > 12), "wait for a better price")
        .when((trend == "rising") & (far <= 5), "by need")
        .otherwise("watch with an alarm")
    )
    return {"average_difference": half_up(over, 2), "low_distance": half_up(far, 2), "range_position": half_up(place, 2), "action": action}


def forecast(current: Column, volatility: Column, trend: Column, records: Column) -> dict[str, Column]:
    """days_7, days_30, low, high and confidence: drift by trend, a band of 2.5 to 12 % by volatility (.04 if unknown)."""
    week = F.when(trend == "falling", -0.012).when(trend == "rising", 0.012).otherwise(-0.002)
    month = F.when(trend == "falling", -0.028).when(trend == "rising", 0.032).otherwise(-0.006)
    band = clamp(F.coalesce(volatility, F.lit(0.04)) * 1.6, 0.025, 0.12)
    known = current > 0
    d30 = current * (1 + month)
    return {
        "days_7": F.when(known, half_up(current * (1 + week), 2)),
        "days_30": F.when(known, half_up(d30, 2)),
        "low": F.when(known, half_up(d30 * (1 - band), 2)),
        "high": F.when(known, half_up(d30 * (1 + band), 2)),
        "confidence": F.when(known, F.least(F.lit(88), 38 + F.least(records, F.lit(15)) * 3)).otherwise(0).cast("int"),
    }


def rise_risk(current: Column, average: Column, volatility_percent: Column, trend: Column, records: Column) -> Column:
    """The risk that the price rises, 8 to 92; 50 with under three prices."""
    risk = F.lit(50.0) + F.when(trend == "rising", 22.0).when(trend == "falling", -16.0).otherwise(0.0)
    risk = risk + F.when(current < average * 0.96, 12.0).when(current > average * 1.08, -8.0).otherwise(0.0)
    risk = clamp(F.rint(risk + F.least(F.lit(12.0), volatility_percent * 1.5)), 8, 92)
    return F.when((records < 3) | (current <= 0), 50.0).otherwise(risk).cast("int")


def volatility_class(volatility_percent: Column) -> Column:
    return F.when(volatility_percent < 2.5, "low").when(volatility_percent < 6, "middle").otherwise("high")


def opportunity_score(current: Column, low: Column, average: Column, offers: Column, saving: Column, trend: Column, base: Column | float = 50.0) -> Column:
    distance = F.when((current > 0) & (low > 0), (current - low) / low * 100)
    delta = F.when((current > 0) & (average > 0), (current - average) / average * 100)
    base = base if isinstance(base, Column) else F.lit(base)
    score = base + F.when(distance <= 2, 14.0).when(distance <= 5, 9.0).when(distance <= 10, 3.0).when(distance >= 20, -16.0).when(distance >= 15, -10.0).otherwise(0.0)
    score = score + F.when(delta <= -10, 12.0).when(delta <= -5, 8.0).when(delta >= 12, -12.0).when(delta >= 7, -7.0).otherwise(0.0)
    score = score + F.when(offers >= 5, 7.0).when(offers >= 3, 4.0).when(offers <= 1, -4.0).otherwise(0.0)
    score = score + from_top(saving, [(12, 6), (6, 3)]) + F.when(trend == "falling", 3.0).when(trend == "rising", -5.0).otherwise(0.0)
    return points(clamp(score, 0, 100))


def buy_decision(score: Column, records: Column) -> Column:
    return F.when(records < 2, "watch").when(score >= 85, "buy").when(score >= 70, "consider").when(score >= 50, "watch").otherwise("wait")


def wait_days(score: Column, records: Column, risk: Column) -> Column:
    return F.when((records < 2) | (score >= 70), None).when(score >= 50, F.when(risk < 70, 7).otherwise(3)).otherwise(10)


def purchase_confidence(records: Column, offers: Column) -> Column:
    return F.least(F.lit(95), 40 + 4 * F.least(records, F.lit(12)) + 3 * F.least(offers, F.lit(5))).cast("int")


# --- products ---------------------------------------------------------------


def discount_part(percent: Column) -> Column:
    """Up to 45 points, linear between 0, 5, 10, 20, 30 and 40 percent."""
    return (
        F.when(percent <= 0, 0.0)
        .when(percent < 5, percent * 0.5)
        .when(percent < 10, 2.5 + (percent - 5) / 5 * 7.5)
        .when(percent < 20, 10.0 + (percent - 10) / 10 * 15.0)
        .when(percent < 30, 25.0 + (percent - 20) / 10 * 12.0)
        .when(percent < 40, 37.0 + (percent - 30) / 10 * 8.0)
        .otherwise(45.0)
    )


def rating_part(rating: Column) -> Column:
    """Up to 20 points for a rating of 0 to 5."""
    r = clamp(rating, 0, 5)
    return F.when(r < 3, r / 3.0 * 4.0).when(r < 4, 4.0 + (r - 3) * 8.0).otherwise(12.0 + (r - 4) * 8.0)


def review_part(reviews: Column) -> Column:
    """Up to 15 points by the logarithm of the number of reviews, full at 5,000."""
    return F.when(reviews <= 0, 0.0).otherwise(clamp(F.log10(reviews + 1) / F.log10(F.lit(5001.0)) * 15.0, 0, 15))


def product_score(price: Column, discount: Column, rating: Column, reviews: Column, stock: Column, seller: Column, quality: Column) -> Column:
    """45 + 20 + 15 + 8 + 7 + 5 points; 0 without a price. The last three parts come as points."""
    total = discount_part(discount) + rating_part(rating) + review_part(reviews) + stock + seller + quality
    return F.when(price <= 0, 0).otherwise(points(clamp(total, 0, 100)))


def numeric_similarity(a: Column, b: Column, tolerance: float = 0.25) -> Column:
    """1 for equal numbers, falling to 0 at a relative difference of ``tolerance``; null if either is."""
    most = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / most / max(tolerance, 0.01)))


def price_similarity(a: Column, b: Column) -> Column:
    """1 for equal prices, 0 from a ratio of 2.5 on; null unless both are above 0."""
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(F.log(F.greatest(b / a, F.lit(0.01)))) / F.log(F.lit(2.5)))
    return F.when((a > 0) & (b > 0), near)


def recommendation_score(similarity: Column, deal: Column, price_difference: Column, offers: Column, confidence: Column) -> Column:
    """.55 similarity, .20 deal, .15 price, .05 stores, .05 confidence, each 0 to 100; one decimal."""
    price = F.when(price_difference <= 0, clamp(70.0 + F.abs(price_difference) * 1.5, 0, 100)).otherwise(clamp(70.0 - price_difference * 2.0, 0, 100))
    stores = clamp(F.greatest(F.lit(0), offers) / 5.0 * 100.0, 0, 100)
    score = clamp(similarity, 0, 100) * 0.55 + clamp(deal, 0, 100) * 0.20 + price * 0.15 + stores * 0.05 + clamp(confidence, 0, 100) * 0.05
    return half_up(clamp(score, 0, 100), 1)


def recommendation_bucket(score: Column, similarity: Column, deal: Column, price_difference: Column, confidence: Column) -> Column:
    return (
        F.when((confidence < 35) | (similarity < 45), "insufficient_data")
        .when((price_difference <= -3) & (similarity >= 60), "cheaper_same_performance")
        .when((deal >= 75) & (score >= 70), "best_value")
        .when(price_difference.between(3, 35) & (similarity >= 65), "upgrade")
        .when(similarity >= 58, "safe_alternative")
        .otherwise("insufficient_data")
    )


def sort_metrics(candidates: DataFrame) -> DataFrame:
    """price_drop_percent, popularity_score and best_value_score of each candidate.

    Reads price, old_price, offers, members, relevance.  The least and greatest
    price come from a one-row aggregate, so nothing is gathered in one task.
    """
    priced = F.when(F.col("price") > 0, F.col("price"))
    ends = candidates.agg(F.coalesce(F.min(priced), F.lit(0.0)).alias("least"), F.coalesce(F.max(priced), F.lit(0.0)).alias("most"))
    rows = candidates.crossJoin(F.broadcast(ends))  # one row
    span = F.greatest(F.col("most") - F.col("least"), F.lit(1.0))
    drop = F.when((F.col("old_price") > F.col("price")) & (F.col("price") > 0), (F.col("old_price") - F.col("price")) / F.col("old_price") * 100).otherwise(0.0)
    relevance = clamp(F.col("relevance").cast("double"), 0, 100)
    advantage = F.when((F.col("price") > 0) & (F.col("most") > F.col("least")), clamp((F.col("most") - F.col("price")) / span * 100, 0, 100)).otherwise(50.0)
    popular = F.least(F.lit(100.0), F.col("offers") * 12.0 + F.col("members") * 2.0 + relevance * 0.35)
    value = relevance * 0.40 + advantage * 0.35 + F.least(F.lit(100.0), F.col("offers") * 18.0) * 0.15 + F.least(drop * 3.0, F.lit(100.0)) * 0.10
    metrics = {"price_drop_percent": half_up(drop, 2), "popularity_score": half_up(popular, 2), "best_value_score": half_up(value, 2)}
    return rows.withColumns(metrics).drop("least", "most")


def sort_order(mode: str) -> list[Column]:
    """The order of a candidate list (`sort_metrics`) for one of eight modes; all end in the name, unknown modes are relevance."""
    name, price = F.lower("name"), F.when(F.col("price") > 0, F.col("price")).otherwise(F.lit(0.0))
    return {
        "price_asc": [price.asc(), name.asc()],
        "price_desc": [price.desc(), name.asc()],
        "stores": [F.desc("offers"), F.desc("relevance"), name.asc()],
        "price_drop": [F.desc("price_drop_percent"), price.asc(), name.asc()],
        "popular": [F.desc("popularity_score"), F.desc("offers"), name.asc()],
        "best_value": [F.desc("best_value_score"), price.asc(), name.asc()],
        "newest": [F.desc("updated_at"), name.asc()],
    }.get(mode, [F.desc("relevance"), F.desc("offers"), price.asc(), name.asc()])


def refresh_priority(products: DataFrame, offers: DataFrame, age: Column, stale_hours: float) -> DataFrame:
    """product_id, stores, fresh_stores, offers, age_hours, priority of products whose offers are worth another look.

    ``offers`` are those shown, one row for each product and store.  10,000
    without offers, 1,000 for each store under five, 750 without a fresh store,
    and up to 720 for hours of age; left out with five fresh stores and a fresh sighting.
    """
    rows = offers.select("product_id", age.alias("age"))
    stats = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("offers"), F.count_if(F.col("age") <= stale_hours).alias("fresh_stores"), F.min("age").alias("age"))
    out = products.select("product_id").join(stats, "product_id", "left").fillna(0, ["offers", "fresh_stores"])
    hours = F.coalesce(F.greatest(F.lit(0.0), F.col("age")), F.lit(9999.0))
    due = ~((F.col("fresh_stores") >= 5) & (hours < max(1.0, stale_hours)))
    priority = F.when(F.col("offers") == 0, 10000.0).otherwise(0.0) + F.greatest(F.lit(0), 5 - F.col("offers")) * 1000.0
    priority = priority + F.when(F.col("fresh_stores") == 0, 750.0).otherwise(0.0) + F.least(hours, F.lit(720.0))
    return out.where(due).select("product_id", F.col("offers").alias("stores"), "fresh_stores", "offers", half_up(hours, 2).alias("age_hours"), half_up(priority, 2).alias("priority"))
