"""Scores and verdicts for every product: ranking, deals, analysis, forecast, assistant, sorting, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import history as H
from pricelake.operators import offers as O
from pricelake.operators import scoring as S
from pricelake.sources.tables import NOW, SQL_CUR, SQL_OBS, current_offers, observations, products, read, stores

STALE = 24 * 400.0
#: Hours of age in the data are scaled so that all bands of freshness occur.
AGE_SCALE = 1000.0


def _age() -> Column:
    return O.age_hours(NOW) / AGE_SCALE


def detailed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current offers with the details that a ranking reads.

    Stand-ins: a store with a balance of 5,000 is official, odd line numbers
    have a delivery text, line 7 is sponsored.
    """
    official = stores(spark, sf_dir).select("store_id", (F.col("balance") >= 5000).alias("official"))
    rows = current_offers(spark, sf_dir).join(official, "store_id")
    return rows.withColumns({"delivery_text": F.when(F.col("line") % 2 == 1, "next day"), "sponsored": F.col("line") == 7})


def offer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every serving offer's score of 100 and its rank inside the product."""
    ranked = S.rank_by_score(detailed_offers(spark, sf_dir).where(O.serving()), _age())
    return ranked.select("product_id", "store_id", "total", "offer_score", "is_cheapest", "rank")


def store_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every store with its nation, offers, categories and prices, and the quality of its data.

    A (product, store) is one offer, so offers are products.  Offers are folded
    to (store, category) before they are counted by store.
    """
    o = detailed_offers(spark, sf_dir).join(products(spark, sf_dir).select("product_id", "category"), "product_id")
    fine = o.groupBy("store_id", "category").agg(
        F.count(F.lit(1)).alias("offers"), F.count_if(O.serving()).alias("active"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.count_if(F.col("shipping") > 0).alias("shipping"), F.count("delivery_text").alias("delivery"), F.count_if("official").alias("official"),
        F.count_if(F.col("price") > 0).alias("priced"),
    )
    counts = ("offers", "active", "shipping", "delivery", "official", "priced")
    agg = fine.groupBy("store_id").agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("categories"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"))
    s = stores(spark, sf_dir).join(nation, "nation_id", "left").join(agg, "store_id", "left").fillna(0, [*counts, "categories"])
    quality = S.store_quality(*[F.col(c) for c in counts])
    return s.select("store_id", "store", "nation", "offers", "active", F.col("offers").alias("products"), "categories", "min_price", "max_price", quality.alias("quality"))


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scores of a product read: its comparison, its history, trend and volatility; products with a serving offer."""
    rows = observations(spark, sf_dir)
    compared = O.compare(current_offers(spark, sf_dir), NOW, STALE).select("product_id", "offers", F.col("best_total").alias("best"), F.col("saving_percent").alias("saving"))
    past = H.summary(rows).select("product_id", F.col("points").alias("records"), "lowest", "highest", "average")
    recent = H.recent_shape(rows)
    fake = (F.col("records") >= 3) & (F.col("best") >= F.col("average")) & ((F.col("highest") - F.col("lowest")) / F.nullif(F.col("lowest"), F.lit(0.0)) * 100 >= 10)
    out = compared.join(past, "product_id").join(recent, "product_id")
    return out.withColumn("fake", F.coalesce(fake, F.lit(False)))


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def deal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven-part score with its confidence and label, the older score, and the badge."""
    score = S.deal_score(*_c("best", "saving", "offers", "average", "lowest", "trend", "change", "fake"))
    return product_facts(spark, sf_dir).select(
        "product_id", score.alias("score"), S.deal_label(score).alias("label"),
        S.deal_confidence(*_c("records", "offers", "average", "lowest")).alias("confidence"),
        S.early_deal_score(*_c("best", "saving", "offers", "average", "trend", "fake")).alias("early_score"),
        S.deal_badge(*_c("best", "lowest", "average", "saving", "records")).alias("badge"),
    )


def history_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.insight(*_c("best", "average", "lowest", "highest", "records", "trend"))
    return product_facts(spark, sf_dir).select("product_id", *[c.alias(k) for k, c in parts.items()])


def price_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices expected in 7 and 30 days with a band, and the risk that the price rises."""
    parts = S.forecast(*_c("best", "volatility_16", "trend", "records"))
    percent = F.col("volatility_20") * 100
    risk = S.rise_risk(F.col("best"), F.col("average_20"), percent, F.col("trend"), F.col("records"))
    return product_facts(spark, sf_dir).select("product_id", *[c.alias(k) for k, c in parts.items()], risk.alias("risk"), S.volatility_class(percent).alias("volatility"))


def purchase_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunity score on top of the older deal score, the decision, its confidence, and a target price."""
    early = S.early_deal_score(*_c("best", "saving", "offers", "average", "trend", "fake"))
    score = S.opportunity_score(*_c("best", "lowest", "average", "offers", "saving", "trend"), base=early.cast("double"))
    risk = S.rise_risk(F.col("best"), F.col("average_20"), F.col("volatility_20") * 100, F.col("trend"), F.col("records"))
    rows = product_facts(spark, sf_dir).withColumns({"score": score, "risk": risk})
    verdict = S.buy_decision(F.col("score"), F.col("records"))
    rows = rows.withColumn("verdict", verdict)
    less = F.when(F.col("verdict").isin("buy", "consider"), 0.03).when(F.col("verdict") == "watch", 0.07).otherwise(0.12)
    quality = F.when(F.col("records") < 3, "limited").when(F.col("records") < 10, "middle").otherwise("strong")
    consistency = (
        F.when(F.col("verdict").isin("buy", "consider") & (F.col("trend") == "falling") & (F.col("score") < 85), "cautious")
        .when(F.col("verdict").isin("watch", "wait") & (F.col("trend") == "rising"), "high risk")
        .otherwise("consistent")
    )
    return rows.select(
        "product_id", "score", "risk", "verdict", S.wait_days(*_c("score", "records", "risk")).alias("wait_days"),
        S.purchase_confidence(*_c("records", "offers")).cast("int").alias("confidence"),
        S.half_up(F.col("best") * (1 - less), 2).alias("target"), quality.alias("data_quality"), consistency.alias("consistency"),
    )


#: The analysis looks back from here.
ANALYSIS_NOW = "1998-09-02 00:00:00"


def price_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 and 90 days with the current prices as further points, the score, its label and the verdict."""
    rows = observations(spark, sf_dir).where(F.col("price") > 0)
    now = F.lit(ANALYSIS_NOW).cast("timestamp_ntz")
    shown = current_offers(spark, sf_dir).where(O.serving()).select("product_id", "price")
    shown_of = shown.groupBy("product_id").agg(F.min("price").alias("current"), F.count(F.lit(1)).alias("offers"))
    points = rows.select("product_id", "price", "seen_at").unionByName(shown.withColumn("seen_at", now))
    inside = lambda d: F.when(F.col("seen_at") >= now - F.expr(f"INTERVAL {d} DAYS"), F.col("price"))
    windows = points.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("records"), H.mean(F.col("price")).alias("average"), F.min("price").alias("low"),
        H.mean(inside(30)).alias("avg_30"), H.mean(inside(90)).alias("avg_90"), F.min(inside(90)).alias("low_90"),
    )
    out = shown_of.join(windows, "product_id").join(H.recent_shape(rows).select("product_id", "trend"), "product_id", "left")
    score = S.price_analysis_score(*_c("current", "avg_30", "avg_90", "low_90", "offers", "records"))
    out = out.withColumn("score", score)
    far = S.percent_change(F.col("current"), F.col("low_90"))
    return out.select(
        "product_id", "current", "records", "offers", "avg_30", "avg_90", "low_90", "score",
        S.price_analysis_label(*_c("score", "records")).alias("label"), S.deal_verdict(*_c("score", "records", "trend")).alias("verdict"),
        (far <= 0.5).alias("is_90_day_low"),
    )


def product_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-part score of each current offer; stand-ins: the line number for stock, the store's balance for trust, the order for reviews."""
    o = detailed_offers(spark, sf_dir)
    discount = F.when(F.col("old_price") > F.col("price"), (F.col("old_price") - F.col("price")) / F.col("old_price") * 100).otherwise(0.0)
    stock = F.when(F.col("hidden"), 0.0).otherwise(8.0)
    seller = F.when(F.col("official"), 7.0).otherwise(3.0)
    quality = F.lit(5.0)
    reviews = F.col("order_id") % 6000
    score = S.product_score(F.col("price"), discount, F.col("rating"), reviews, stock, seller, quality)
    parts = [S.half_up(c, 4).alias(n) for n, c in (("discount_part", S.discount_part(discount)), ("rating_part", S.rating_part(F.col("rating"))), ("review_part", S.review_part(reviews)))]
    return o.select("product_id", "store_id", *parts, score.alias("score"))


def sort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort metrics of all products with a serving offer; the number of observations stands for raw records, the size for relevance."""
    o = current_offers(spark, sf_dir).where(O.serving())
    best = o.groupBy("product_id").agg(F.min("price").alias("price"), F.max("old_price").alias("old_price"), F.count(F.lit(1)).alias("offers"))
    members = observations(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("members"))
    rows = best.join(members, "product_id").join(products(spark, sf_dir).select("product_id", (F.col("size") * 2).alias("relevance")), "product_id")
    return S.sort_metrics(rows).select("product_id", "price_drop_percent", "popularity_score", "best_value_score")


def refresh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.refresh_priority(products(spark, sf_dir), current_offers(spark, sf_dir).where(~F.col("hidden")), _age(), 24.0)


QUERIES = {f.__name__: f for f in (
    offer_ranking, store_center, deal_score, history_insight, price_forecast, purchase_assistant, price_analysis, product_scores, sort_metrics, refresh_candidates,
)}

_SERVING = "lifecycle = 'ACTIVE' AND NOT hidden AND price > 0"
_HOURS = f"(date_diff('second', seen_at, TIMESTAMP '{NOW}') / 3600)"
_AGED = f"({_HOURS} / {AGE_SCALE})"
_DETAILS = """d AS (SELECT cur.*, s_acctbal >= 5000 AS official, line % 2 = 1 AS delivery, line = 7 AS sponsored FROM cur JOIN supplier ON s_suppkey = store_id)"""
_FACTS = f"""f0 AS (SELECT *, {_HOURS} <= {STALE} AS fresh FROM cur WHERE {_SERVING}),
f1 AS (SELECT *, fresh OR NOT bool_or(fresh) OVER (PARTITION BY product_id) AS pool FROM f0),
f2 AS (SELECT product_id, count(*) AS offers, min(CASE WHEN pool THEN total END) AS best, max(total) AS dearest FROM f1 GROUP BY product_id),
f3 AS (SELECT product_id, offers, best, round(round(dearest - best, 2) / dearest * 100, 2) AS saving FROM f2),
f4 AS (SELECT product_id, count(*) AS records, min(price) AS lowest, max(price) AS highest, floor(sum(round(price * 100)::BIGINT) / count(price) + 0.5) / 100 AS average FROM obs GROUP BY product_id),
f5 AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seen_at DESC, order_id DESC, line DESC) AS back FROM obs),
f6 AS (SELECT product_id, count(*) AS n, arg_max(price, back) FILTER (back <= 6) AS a, arg_min(price, back) AS z,
       CASE WHEN count(*) >= 3 THEN stddev_pop(price) FILTER (back <= 16) / avg(price) FILTER (back <= 16) END AS volatility_16,
       stddev_pop(price) FILTER (back <= 20) / avg(price) FILTER (back <= 20) AS volatility_20, avg(price) FILTER (back <= 20) AS average_20 FROM f5 GROUP BY product_id),
f7 AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE floor((z - a) / a * 100 * 100 + 0.5) / 100 END AS change FROM f6),
f8 AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient' WHEN change <= -2 THEN 'falling' WHEN change >= 2 THEN 'rising' ELSE 'stable' END AS trend FROM f7),
facts AS (SELECT f3.*, records, lowest, highest, average, trend, change, volatility_16, volatility_20, average_20,
          records >= 3 AND best >= average AND (highest - lowest) / lowest * 100 >= 10 AS fake FROM f3 JOIN f4 USING (product_id) JOIN f8 USING (product_id))"""


def _r(x: str, d: int) -> str:
    return f"(floor(({x}) * {10**d} + 0.5) / {10**d})"


_UNDER = "((average - best) / average * 100)"
_FAR = "((best - lowest) / lowest * 100)"
_PARTS = [
    "30.0", "CASE WHEN saving > 0 THEN least(saving * 1.2, 22) ELSE 0 END",
    f"CASE WHEN {_UNDER} > 0 THEN least({_UNDER} * 1.4, 22) ELSE greatest({_UNDER} * 0.6, -10) END",
    f"CASE WHEN {_FAR} <= 0.5 THEN 10 WHEN {_FAR} <= 3 THEN 7 WHEN {_FAR} <= 7 THEN 3 WHEN {_FAR} >= 15 THEN -5 ELSE 0 END",
    "CASE trend WHEN 'falling' THEN least(5 + abs(change) * 0.5, 10) WHEN 'stable' THEN 4 WHEN 'rising' THEN greatest(-5 - change * 0.4, -10) ELSE 0 END",
    "CASE WHEN offers >= 6 THEN 6 WHEN offers >= 4 THEN 5 WHEN offers >= 2 THEN 3 WHEN offers = 1 THEN 1 ELSE 0 END",
    "CASE WHEN fake THEN -18 ELSE 0 END",
]
_DEAL = f"round_even(least(100, greatest(0, {' + '.join(_r(p, 1) for p in _PARTS)})), 0)::INTEGER"
_EARLY = """round_even(least(100, greatest(0, 45.0 + CASE WHEN saving > 0 THEN least(saving * 1.5, 25) ELSE 0 END + CASE WHEN best < average THEN least((average - best) / average * 100 * 1.4, 20) ELSE 0 END
    + CASE trend WHEN 'falling' THEN 10 WHEN 'stable' THEN 4 WHEN 'rising' THEN -10 ELSE 0 END - CASE WHEN fake THEN 20 ELSE 0 END + CASE WHEN offers >= 4 THEN 5 WHEN offers >= 2 THEN 3 ELSE 0 END)), 0)::INTEGER"""
_RISK = """CASE WHEN records < 3 THEN 50 ELSE least(92, greatest(8, round_even(50.0 + CASE trend WHEN 'rising' THEN 22 WHEN 'falling' THEN -16 ELSE 0 END
    + CASE WHEN best < average_20 * 0.96 THEN 12 WHEN best > average_20 * 1.08 THEN -8 ELSE 0 END + least(12, volatility_20 * 100 * 1.5), 0)))::INTEGER END"""

SQL = {
    "offer_ranking": f"""WITH {SQL_CUR}, {_DETAILS}, s AS (SELECT *, {_AGED} AS age, min(total) OVER w AS lo, max(total) OVER w AS hi FROM d WHERE {_SERVING} WINDOW w AS (PARTITION BY product_id)),
        p AS (SELECT *, CASE WHEN hi > lo THEN 42 * (hi - total) / (hi - lo) ELSE 42.0 END + CASE WHEN shipping <= 0 THEN 14 WHEN shipping <= 75 THEN 8 WHEN shipping <= 150 THEN 4 ELSE 0 END
              + CASE WHEN age <= 3 THEN 10 WHEN age <= 12 THEN 8 WHEN age <= 24 THEN 6 WHEN age <= 48 THEN 3 ELSE 0 END + CASE WHEN official THEN 12 ELSE 0 END + least(10, rating * 2)
              + CASE WHEN match_score >= 95 THEN 8 WHEN match_score >= 85 THEN 6 WHEN match_score >= 70 THEN 3 ELSE 0 END + CASE WHEN delivery THEN 2 ELSE 0 END - CASE WHEN sponsored THEN 2 ELSE 0 END AS raw FROM s),
        q AS (SELECT product_id, store_id, total, {_r('least(100, greatest(0, raw))', 1)} AS offer_score, total = lo AS is_cheapest FROM p)
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY offer_score DESC, total, store_id)::INTEGER AS rank FROM q""",
    "store_center": f"""WITH {SQL_CUR}, {_DETAILS}, g AS (SELECT store_id, count(*) AS offers, count_if({_SERVING}) AS active, count(DISTINCT product_id) AS products, count(DISTINCT p_type) AS categories,
              min(price) AS min_price, max(price) AS max_price, count_if(shipping > 0) AS sh, count_if(delivery) AS de, count_if(official) AS offi, count_if(price > 0) AS pr FROM d JOIN part ON p_partkey = product_id GROUP BY store_id),
        q AS (SELECT *, {_r('active / offers * 100', 1)} AS a, {_r('pr / offers * 100', 1)} AS p, {_r('sh / offers * 100', 1)} AS s, {_r('de / offers * 100', 1)} AS d, {_r('offi / offers * 100', 1)} AS o FROM g)
        SELECT s_suppkey AS store_id, s_name AS store, n_name AS nation, coalesce(offers, 0)::BIGINT AS offers, coalesce(active, 0)::BIGINT AS active, coalesce(products, 0)::BIGINT AS products, coalesce(categories, 0)::BIGINT AS categories,
               min_price, max_price, coalesce(round_even(a * 0.30 + p * 0.30 + s * 0.15 + d * 0.15 + o * 0.10, 0), 0)::INTEGER AS quality
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN q ON q.store_id = s_suppkey""",
    "deal_score": f"""WITH {SQL_CUR}, {_FACTS}, s AS (SELECT *, {_DEAL} AS score, {_EARLY} AS early_score, greatest(0.0, {_FAR}) AS dist, (best - average) / average * 100 AS over FROM facts)
        SELECT product_id, score, CASE WHEN score >= 85 THEN 'very good' WHEN score >= 70 THEN 'good' WHEN score >= 55 THEN 'average' WHEN score >= 40 THEN 'weak' ELSE 'unfit' END AS label,
               least(100, CASE WHEN records >= 12 THEN 55 WHEN records >= 6 THEN 42 WHEN records >= 3 THEN 28 ELSE 12 END + CASE WHEN offers >= 5 THEN 30 WHEN offers >= 3 THEN 22 WHEN offers >= 2 THEN 15 ELSE 7 END + 15)::INTEGER AS confidence,
               early_score, CASE WHEN records >= 2 AND dist <= 1 AND over <= 0 THEN 'super' WHEN (records >= 2 AND dist <= 5) OR saving >= 8 THEN 'good' WHEN records < 2 THEN 'new' WHEN over > 8 THEN 'high' ELSE 'normal' END AS badge FROM s""",
    "history_insight": f"""WITH {SQL_CUR}, {_FACTS}, s AS (SELECT *, (best - average) / average * 100 AS over, {_FAR} AS far, CASE WHEN highest > lowest THEN least(100.0, greatest(0.0, (best - lowest) / (highest - lowest) * 100)) ELSE 0.0 END AS place FROM facts)
        SELECT product_id, {_r('over', 2)} AS average_difference, {_r('far', 2)} AS low_distance, {_r('place', 2)} AS range_position,
               CASE WHEN records < 3 THEN 'keep watching' WHEN far <= 3 AND over <= 0 AND trend <> 'rising' THEN 'buy now' WHEN trend = 'falling' AND far > 5 THEN 'wait a little'
                    WHEN over > 5 OR far > 12 THEN 'wait for a better price' WHEN trend = 'rising' AND far <= 5 THEN 'by need' ELSE 'watch with an alarm' END AS action FROM s""",
    "price_forecast": f"""WITH {SQL_CUR}, {_FACTS}, s AS (SELECT *, CASE trend WHEN 'falling' THEN -0.012 WHEN 'rising' THEN 0.012 ELSE -0.002 END::DOUBLE AS w, CASE trend WHEN 'falling' THEN -0.028 WHEN 'rising' THEN 0.032 ELSE -0.006 END::DOUBLE AS m,
              greatest(0.025, least(0.12, coalesce(volatility_16, 0.04) * 1.6))::DOUBLE AS band FROM facts)
        SELECT product_id, {_r('best * (1 + w)', 2)} AS days_7, {_r('best * (1 + m)', 2)} AS days_30, {_r('best * (1 + m) * (1 - band)', 2)} AS low, {_r('best * (1 + m) * (1 + band)', 2)} AS high,
               least(88, 38 + least(records, 15) * 3)::INTEGER AS confidence, {_RISK} AS risk, CASE WHEN volatility_20 * 100 < 2.5 THEN 'low' WHEN volatility_20 * 100 < 6 THEN 'middle' ELSE 'high' END AS volatility FROM s""",
    "purchase_assistant": f"""WITH {SQL_CUR}, {_FACTS}, e AS (SELECT *, {_EARLY} AS early, {_FAR} AS far, (best - average) / average * 100 AS delta, {_RISK} AS risk FROM facts),
        s AS (SELECT *, round_even(least(100, greatest(0, early::DOUBLE + CASE WHEN far <= 2 THEN 14 WHEN far <= 5 THEN 9 WHEN far <= 10 THEN 3 WHEN far >= 20 THEN -16 WHEN far >= 15 THEN -10 ELSE 0 END
              + CASE WHEN delta <= -10 THEN 12 WHEN delta <= -5 THEN 8 WHEN delta >= 12 THEN -12 WHEN delta >= 7 THEN -7 ELSE 0 END + CASE WHEN offers >= 5 THEN 7 WHEN offers >= 3 THEN 4 WHEN offers <= 1 THEN -4 ELSE 0 END
              + CASE WHEN saving >= 12 THEN 6 WHEN saving >= 6 THEN 3 ELSE 0 END + CASE trend WHEN 'falling' THEN 3 WHEN 'rising' THEN -5 ELSE 0 END)), 0)::INTEGER AS score FROM e),
        v AS (SELECT *, CASE WHEN records < 2 THEN 'watch' WHEN score >= 85 THEN 'buy' WHEN score >= 70 THEN 'consider' WHEN score >= 50 THEN 'watch' ELSE 'wait' END AS verdict FROM s)
        SELECT product_id, score, risk, verdict, CASE WHEN records < 2 OR score >= 70 THEN NULL WHEN score >= 50 THEN CASE WHEN risk < 70 THEN 7 ELSE 3 END ELSE 10 END::INTEGER AS wait_days,
               least(95, 40 + 4 * least(records, 12) + 3 * least(offers, 5))::INTEGER AS confidence, {_r("best * (1 - CASE WHEN verdict IN ('buy', 'consider') THEN 0.03 WHEN verdict = 'watch' THEN 0.07 ELSE 0.12 END::DOUBLE)", 2)} AS target,
               CASE WHEN records < 3 THEN 'limited' WHEN records < 10 THEN 'middle' ELSE 'strong' END AS data_quality,
               CASE WHEN verdict IN ('buy', 'consider') AND trend = 'falling' AND score < 85 THEN 'cautious' WHEN verdict IN ('watch', 'wait') AND trend = 'rising' THEN 'high risk' ELSE 'consistent' END AS consistency FROM v""",
    "price_analysis": f"""WITH {SQL_CUR}, {_FACTS}, sh AS (SELECT product_id, price FROM cur WHERE {_SERVING}), so AS (SELECT product_id, min(price) AS current, count(*) AS offers FROM sh GROUP BY product_id),
        pt AS (SELECT product_id, price, seen_at FROM obs UNION ALL SELECT product_id, price, TIMESTAMP '{ANALYSIS_NOW}' FROM sh),
        w AS (SELECT product_id, count(*) AS records, floor(sum(round(price * 100)::BIGINT) FILTER (seen_at >= TIMESTAMP '{ANALYSIS_NOW}' - INTERVAL 30 DAYS) / count(*) FILTER (seen_at >= TIMESTAMP '{ANALYSIS_NOW}' - INTERVAL 30 DAYS) + 0.5) / 100 AS avg_30,
              floor(sum(round(price * 100)::BIGINT) FILTER (seen_at >= TIMESTAMP '{ANALYSIS_NOW}' - INTERVAL 90 DAYS) / count(*) FILTER (seen_at >= TIMESTAMP '{ANALYSIS_NOW}' - INTERVAL 90 DAYS) + 0.5) / 100 AS avg_90,
              min(price) FILTER (seen_at >= TIMESTAMP '{ANALYSIS_NOW}' - INTERVAL 90 DAYS) AS low_90 FROM pt GROUP BY product_id),
        v AS (SELECT so.*, records, avg_30, avg_90, low_90, trend, {_r('(current - avg_30) / avg_30 * 100', 2)} AS v30, {_r('(current - avg_90) / avg_90 * 100', 2)} AS v90, {_r('(current - low_90) / low_90 * 100', 2)} AS far
              FROM so JOIN w USING (product_id) LEFT JOIN f8 USING (product_id)),
        s0 AS (SELECT *, 50.0 + least(25, greatest(-20, -v30 * 2.5)) + least(15, greatest(-12, -v90 * 1.5)) + least(20, greatest(-18, 20 - far * 2.0)) + CASE WHEN offers >= 2 THEN least(8, (offers - 1) * 2) ELSE 0 END AS raw FROM v),
        s AS (SELECT *, least(100, greatest(0, round_even(CASE WHEN records < 3 THEN least(raw, 60) ELSE raw END, 0)))::INTEGER AS score FROM s0)
        SELECT product_id, current, records, offers, avg_30, avg_90, low_90, score, CASE WHEN records < 3 THEN 'new' WHEN score >= 90 THEN 'super' WHEN score >= 75 THEN 'good' WHEN score >= 55 THEN 'normal' ELSE 'high' END AS label,
               CASE WHEN records < 3 THEN 'watch with an alarm' WHEN trend = 'falling' AND score < 85 THEN 'wait a little' WHEN trend = 'rising' AND score >= 70 THEN 'do not delay'
                    WHEN score >= 85 THEN 'strong buy' WHEN score >= 70 THEN 'buy' WHEN score >= 55 THEN 'by need' ELSE 'wait for a better price' END AS verdict, far <= 0.5 AS is_90_day_low FROM s""",
    "product_scores": f"""WITH {SQL_CUR}, {_DETAILS}, x AS (SELECT *, CASE WHEN old_price > price THEN (old_price - price) / old_price * 100 ELSE 0.0 END AS pct, order_id % 6000 AS reviews FROM d),
        y AS (SELECT *, CASE WHEN pct <= 0 THEN 0 WHEN pct < 5 THEN pct * 0.5 WHEN pct < 10 THEN 2.5 + (pct - 5) / 5 * 7.5 WHEN pct < 20 THEN 10.0 + (pct - 10) / 10 * 15.0 WHEN pct < 30 THEN 25.0 + (pct - 20) / 10 * 12.0
              WHEN pct < 40 THEN 37.0 + (pct - 30) / 10 * 8.0 ELSE 45 END AS a, CASE WHEN rating < 3 THEN rating / 3.0 * 4.0 WHEN rating < 4 THEN 4.0 + (rating - 3) * 8.0 ELSE 12.0 + (rating - 4) * 8.0 END AS b,
              CASE WHEN reviews <= 0 THEN 0 ELSE least(15.0, log10(reviews + 1) / log10(5001) * 15.0) END AS c FROM x)
        SELECT product_id, store_id, {_r('a', 4)} AS discount_part, {_r('b', 4)} AS rating_part, {_r('c', 4)} AS review_part,
               round_even(least(100, greatest(0, a + b + c + CASE WHEN hidden THEN 0 ELSE 8 END + CASE WHEN official THEN 7 ELSE 3 END + 5.0)), 0)::INTEGER AS score FROM y""",
    "sort_metrics": f"""WITH {SQL_CUR}, b AS (SELECT product_id, min(price) AS price, max(old_price) AS old_price, count(*) AS offers FROM cur WHERE {_SERVING} GROUP BY product_id),
        c AS (SELECT b.*, (SELECT count(*) FROM obs WHERE obs.product_id = b.product_id) AS members, least(100.0, p_size * 2.0) AS rel FROM b JOIN part ON p_partkey = product_id),
        m AS (SELECT *, min(price) OVER () AS lo, max(price) OVER () AS hi, CASE WHEN old_price > price THEN (old_price - price) / old_price * 100 ELSE 0.0 END AS dr FROM c)
        SELECT product_id, {_r('dr', 2)} AS price_drop_percent, {_r('least(100.0, offers * 12.0 + members * 2.0 + rel * 0.35)', 2)} AS popularity_score,
               {_r('rel * 0.40 + CASE WHEN hi > lo THEN (hi - price) / greatest(hi - lo, 1.0) * 100 ELSE 50.0 END * 0.35 + least(100.0, offers * 18.0) * 0.15 + least(dr * 3.0, 100.0) * 0.10', 2)} AS best_value_score FROM m""",
    "refresh_candidates": f"""WITH {SQL_CUR}, o AS (SELECT product_id, count(*) AS offers, count_if({_AGED} <= 24)::BIGINT AS fresh_stores, min({_AGED}) AS age FROM cur WHERE NOT hidden GROUP BY product_id),
        r AS (SELECT p_partkey AS product_id, coalesce(offers, 0)::BIGINT AS offers, coalesce(fresh_stores, 0)::BIGINT AS fresh_stores, coalesce(greatest(0.0, age), 9999.0) AS hours FROM part LEFT JOIN o ON product_id = p_partkey)
        SELECT product_id, offers AS stores, fresh_stores, offers, {_r('hours', 2)} AS age_hours,
               {_r('CASE WHEN offers = 0 THEN 10000.0 ELSE 0.0 END + greatest(0, 5 - offers) * 1000.0 + CASE WHEN fresh_stores = 0 THEN 750.0 ELSE 0.0 END + least(hours, 720.0)', 2)} AS priority
        FROM r WHERE NOT (fresh_stores >= 5 AND hours < 24)""",
}
