"""Queries on inputs that the given small tables don't hold: other entities, large keys, repeated titles."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pricelake import catalog


@pytest.fixture
def tables(tmp_path, spark):
    """Writes tables to a folder of their own; gives the folder and a DuckDB connection that sees them."""
    con = duckdb.connect()

    def write(**frames):
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def test_page_titles_keep_other_entities(spark, tables):
    """Ampersands of a title are decoded; other entities stay as its SQL has them."""
    html = '<html lang="en"><head><title> a &quot;b&quot; &amp; c &lt;d </title></head><body><a href="/x?a=1&amp;b=2">x</a></body></html>'
    folder, con = tables(pages=spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = [tuple(r) for r in catalog.QUERIES["page_title_meta"](spark, folder).collect()]
    assert got == con.execute(catalog.SQL["page_title_meta"]).fetchall() == [(1, "a &quot;b&quot; & c &lt;d", "en", 1, None)]


@pytest.fixture
def answered(monkeypatch):
    """How many rows and partitions each table had that a query wrote, by name."""
    from pricelake.operators import cards, strict
    from pricelake.plans import matching
    from pricelake.sources import staged as module

    found, write = {}, module.staged

    def recorded(df, name):
        out = write(df, name)
        found[name] = (out.count(), df.rdd.getNumPartitions())
        return out

    for m in (module, cards, strict, matching):
        monkeypatch.setattr(m, "staged", recorded)
    return found


def parts(spark, period, keys=(3, 4, 7, 20)):
    """Products whose titles come three times."""
    return spark.createDataFrame([(k + i * period, 10.0 + i) for k in keys for i in range(3)], "p_partkey bigint, p_retailprice double")


def test_equal_titles_give_attributes_once(spark, tables, answered, same_rows):
    """A repeated title isn't read again, and the reading is dealt out."""
    folder, con = tables(part=parts(spark, 120_120))
    same_rows(catalog.QUERIES["listing_attributes"](spark, folder), con, catalog.SQL["listing_attributes"])
    rows, tasks = answered["attributes"]
    assert rows == 8 and tasks >= 8


@pytest.fixture
def same_rows():
    def check(df, con, sql):
        got = con.execute(sql)
        cols = [d[0] for d in got.description]
        want = sorted(map(repr, got.fetchall()))
        assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want and want

    return check


@pytest.mark.parametrize("name", ["archived_duplicates", "moved_history"])
@pytest.mark.parametrize("product, store, order", [(1_200_000, 59_999, 9_000_000), (7_000_000, 400_000, 54_000_000), (7, 400_000, 54_000_000)])
def test_large_keys_give_whole_offer_numbers(spark, sf_dir, tables, name, product, store, order):
    """Keys past the places that a bigint has for them: the groups of the small keys, under numbers that differ."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey < 40")
    far = lines.withColumns({c: F.col(c) + n for c, n in (("l_partkey", product), ("l_suppkey", store), ("l_orderkey", order))})
    near, con = tables(lineitem=lines)
    far.coalesce(1).write.parquet(f"{near}/far/lineitem.parquet")
    kept = lambda df: sorted(map(repr, df.drop("survivor_id", "product_id", "store_id").collect()))
    small, large = catalog.QUERIES[name](spark, near), catalog.QUERIES[name](spark, f"{near}/far")
    assert dict(small.dtypes)["survivor_id"] == "bigint" and kept(small) == kept(large)
    assert large.select("survivor_id").distinct().count() == small.count() == con.execute(f"SELECT count(*) FROM ({catalog.SQL[name]})").fetchone()[0]


def test_equal_sources_have_equal_candidates(spark, tables, answered):
    """Products with one title have the same verdicts, counted over all cards."""
    from pricelake.operators import strict as S
    from pricelake.sources.market import market_cards, market_products

    folder, _ = tables(part=parts(spark, 216_000, keys=(7, 19)))
    got = sorted(map(tuple, catalog.QUERIES["strict_candidates"](spark, folder).collect()))
    assert answered["strict-candidates"][0] <= 20
    a, b = market_products(spark, folder), market_cards(spark, folder)
    pairs = S.strict_pairs(a.select(F.col("product_id").alias("source_id"), S.facts_of(a).alias("f")), b.select(F.col("card_id").alias("candidate_id"), S.facts_of(b).alias("f")))
    want = pairs.groupBy("source_id", "reason", "matched").agg(F.count(F.lit(1)), F.max("score")).collect()
    assert got == sorted(map(tuple, want)) and len({r[0] for r in got}) == 6


def test_equal_pairs_are_compared_once(spark, tables, answered):
    """Three copies of each product and card: one comparison, and the verdict at every card."""
    folder, _ = tables(part=parts(spark, 216_000))
    for name, table in (("card_verdicts", "card-verdicts"), ("dispatch_matches", "dispatched")):
        rows = catalog.QUERIES[name](spark, folder).collect()
        assert len(rows) == len({r.card_id for r in rows}) == 120 and answered[table][0] <= 40
        told = {}
        for r in rows:  # the card's number, without the copy that it stands for
            told.setdefault((r.card_id // 100 % 216_000, r.card_id % 100), set()).add(tuple(r)[1:])
        assert len(told) == 40 and all(len(v) == 1 for v in told.values())


def test_equal_cards_are_found_once(spark, tables, answered):
    """Equal labels are one card with its number; counts and the first of the best are those of all cards."""
    from pricelake.operators import cards as C
    from pricelake.sources.market import market_cards, market_products

    folder, _ = tables(part=parts(spark, 216_000))
    got = {r.query_id: (r.cards, r.best_score, r.card_id) for r in catalog.QUERIES["card_search"](spark, folder).collect()}
    assert answered["cards"][0] <= 40 and answered["cards"][1] >= 8
    names = market_products(spark, folder).groupBy("name").agg(F.min("product_id").alias("query_id")).select("query_id", F.col("name").alias("query"))
    every, want = market_cards(spark, folder).select("card_id", F.col("name").alias("label"), "href"), {}
    for r in C.card_matches(names, every).collect():
        want.setdefault(r.query_id, []).append((-r.score, r.card_id))
    assert got == {q: (len(v), -min(v)[0], min(v)[1]) for q, v in want.items()} and got
    assert all(n % 3 == 0 for n, _, _ in got.values())
