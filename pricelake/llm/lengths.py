"""Token counts: an exact length histogram whose suffix sums answer any context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialise
from .tokens import encoder, text_slices


def token_lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row: the whole text's encoded length, without special ids.

    Null or empty text: 0.  Null ids pass through, repeated rows count each,
    very long texts are encoded whole, other columns are ignored, an empty
    table gives an empty result.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in parts:
            for rows in text_slices(part):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(enc.counts(rows.column(1)))], names=["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def _histogram(lengths: DataFrame, block: int) -> DataFrame:
    hist = lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))
    return hist.withColumns({"tokens": F.col("n_tokens") * F.col("documents"), "block": F.floor(F.col("n_tokens") / block)})


def length_histogram(lengths: DataFrame, block: int = 64) -> DataFrame:
    """One row for each length that occurs, from the n_tokens of ``lengths``.

    Columns: n_tokens; documents and tokens of that length; documents_at_least
    and tokens_at_least (suffix sums, this length included); truncated_tokens
    (all documents' tokens if each were cut at this length); quantile (share
    of documents up to this length).  `token_totals` answers other limits from
    these rows.

    Documents fold into the histogram before any shuffle, and the histogram is
    written once, so texts are encoded once.  Suffix sums run inside blocks of
    ``block`` lengths, and over the blocks' totals, so no task sorts every
    length.  Null lengths are left out; an empty table gives an empty result.
    """
    hist = materialise(_histogram(lengths, block), "histogram")
    blocks = hist.groupBy("block").agg(F.sum("documents").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(longer), F.lit(0)).alias("more_docs"),
        F.coalesce(F.sum("b_tokens").over(longer), F.lit(0)).alias("more_tokens"),
        F.sum("b_docs").over(whole).alias("all_docs"),
        F.sum("b_tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs = F.sum("documents").over(inside) + F.col("more_docs")
    tokens = F.sum("tokens").over(inside) + F.col("more_tokens")
    out = hist.join(blocks, "block").withColumns({"documents_at_least": docs, "tokens_at_least": tokens})
    return out.select(
        "n_tokens", "documents", "tokens", "documents_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("documents_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("documents_at_least") + F.col("documents")) / F.col("all_docs")).alias("quantile"),
    )


def token_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, documents_cut (those longer than it) and truncated_tokens of each limit, from `length_histogram`'s suffix sums.

    For a limit L the shortest longer length r has all that is needed: the
    documents cut are r's documents_at_least, and the total cut at L is r's
    truncated total less (r - L) for each of them.  Limits that no length
    exceeds cut nothing and have the corpus total.  Repeated limits give
    repeated rows; from an empty histogram each limit has zeros.
    """
    row = lambda k: F.struct("n_tokens", "documents_at_least", "truncated_tokens")
    nexts = [F.min(F.when(F.col("n_tokens") > k, row(k))).alias(f"r{i}") for i, k in enumerate(limits)]
    one = histogram.agg(F.max("truncated_tokens").alias("all_tokens"), *nexts)
    entries = []
    for i, k in enumerate(limits):
        cut = F.coalesce(F.col(f"r{i}.documents_at_least"), F.lit(0).cast("bigint"))
        kept = F.col(f"r{i}.truncated_tokens") - (F.col(f"r{i}.n_tokens") - k) * F.col(f"r{i}.documents_at_least")
        total = F.coalesce(kept, F.col("all_tokens"), F.lit(0).cast("bigint"))
        entries.append(F.struct(F.lit(k).cast("bigint").alias("context_limit"), cut.alias("documents_cut"), total.alias("truncated_tokens")))
    return one.select(F.inline(F.array(*entries)))


def length_quantile(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the shortest length up to which at least this share of the documents goes (null if there are none)."""
    at = [F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    entries = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]
    return histogram.agg(*at).select(F.inline(F.array(*entries)))
