"""Exact dedup: 128-bit content hash, smallest stable id, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``content_hash`` (md5, 128 bits) groups the texts.  The grouping key is the
    hash *and* the text, so bytes are compared inside each hash group and two
    texts that collide stay apart.  Each map task first folds its own copies
    into one row, so a text that fills a third of the table reaches a reducer
    as one row a task.  The way back from groups to rows is a join on slim
    columns, which adaptive execution can split at a hot key; it goes by md5 and
    sha256 together.

    Null text is empty text.  Rows with a null id belong to their text's group
    and count; they stay only if no row of it has an id (keep_id is then null,
    and all such rows are marked kept, as nothing tells them apart).  Rows that
    repeat an id and its text are all marked alike; `drop_exact_copies` keeps
    one of them.  An empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("norm"))
    rows = rows.withColumn("hash", content_hash(F.col("norm")))
    groups = rows.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    slim = rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return slim.join(groups, ["hash", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns; of rows repeating an id and its text, one.

    Whole rows are shuffled once, for the join with their group's smallest id;
    what repeats an id and a text then lies side by side.  The join goes by
    both hashes (md5 and sha256, 384 bits); bytes are compared in the groups
    that choose the id.  Of rows without an id one a text stays if no row of
    the text has an id.  An empty table stays empty.
    """
    norm = normalised(docs[text_col])
    keyed = docs.select(
        *[docs[c].alias(f"in_{i}") for i, c in enumerate(docs.columns)],
        F.md5(norm).alias("hash"), F.sha2(norm, 256).alias("sha"), docs[id_col].isNull().alias("no_id"), F.coalesce(docs[id_col], F.lit(0)).alias("row_id"),
    )
    rows = docs.select(docs[id_col].alias("row_id"), norm.alias("norm"))
    winners = rows.groupBy(F.md5("norm").alias("hash"), "norm").agg(F.min("row_id").alias("keep"))
    winners = winners.select("hash", F.sha2("norm", 256).alias("sha"), F.col("keep").isNull().alias("no_id"), F.coalesce("keep", F.lit(0)).alias("row_id"))
    key = ["hash", "sha", "no_id", "row_id"]
    stays = keyed.join(winners, key, "left_semi")
    first = stays.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("row_id"))).where("place = 1")
    return first.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
