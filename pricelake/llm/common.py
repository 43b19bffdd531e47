"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract here uses it.
SPACE = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine a folder of our own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="pricelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, an execution's shuffle files go when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables of one computation in the shared folder, dropped by name as others supersede them.

    A written table cuts lineage, so that a lost executor costs one step, and
    keeps rows that Python has made from being made twice.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as written and read back; a table put under the name before goes."""
        before, path = self.paths.get(name), f"{self.root}/{name}-{uuid.uuid4().hex}"
        with _shuffles_end(self.spark):
            df.write.parquet(path)
        self.paths[name] = path
        if before:
            _delete(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables; nothing that is still to be computed may read them."""
        for name in names:
            _delete(self.paths.pop(name))


def _delete(path: str) -> None:
    where, name = fs.FileSystem.from_uri(path)
    where.delete_dir(name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """One table in the shared folder, see `Scratch`."""
    return Scratch(df.sparkSession, name).put(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; other columns, whatever their names, are left out."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def batches(texts: list, ids: list, chars: int = 4_000_000) -> Iterable[tuple[list, list]]:
    """Slices of an Arrow batch with a bounded number of characters, one text at least."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > chars:
            yield ids[lo:i], texts[lo:i]
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


_held: tuple[Any, Any] = (None, None)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """This process's large object of a key, made when first asked for; another key's goes, as workers live on through other stages."""
    global _held
    if _held[0] != key:
        _held = (None, None)
        pa.default_memory_pool().release_unused()
        _held = (key, make())
    return _held[1]
