"""Tables that one query writes to read them more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine a folder of our own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="pricelake-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _gone(path: str) -> None:
    where, name = fs.FileSystem.from_uri(path)
    if where.get_file_info(name).type != fs.FileType.NotFound:
        where.delete_dir(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that costly expressions run once and plans stay small; it goes when the driver ends."""
    path = f"{_shared(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_gone, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to as many tasks as a shuffle has: few bytes that cost much to read would else stay in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def once(rows: DataFrame, by: list[str], answer: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``rows`` with what ``answer`` adds to their distinct values of ``by``, each answered once and written.

    Columns of ``by`` are not null; a struct of them may hold nulls.
    """
    known = staged(answer(spread(rows.select(*by).distinct())), name)
    place = F.xxhash64(*by)  # first of the keys, so that a sort compares numbers before texts
    return rows.withColumn("_place", place).join(known.withColumn("_place", place), ["_place", *by]).drop("_place")
