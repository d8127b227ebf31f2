"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space and code points 9 to 13.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a temporary folder is used and set on a local master (tests, one machine); on a
    cluster that is an error, as each machine would write to a folder of its own.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lumenq-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cuts the lineage: writes df as Parquet under the shared folder and reads it again.

    A lost executor then costs only a re-read, and the planner knows the real size of what follows. The table
    goes when the application ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenq/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more (others are left alone)."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ([^\\x20\\x09-\\x0D]+) of a text in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
