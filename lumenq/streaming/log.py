"""Change-log shipping and event-time windows with Structured Streaming.

A log line is ``lsn <tab> crc32 of the text, eight hex digits <tab> text``. Lines that fail the check are set
aside; each lsn is applied once: a micro-batch drops repeats and what is at or below the high-water mark
that is kept with the applied state, so a replay after a restart changes nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..catalog import Files


def log_line(lsn: int, text: str) -> str:
    return f"{lsn}\t{zlib.crc32(text.encode()):08x}\t{text}"


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """lsn, text, ok."""
    parts = F.split(F.col(col), "\t", 3)
    text = F.get(parts, 2)
    crc = F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")
    return lines.select(F.get(parts, 0).try_cast("long").alias("lsn"), text.alias("text"), F.coalesce((crc == F.lower(F.get(parts, 1))) & F.get(parts, 0).try_cast("long").isNotNull(), F.lit(False)).alias("ok"))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return parse_log(spark.readStream.text(folder))


def once(changes: DataFrame, high_water: int) -> DataFrame:
    """Checked changes above the mark, each lsn once."""
    return changes.where(F.col("ok") & (F.col("lsn") > high_water)).dropDuplicates(["lsn"])


class Applier:
    """Applies a log's micro-batches in lsn order, and remembers how far it came.

    Log texts are statements for a session: they are few per batch and run in order on the driver, as DDL and
    DML do. Bulk changes come as rows instead: see :func:`upsert`.
    """

    def __init__(self, spark: SparkSession, state: str, apply: Callable[[int, str], object]):
        self.files, self.state, self.apply = Files(spark, state), state, apply

    @property
    def high_water(self) -> int:
        return json.loads(self.files.read(f"{self.state}/applied.json") or '{"lsn": 0}')["lsn"]

    def batch(self, df: DataFrame, epoch: int) -> None:
        for r in once(df, self.high_water).orderBy("lsn").toLocalIterator():
            self.apply(r["lsn"], r["text"])
            self.files.write(f"{self.state}/applied.json", json.dumps({"lsn": r["lsn"]}))

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(table: DataFrame, changes: DataFrame, key: str, lsn: str = "lsn", op: str = "op") -> DataFrame:
    """The table after row changes (op: insert, update, delete): the last change of a key counts."""
    last = changes.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(lsn)))).where("__r = 1").drop("__r")
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*table.columns))


def replay(changes: DataFrame, key: str, upto: int, lsn: str = "lsn", op: str = "op") -> DataFrame:
    """Rows as of an lsn, from their change log alone."""
    last = changes.where(F.col(lsn) <= upto).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(lsn)))).where("__r = 1")
    return last.where(F.col(op) != "delete").drop("__r", op)


def visible(created: Column, deleted: Column, read: int) -> Column:
    """Snapshot visibility of a row version."""
    return (created <= read) & (deleted.isNull() | (deleted > read))


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts by window; on a stream, late bounds the state and drops what comes later."""
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running(events: DataFrame, key: str, value: str) -> DataFrame:
    """A stateful stream: key, n, top (rows and largest value so far) of each key that a micro-batch touches.

    State is one small pair a key, in the checkpointed state store; null keys are a key, null values count as rows only.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k, parts, state):
        import pandas as pd

        n, top = state.get if state.exists else (0, None)
        for part in parts:
            n += len(part)
            seen = part[value].dropna()
            if len(seen):
                top = float(seen.max()) if top is None else max(top, float(seen.max()))
        state.update((n, top))
        yield pd.DataFrame({key: [k[0]], "n": [n], "top": [top]})

    schema = f"`{key}` {kind}, n long, top double"
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, schema, "n long, top double", "append", "NoTimeout")
