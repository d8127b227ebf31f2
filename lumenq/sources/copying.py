"""COPY in and out, and dumps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, StringType, StructField, StructType, TimestampType


class CopyError(ValueError):
    pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, a local one on a local master, as in tests, and else an error."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if not sc.master.startswith("local"):
            raise CopyError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/lumenq-{name}-{uuid.uuid4().hex}"


def confined(path: str, root: str) -> str:
    """path, if it lies under root."""
    scheme, _, top = root.rpartition("://")
    here, top = os.path.normpath(os.path.join(top, path.removeprefix(f"{scheme}://"))), os.path.normpath(top)
    if here != top and PurePosixPath(top) not in PurePosixPath(here).parents:
        raise CopyError(f"{path} is outside {root}")
    return f"{scheme}://{here}" if scheme else here


def copy_from_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, delimiter: str = ",") -> DataFrame:
    """RFC 4180; columns are matched by the header's names; a value that is no number (or date) becomes null."""
    raw = spark.read.option("header", header).option("sep", delimiter).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE")
    if not header:
        raw = raw.schema(StructType([StructField(f.name, StringType()) for f in schema]))
    df = raw.csv(path)
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def copy_from_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object a line; a line that isn't JSON fails the copy; booleans become 0 or 1 in numeric columns; nested values stay JSON text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = lines.select(F.when(F.try_parse_json("value").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{")), F.raise_error(F.concat(F.lit("bad JSON line: "), F.col("value"))).cast("string")).otherwise(F.col("value")).alias("j"))

    def column(f: StructField):
        text = F.get_json_object("j", f"$['{f.name}']")
        if isinstance(f.dataType, NumericType):
            text = F.when(text == "true", "1").when(text == "false", "0").otherwise(text)
        return text.try_cast(f.dataType).alias(f.name)

    return checked.select(*map(column, schema))


def copy_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def copy_from_stdin(spark: SparkSession, lines: Iterable[str], schema: StructType) -> DataFrame:
    r"""The tab-separated text protocol: \N is null, backslash escapes, \. ends."""
    back = {"t": "\t", "n": "\n", "r": "\r", "\\": "\\", "b": "\b", "f": "\f", "v": "\v"}

    def value(x: str):
        if x == "\\N":
            return None
        out, it = [], iter(x)
        for c in it:
            if c == "\\":
                c = next(it, "\\")
                c = back.get(c, c)
            out.append(c)
        return "".join(out)

    rows = []
    for line in lines:
        line = line.rstrip("\n")
        if line == "\\.":
            break
        row = [value(x) for x in line.split("\t")]
        if len(row) != len(schema):
            raise CopyError(f"expected {len(schema)} columns, got {len(row)}")
        rows.append(row)
    raw = spark.createDataFrame(rows, StructType([StructField(f.name, StringType()) for f in schema]))
    return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def copy_to(df: DataFrame, path: str, form: str = "parquet", root: str | None = None) -> None:
    """Writes df as parquet, csv or json under root."""
    at = confined(path, root) if root else path
    w = df.write.mode("overwrite")
    if form == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(form).save(at)


def literal(kind, column):
    """SQL text of a value."""
    quoted = F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, BooleanType):
        text = F.when(column, "TRUE").otherwise("FALSE")
    elif isinstance(kind, NumericType | DecimalType):
        text = column.cast("string")
    elif isinstance(kind, DateType | TimestampType):
        text = quoted
    else:
        text = quoted
    return F.when(column.isNull(), "NULL").otherwise(text)


def dump_sql(df: DataFrame, name: str) -> DataFrame:
    """One INSERT a row (column sql); rendered by the executors."""
    values = F.concat_ws(", ", *(literal(f.dataType, F.col(f.name)) for f in df.schema))
    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("sql"))
