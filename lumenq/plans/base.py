"""What the query catalogue's modules share: tables, the register and scratch sessions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]
#: name -> query and the SQL that gives the same rows (None where SQL can't express it).
BUILT: dict[str, tuple[Build, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def put(fn: Build) -> Build:
        BUILT[name] = (fn, sql)
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **args) -> DataFrame:
    """Spark SQL over the driver's tables that the text names; {name} marks a table."""
    named = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, args=args or None, **{n: table(spark, sf_dir, n) for n in named})


def database(spark: SparkSession, sf_dir: str, **tables: str):
    """A session over a catalogue of its own, whose tables have the rows of the driver's tables of the same names."""
    from ..session import Session
    from ..sources.copying import scratch

    db = Session(spark, scratch(spark, "db"))
    for name, columns in tables.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.catalog.commit(name, table(spark, sf_dir, name))
    return db
