"""Rows that arrive as JSON arrays of objects, one array in each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def json_rows(data: DataFrame, col: str, schema: StructType) -> DataFrame:
    """The objects of each array as rows; texts or bytes. Null and empty texts have none; what is no array of objects is an error."""
    text: Column = F.col(f"`{col}`").cast("string")
    filled = data.where(F.trim(text) != "")
    parsed = F.from_json(text, ArrayType(schema), {"mode": "FAILFAST"})
    checked = F.when(F.startswith(F.ltrim(text), F.lit("[")), parsed).otherwise(F.raise_error(F.lit("rows must be a JSON array of objects")).cast(ArrayType(schema)))
    return filled.select(F.explode(checked).alias("__row")).select("__row.*")
