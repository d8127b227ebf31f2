"""JSON and JSONB operators on text columns.

JSONB values are held as canonical text: sorted keys, no blanks, the last of equal keys, numbers as written
(so 1 and 1.0 differ).
"""

from __future__ import annotations

import json as _json
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class JsonError(ValueError):
    pass


class _Number(float):
    """A JSON number that keeps how it was written."""

    def __new__(cls, text: str):
        self = super().__new__(cls, float(Decimal(text)))
        self.text = text
        return self

    def __repr__(self):
        return self.text


def load(text: str):
    def refuse(word):
        raise ValueError(word)

    return _json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=refuse)


def dump(value) -> str:
    """Canonical text."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_json.dumps(k, ensure_ascii=False)}:{dump(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    if isinstance(value, _Number):
        return value.text
    return _json.dumps(value, ensure_ascii=False)


def canonical_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return dump(load(text))
    except ValueError as e:
        raise JsonError(f"invalid JSON: {text!r}") from e


def canonical(value: Column) -> Column:
    """JSONB: canonical text, by Arrow batches. Key order is out of reach of the built-in functions."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(canonical_text, na_action="ignore")

    return F.pandas_udf(run, "string")(value)


def valid(text: Column) -> Column:
    """True unless the text is not JSON; scalars and null are JSON."""
    return text.isNull() | F.try_parse_json(text).isNotNull()


def path(steps: Sequence[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def as_steps(braced: str) -> list[str | int]:
    """'{a,0}' -> ['a', 0]"""
    return [int(s) if s.lstrip("-").isdigit() else s for s in braced.strip("{}").split(",") if s != ""]


def get_text(value: Column, *steps: str | int) -> Column:
    """``->>`` and ``#>>``: text; null where missing or JSON null."""
    return F.get_json_object(value, path(steps))


def get(value: Column, *steps: str | int) -> Column:
    """``->`` and ``#>``: JSON text. Strings get their quotes back; other values are given as they are written."""
    text = get_text(value, *steps)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path(steps), "variant"))
    return F.when(kind == "STRING", F.to_json(F.transform(F.array(text), lambda x: x)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)).otherwise(text)


def has_key(value: Column, key: str) -> Column:
    """``?``: also where the key's value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), value.isNull() & F.lit(None).cast("boolean"), F.lit(False))


def contains(value: Column, wanted: str) -> Column:
    """``@>`` with an object: each of its members is there, objects member by member; numbers as written."""
    try:
        tree = load(wanted)
    except ValueError as e:
        raise JsonError(f"invalid JSONB RHS: {wanted!r}") from e
    if isinstance(tree, list):
        raise JsonError("array containment is not supported")
    if not isinstance(tree, dict):
        return F.lit(False)
    out = F.json_object_keys(value).isNotNull()

    def walk(node: dict, at: list):
        nonlocal out
        for key, x in node.items():
            here = [*at, key]
            holder = get_text(value, *at) if at else value
            out = out & F.coalesce(F.array_contains(F.json_object_keys(holder), key), F.lit(False))
            text = get_text(value, *here)
            if isinstance(x, dict):
                out = out & F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))
                walk(x, here)
            elif x is None:
                out = out & text.isNull()
            elif isinstance(x, list):
                raise JsonError("array containment is not supported")
            else:
                kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path(here), "variant"))
                kinds = "STRING" if isinstance(x, str) else "BOOLEAN" if isinstance(x, bool) else None
                same = text == (x if isinstance(x, str) else dump(x))
                out = out & F.coalesce(same & ((kind == kinds) if kinds else ~kind.isin("STRING", "BOOLEAN")), F.lit(False))

    walk(tree, [])
    return out


def array_length(value: Column) -> Column:
    """Null unless the value is an array."""
    return F.json_array_length(value)
