"""Tokens, trigrams and synonyms of text columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenise(text: Column) -> Column:
    """Lower-case runs of letters and digits of more than one byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) > 1)


def trigrams(text: Column, padded: bool = True) -> Column:
    """Distinct three-character windows of the lower-cased text; padded by two blanks before and one after."""
    t = F.lower(text)
    t = F.concat(F.lit("  "), t, F.lit(" ")) if padded else t
    return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def synonym_map(groups: Iterable[Iterable[str]] = (), one_way: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """term -> sorted synonyms, from two-way groups and one-way entries."""
    out: dict[str, set[str]] = {}
    for group in groups:
        group = [t.lower() for t in group]
        for t in group:
            out.setdefault(t, set()).update(x for x in group if x != t)
    for t, more in (one_way or {}).items():
        out.setdefault(t.lower(), set()).update(x.lower() for x in more)
    return {t: sorted(v) for t, v in out.items()}


def expand_terms(terms: Iterable[str], synonyms: Mapping[str, list[str]]) -> list[str]:
    """Each term followed by its synonyms, first occurrences only."""
    return list(dict.fromkeys(x for t in terms for x in (t.lower(), *synonyms.get(t.lower(), ()))))


def expand(tokens: Column, synonyms: Mapping[str, list[str]]) -> Column:
    """The same on an array column."""
    if not synonyms:
        return F.array_distinct(tokens)
    known = F.create_map(*(x for t, v in synonyms.items() for x in (F.lit(t), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(known[t], F.array().cast("array<string>"))))))
