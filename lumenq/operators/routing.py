"""Where work goes: what a statement is after, which path reads a table, and which shard holds a key."""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a statement's text shows, and what each sign weighs for an intent.
SIGNS = {
    "key": r"^(?=[\s\S]*WHERE)(?=[\s\S]*= [?$])",
    "one": r"LIMIT 1",
    "like": r"LIKE",
    "text": r"MATCH|TS_QUERY|SEARCH\(",
    "vector": r"COSINE|VECTOR|EMBEDDING|ANN\(",
    "group": r"GROUP BY",
    "aggregate": r"(SUM|COUNT|AVG|MIN|MAX)\(",
    "window": r"OVER\(|PARTITION BY",
    "order": r"ORDER BY",
    "join": r"JOIN",
}
#: Fixed values: (signs that are there, signs that are not there, weight), by intent; of equal sums the later intent counts.
WEIGHTS = {
    "lookup": [("key", "", 5.0), ("one", "", 2.0), ("", "", 1.0), ("", "aggregate group", 1.0), ("", "like text", 1.0)],
    "search": [("like", "", 3.0), ("text", "", 5.0), ("order", "", 1.0), ("", "aggregate", 0.5), ("", "vector", 1.0)],
    "analytics": [("aggregate", "", 4.0), ("group", "", 4.0), ("window", "", 3.0), ("join", "", 1.0)],
    "hybrid": [("vector", "", 4.0), ("text vector", "", 5.0), ("like vector", "", 3.0)],
}
#: Purposes for which the strict gate lets a pure vector search pass.
SUGGESTING = {"suggestion", "suggest", "question-suggestion", "recommendation", "recommend", "autocomplete"}


def intent(sql: Column) -> Column:
    """lookup, search, analytics or hybrid, for a column of statements; null for null."""
    up = F.upper(sql)
    shown = {name: up.rlike(pattern) for name, pattern in SIGNS.items()}

    def weighed(rules) -> Column:
        total = F.lit(0.0)
        for there, absent, weight in rules:
            holds = F.lit(True)
            for x in there.split():
                holds = holds & shown[x]
            for x in absent.split():
                holds = holds & ~shown[x]
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    ranked = F.array(*(F.struct(weighed(rules).alias("sum"), F.lit(i).alias("place"), F.lit(name).alias("intent")) for i, (name, rules) in enumerate(WEIGHTS.items())))
    return F.when(sql.isNotNull(), F.array_max(ranked)["intent"])


class PolicyError(PermissionError):
    pass


def vector_gate(purpose: str | None, strict: bool = True, suggestions_only: bool = True, allow_join: bool = False) -> None:
    """Under the strict policy a search of suggestions alone needs a purpose that asks for suggestions, or leave to join vectors."""
    if strict and suggestions_only and not allow_join and (purpose or "").lower() not in SUGGESTING:
        raise PolicyError("vector search requires a purpose that asks for suggestions")


def scan_path(tokens: list[str], primary: list[str]) -> str:
    """The label of EXPLAIN for what reads the table: a distance, a text predicate, an equal key, an aggregate, or rows."""
    up = [t.upper() for t in tokens]
    if {"<->", "<=>", "<#>", "LIKEV"} & set(up):
        return "VectorHnsw"
    if {"@@", "MATCH"} & set(up):
        return "FtsInverted"
    names = [t.strip('"').lower() for t in tokens]
    where = up.index("WHERE") if "WHERE" in up else len(up)
    if any(names[i] in primary and up[i + 1] == "=" for i in range(where, len(up) - 1)):
        return "IndexPoint"
    if {"GROUP", "SUM", "AVG", "COUNT", "MIN", "MAX", "BETWEEN"} & set(up):
        return "ColumnScan"
    return "RowScan"


class HashRing:
    """Consistent hashing of keys to shards.

    Each shard owns ``points`` places of a ring of ``slots``; a key belongs to the first place at or behind its slot. A
    shard that is added takes slots from the others and moves nothing among them. Slots are a constant of the plan
    (two bytes each), so that a key is placed by one hash and one look-up in the JVM, whatever the number of shards.
    """

    def __init__(self, shards: list[str], points: int = 128, slots: int = 4096):
        if not shards or len(set(shards)) != len(shards):
            raise ValueError("shards must have different names")
        self.shards, self.slots = list(shards), slots
        place = lambda s, k: int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "big") % slots
        ring = sorted((place(s, k), s) for s in shards for k in range(points))
        number = {s: i for i, s in enumerate(shards)}
        self._ring, self._at = [number[s] for _, s in ring], [p for p, _ in ring]

    def owners(self, slot: int, n: int = 1) -> list[str]:
        """The n different shards that hold a slot, its owner first (fewer where there are fewer shards)."""
        start, out = bisect.bisect_left(self._at, slot), []
        for k in range(len(self._ring)):
            s = self._ring[(start + k) % len(self._ring)]
            if s not in out:
                out.append(s)
                if len(out) == n:
                    break
        return [self.shards[s] for s in out]

    def slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def replicas(self, key: Column, n: int = 1) -> Column:
        """An array of n shards for each key, the owner first; nulls are a key too."""
        n = min(n, len(self.shards))
        number = {s: i for i, s in enumerate(self.shards)}
        held = b"".join(number[s].to_bytes(2, "big") for slot in range(self.slots) for s in self.owners(slot, n))
        at = lambda k: F.conv(F.hex(F.substring(F.lit(held), 2 * (n * self.slot(key) + k) + 1, F.lit(2))), 16, 10).cast("int")
        return F.transform(F.array(*(at(k) for k in range(n))), lambda i: F.get(F.array(*map(F.lit, self.shards)), i))

    def shard(self, key: Column) -> Column:
        return F.get(self.replicas(key), 0)


_COMPARED = re.compile(r"(?i)\b(\w+)\s*(=|<=|>=|<|>|\bIN\b|\bBETWEEN\b|@>|@@)")


def advise(statements: list[str], tables: dict[str, list[str]], least: int = 2) -> list[tuple[str, str, str, int]]:
    """(table, column, method, times) of columns that at least ``least`` statements filter or join by, most used first.

    It is advice only: results and plans of the session never depend on an index. Columns that several tables
    have are given to the tables that the statement names.
    """
    times: dict[tuple[str, str, str], int] = {}
    for sql in statements:
        words = {w.lower() for w in re.findall(r"\w+", sql)}
        text = re.sub(r"'(?:[^']|'')*'", "''", sql)
        found = set()
        for column, sign in _COMPARED.findall(text):
            method = {"@>": "gin", "@@": "inverted"}.get(sign, "btree")
            found |= {(t, column.lower(), method) for t, columns in tables.items() if t in words and column.lower() in columns}
        for x in found:
            times[x] = times.get(x, 0) + 1
    return [(*x, n) for x, n in sorted(times.items(), key=lambda p: (-p[1], p[0])) if n >= least]
