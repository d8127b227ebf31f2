"""A SQL session: the dialect over snapshot tables, with DML, constraints and transactions.

Every write is a DataFrame plan over the table's last version and becomes a new version: INSERT and COPY add files, other
changes write the table anew. Inside a transaction rows are held as plans and definitions as manifests, and
COMMIT publishes all of them at once, unless another session has changed one of these tables since it was first used.
"""

from __future__ import annotations

import copy
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from . import frontend as fe
from .catalog import Catalog, CatalogError
from .functions import json as J
from .operators import search as S
from .operators.routing import scan_path
from .sources import copying


class ConstraintError(ValueError):
    pass


@dataclass
class Result:
    tag: str
    df: DataFrame | None = None


_TYPES: dict[str, DataType] = {
    **dict.fromkeys(("INT", "INTEGER", "BIGINT", "SMALLINT", "SERIAL", "BIGSERIAL"), LongType()), **dict.fromkeys(("FLOAT", "REAL", "DOUBLE"), DoubleType()), **dict.fromkeys(("NUMERIC", "DECIMAL"), DecimalType(38, 18)),
    **dict.fromkeys(("TEXT", "VARCHAR", "CHAR", "STRING", "JSON", "JSONB", "UUID"), StringType()), **dict.fromkeys(("BOOLEAN", "BOOL"), BooleanType()), "TIMESTAMP": TimestampType(), "DATE": DateType(), "BYTEA": BinaryType(), "VECTOR": ArrayType(DoubleType()),
}
_UUID = "^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"


def _split(toks: list[str], sep: str = ",") -> list[list[str]]:
    """Parts of a token list at separators outside brackets."""
    out, depth = [[]], 0
    for t in toks:
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(t, 0)
        if t == sep and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _group(toks: list[str], at: int) -> tuple[list[str], int]:
    """The tokens inside the bracket at a place, and the place after it."""
    if at >= len(toks) or toks[at] != "(":
        raise fe.SqlError("expected (")
    depth = 0
    for k in range(at, len(toks)):
        depth += {"(": 1, ")": -1}.get(toks[k], 0)
        if not depth:
            return toks[at + 1 : k], k + 1
    raise fe.SqlError("missing )")


def _find(toks: list[str], word: str, start: int = 0) -> int:
    """The place of a keyword outside brackets, or the end."""
    depth = 0
    for k in range(start, len(toks)):
        depth += {"(": 1, ")": -1}.get(toks[k], 0)
        if not depth and toks[k].upper() == word:
            return k
    return len(toks)


def _name(t: str) -> str:
    return t[1:-1] if t[:1] in "\"`" else t.lower()


class Session:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)
        # Of a transaction: rows (all; and those to append, if nothing else happened), definitions, and the state that they build upon.
        self.overlay: dict[str, tuple[DataFrame, DataFrame | None]] | None = None
        self.ddl: dict[str, dict | None] = {}
        self.base: dict[str, int] = {}
        self.prepared: dict[str, str] = {}
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")

    # tables
    def _manifest(self, name: str) -> dict:
        if name in self.ddl:
            if self.ddl[name] is None:
                raise CatalogError(f'relation "{name}" does not exist')
            return copy.deepcopy(self.ddl[name])
        m = self.catalog.manifest(name)
        self.base.setdefault(name, self.catalog.changed(name))
        return m

    def _tables(self) -> list[str]:
        return sorted({n for n in self.catalog.tables() if self.ddl.get(n, n) is not None} | {n for n, m in self.ddl.items() if m is not None})

    def table(self, name: str) -> DataFrame:
        if self.overlay is not None and name in self.overlay:
            return self.overlay[name][0]
        return self.catalog.frame(self._manifest(name))

    def as_of(self, name: str, lsn: int | None = None, timestamp: float | None = None) -> DataFrame:
        return self.catalog.read(name, lsn, timestamp)

    def _write(self, changes: dict[str, DataFrame], new: DataFrame | None = None, ddl: dict[str, dict | None] | None = None) -> None:
        """Rows of tables (new: of the only one, those that are added) and definitions."""
        ddl = ddl or {}
        for name in {**changes, **ddl}:
            self.catalog.lock(name, self)
        if self.overlay is not None:
            for name, df in changes.items():
                held = self.overlay.get(name)
                only = new if held is None or new is None else held[1].unionByName(new) if held[1] is not None else None
                self.overlay[name] = (df, only)
            for name, m in ddl.items():
                self.base.setdefault(name, self.catalog.changed(name))
                self.ddl[name] = m
                if m is None:
                    self.overlay.pop(name, None)
            return
        self._publish({n: (df, new) for n, df in changes.items()}, ddl)

    def _publish(self, changes: dict[str, tuple[DataFrame, DataFrame | None]], ddl: dict[str, dict | None]) -> None:
        out: dict[str, dict | None] = {}
        try:
            for name in {**changes, **ddl}:
                m = ddl[name] if name in ddl else self.catalog.manifest(name)
                if m is not None and name in changes:
                    every, new = changes[name]
                    m = self.catalog.with_version(name, m, every if new is None else new, append=new is not None)
                out[name] = m
            if out:
                self.catalog.publish(out, {n: self.base.get(n, self.catalog.changed(n)) for n in out})
        finally:
            self.catalog.unlock(self)
        for name, m in out.items():
            if m is None:
                self.catalog.forget(name)

    # statements
    def sql(self, sql: str, params: list | None = None) -> DataFrame | None:
        return self.execute(sql, params).df

    def run(self, script: str) -> list[Result]:
        return [self.execute(s) for s in fe.statements(script)]

    def prepare(self, name: str, sql: str) -> None:
        fe.tokens(sql)
        self.prepared[name] = sql

    def execute_prepared(self, name: str, params: list | None = None) -> Result:
        return self.execute(self.prepared[name], params)

    def execute(self, sql: str, params: list | None = None, data: list[str] | None = None) -> Result:
        sql = sql.strip().rstrip(";")
        kind = fe.classify(sql)
        toks = fe.tokens(sql)
        if params and kind != "SELECT":
            toks = [self._literal(params[int(t[1:]) - 1]) if re.fullmatch(r"\$\d+", t) else t for t in toks]
        if self.overlay is None:
            self.base = {}
        run = getattr(self, "_do_" + kind.lower().replace(" ", "_"), None)
        if kind in ("SELECT", "SEARCH", "LIKEV"):
            return Result("SELECT", self._select(sql, params))
        if run is None:
            raise fe.SqlError(f"{kind} is not supported")
        return run(toks, data) if kind == "COPY" else run(toks)

    @staticmethod
    def _literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"

    def _select(self, sql: str, params: list | None = None) -> DataFrame:
        m = re.fullmatch(r"\s*SEARCH\s+HYBRID\s+ON\s+(\w+)\s+LEXICAL\s+'((?:[^']|'')*)'\s+VECTOR\s+\[([^\]]*)\]\s+TOP\s+(\d+)\s*", sql, re.I)
        if m:
            t = self.table(m[1].lower())
            key, text, vec = self._search_columns(t)
            docs = t.select(F.col(key), F.col(text).alias("text"))
            vectors = t.where(F.col(vec).isNotNull()).select(F.col(key), F.col(vec).alias("embedding"))
            return S.hybrid(docs, vectors, m[2].replace("''", "'"), [float(x) for x in m[3].split(",")], int(m[4]), id_col=key, vec_id=key)
        if m := re.fullmatch(r"\s*LIKEV\s+VEC\s+\[([^\]]*)\]\s+IN\s+(\w+)\s+TOP\s+(\d+)\s*", sql, re.I):
            t = self.table(m[2].lower())
            key = t.columns[0]
            vec = next((f.name for f in t.schema if isinstance(f.dataType, ArrayType)), None)
            if vec is None:
                raise fe.SqlError(f"{m[2]} has no vector column")
            return S.knn(t.where(F.col(f"`{vec}`").isNotNull()), [float(x) for x in m[1].split(",")], int(m[3]), id_col=key, vec_col=vec).withColumnRenamed("id", key)
        if fe.classify(sql) == "LIKEV":
            raise fe.SqlError("LIKEV VEC [..] IN t TOP k")
        if fe.classify(sql) == "SEARCH":
            raise fe.SqlError("SEARCH HYBRID ON t LEXICAL '..' VECTOR [..] TOP k")
        if m := re.search(r"information_schema\s*\.\s*(tables|columns|statistics|key_column_usage|table_constraints)", sql, re.I):
            view = f"information_schema_{m[1].lower()}"
            self.information(m[1].lower()).createOrReplaceTempView(view)
            sql = sql[: m.start()] + view + sql[m.end() :]
        if m := re.search(r"\b(\w+)\s+MATCH\s+'((?:[^']|'')*)'\s+TOP\s+(\d+)\b", sql, re.I):
            sql = self._match(sql, m)
        named = self._frames(sql)
        args = {f"p{i + 1}": v for i, v in enumerate(params or [])}
        for name, df in named.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(fe.rewrite(sql), args=args or None)

    def _match(self, sql: str, m: re.Match) -> str:
        """col MATCH 'terms' TOP k: the rest of the query over the rows that match, with their match_score; the k best of what it leaves."""
        before, after = sql[: m.start()], sql[m.end() :]
        source = re.search(r"\bFROM\s+(\w+)(?:\s+(?:AS\s+)?(?!WHERE\b)(\w+))?\s+WHERE\b", before, re.I)
        rest = [t.upper() for t in fe.tokens(after)]
        if not source or {"GROUP", "UNION", "INTERSECT", "EXCEPT", "LIMIT", "MATCH", "HAVING"} & set(rest) or re.search(r"\bFROM\b", before[: source.start()], re.I):
            raise fe.SqlError("MATCH .. TOP needs SELECT .. FROM one table WHERE .., without GROUP BY, set operations or LIMIT")
        t = self.table(_name(source[1]))
        row = F.struct(*(F.col(f"`{c}`") for c in t.columns))
        view = f"__match_{_name(source[1])}"
        S.bm25(t.select(row.alias("row"), F.col(f"`{_name(m[1])}`").alias("text")), m[2].replace("''", "'"), "row", "text").select("id.*", F.col("score").alias("match_score")).createOrReplaceTempView(view)
        order = "" if "ORDER" in rest else f" ORDER BY match_score DESC, `{t.columns[0]}`"
        return f"{before[: source.start(1)]}{view} AS {source[2] or source[1]} WHERE {before[source.end() :]}match_score IS NOT NULL{after}{order} LIMIT {m[3]}"

    def information(self, what: str) -> DataFrame:
        """Rows of information_schema's tables."""
        rows, kinds = [], {"tables": "table_name string, table_type string", "columns": "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string", "statistics": "table_name string, index_name string, column_name string", "key_column_usage": "table_name string, column_name string, constraint_type string", "table_constraints": "table_name string, constraint_type string, columns string"}
        for t in self._tables():
            m = self._manifest(t)
            c = m["constraints"]
            keys = [("PRIMARY KEY", c.get("primary") or [])] + [("UNIQUE", u) for u in c.get("unique", []) if u != c.get("primary")] + [("FOREIGN KEY", f["cols"]) for f in c.get("fks", [])]
            keys = [(k, cols) for k, cols in keys if cols]
            if what == "tables":
                rows.append((t, "BASE TABLE"))
            elif what == "columns":
                rows += [(t, f.name, i + 1, c["kinds"].get(f.name, f.dataType.simpleString()), "NO" if f.name in c["not_null"] else "YES") for i, f in enumerate(StructType.fromJson(m["schema"]))]
            elif what == "statistics":
                rows += [(t, n, col) for n, x in m["indexes"].items() for col in x["columns"]]
            elif what == "key_column_usage":
                rows += [(t, col, k) for k, cols in keys for col in cols]
            else:
                rows += [(t, k, ",".join(cols)) for k, cols in keys] + [(t, "CHECK", x) for x in c.get("checks", [])]
        return self.spark.createDataFrame(rows, kinds[what])

    def to_arrow(self, sql: str, params: list | None = None):
        """A query's result by columns, as an Arrow table."""
        return self.sql(sql, params).toArrow()

    def _search_columns(self, t: DataFrame) -> tuple[str, str, str]:
        kinds = {f.name: f.dataType for f in t.schema}
        text = next(n for n, k in kinds.items() if isinstance(k, StringType))
        vec = next(n for n, k in kinds.items() if isinstance(k, ArrayType))
        return next(iter(kinds)), text, vec

    def _frames(self, sql: str) -> dict[str, DataFrame]:
        words = {_name(t) for t in fe.tokens(sql) if re.fullmatch(r"[A-Za-z_]\w*|\"[^\"]+\"", t)}
        return {n: self.table(n) for n in self._tables() if n in words}

    # DDL
    def _do_create_table(self, toks):
        k = 2 + 3 * (len(toks) > 4 and [t.upper() for t in toks[2:5]] == ["IF", "NOT", "EXISTS"])
        name = _name(toks[k])
        if name in self._tables():
            if k > 2:
                return Result("CREATE TABLE")
            raise CatalogError(f'relation "{name}" already exists')
        body, _ = _group(toks, k + 1)
        fields, c = [], {"not_null": [], "unique": [], "checks": [], "default": {}, "fks": [], "identity": {}, "kinds": {}, "primary": []}
        for part in _split(body):
            up = [t.upper() for t in part]
            if up[0] == "CONSTRAINT":
                part, up = part[2:], up[2:]
            if up[:2] == ["PRIMARY", "KEY"]:
                c["primary"] = [_name(x[0]) for x in _split(_group(part, 2)[0])]
                c["not_null"] += c["primary"]
            elif up[0] == "UNIQUE":
                c["unique"].append([_name(x[0]) for x in _split(_group(part, 1)[0])])
            elif up[0] == "CHECK":
                c["checks"].append(" ".join(_group(part, 1)[0]))
            elif up[:2] == ["FOREIGN", "KEY"]:
                cols, at = _group(part, 2)
                c["fks"].append(self._fk([_name(x[0]) for x in _split(cols)], part, at))
            else:
                fields.append(self._column(part, c))
        if c["primary"]:
            c["unique"].append(c["primary"])
        self._write({}, ddl={name: self.catalog.fresh(StructType(fields), c)})
        return Result("CREATE TABLE")

    def _column(self, part: list[str], c: dict) -> StructField:
        name, kind = _name(part[0]), part[1].upper()
        if kind not in _TYPES:
            raise fe.SqlError(f"unknown type {part[1]}")
        at, dtype = 2, _TYPES[kind]
        if at < len(part) and part[at].upper() == "PRECISION":
            at += 1
        if at < len(part) and part[at] == "(":
            inner, at = _group(part, at)
            if kind in ("NUMERIC", "DECIMAL"):
                dtype = DecimalType(int(inner[0]), int(inner[2]) if len(inner) > 2 else 0)
            elif kind == "VECTOR":
                c["checks"].append(f"{name} IS NULL OR size({name}) = {int(inner[0])}")
                c["kinds"][name] = f"VECTOR({int(inner[0])})"
        if part[at : at + 2] == ["[", "]"]:
            dtype, at = ArrayType(dtype), at + 2
        if kind in ("JSON", "JSONB", "UUID"):
            c["kinds"][name] = kind
        if kind in ("SERIAL", "BIGSERIAL"):
            c["identity"][name] = "serial"
            c["not_null"].append(name)
        up = [t.upper() for t in part]
        while at < len(part):
            if up[at : at + 2] == ["NOT", "NULL"]:
                c["not_null"].append(name)
                at += 2
            elif up[at : at + 2] == ["PRIMARY", "KEY"]:
                c["primary"] = [name]
                c["not_null"].append(name)
                if isinstance(dtype, LongType) and name not in c["identity"]:
                    c["identity"][name] = "primary"
                at += 2
            elif up[at] == "UNIQUE":
                c["unique"].append([name])
                at += 1
            elif up[at] == "NULL":
                at += 1
            elif up[at] == "DEFAULT":
                end = at + 2
                if part[at + 1] == "-":
                    end += 1
                if end < len(part) and part[end] == "(":
                    _, end = _group(part, end)
                c["default"][name] = " ".join(part[at + 1 : end])
                at = end
            elif up[at] == "CHECK":
                inner, at = _group(part, at + 1)
                c["checks"].append(" ".join(inner))
            elif up[at] == "REFERENCES":
                fk = self._fk([name], part, at)
                c["fks"].append(fk)
                at = fk.pop("end")
            elif up[at] == "GENERATED":
                always = up[at + 1] == "ALWAYS"
                c["identity"][name] = "always" if always else "by default"
                c["not_null"].append(name)
                at += 4 if always else 5
            else:
                raise fe.SqlError(f"unexpected {part[at]}")
        return StructField(name, dtype)

    def _fk(self, cols: list[str], part: list[str], at: int) -> dict:
        up = [t.upper() for t in part]
        if up[at] != "REFERENCES":
            raise fe.SqlError("expected REFERENCES")
        parent, at = _name(part[at + 1]), at + 2
        refs = cols
        if at < len(part) and part[at] == "(":
            inner, at = _group(part, at)
            refs = [_name(x[0]) for x in _split(inner)]
        fk = {"cols": cols, "parent": parent, "refs": refs, "delete": "NO ACTION", "update": "NO ACTION"}
        while at < len(part) and up[at] == "ON":
            action = up[at + 2]
            two = action in ("SET", "NO")
            fk[up[at + 1].lower()] = f"{action} {up[at + 3]}" if two else action
            at += 4 if two else 3
        return fk | {"end": at}

    def _do_drop_table(self, toks):
        soft = [t.upper() for t in toks[2:4]] == ["IF", "EXISTS"]
        rest = toks[4:] if soft else toks[2:]
        if not rest:
            raise fe.SqlError("DROP TABLE needs a name")
        name = _name(rest[0])
        if not soft or name in self._tables():
            self._manifest(name)
            self._write({}, ddl={name: None})
        return Result("DROP TABLE")

    def _do_truncate(self, toks):
        name = _name(toks[2] if toks[1].upper() == "TABLE" else toks[1])
        self._write({name: self.table(name).limit(0)})
        return Result("TRUNCATE TABLE")

    def _do_alter_table(self, toks):
        name, up = _name(toks[2]), [t.upper() for t in toks]
        m = self._manifest(name)
        schema, df = StructType.fromJson(m["schema"]), self.table(name)
        fields, others = list(schema), {}
        at = 4 + (len(up) > 4 and up[4] == "COLUMN")
        if up[3] == "ADD":
            f = self._column(toks[at:], m["constraints"])
            default = m["constraints"]["default"].get(f.name)
            df, fields = df.withColumn(f.name, (F.expr(default) if default else F.lit(None)).cast(f.dataType)), [*fields, f]
        elif up[3] == "DROP":
            gone = _name(toks[at])
            if len(fields) == 1:
                raise CatalogError("a table keeps its last column")
            if gone not in schema.names:
                raise CatalogError(f'column "{gone}" does not exist')
            self._without(name, m, gone)
            df, fields = df.drop(gone), [f for f in fields if f.name != gone]
        elif up[3] == "RENAME":
            old, new = _name(toks[at]), _name(toks[at + 2])
            if old not in schema.names or new in schema.names:
                raise CatalogError(f'column "{old}" does not exist, or "{new}" does')
            others = self._renamed(name, m, old, new)
            df, fields = df.withColumnRenamed(old, new), [StructField(new, f.dataType) if f.name == old else f for f in fields]
        elif up[3] == "ALTER":
            col, kind = _name(toks[at]), _TYPES[toks[_find(toks, "TYPE") + 1].upper()]
            df, fields = df.withColumn(col, F.col(col).cast(kind)), [StructField(col, kind) if f.name == col else f for f in fields]
        else:
            raise fe.SqlError("ADD, DROP, RENAME or ALTER")
        m["schema"] = StructType(fields).jsonValue()
        if up[3] in ("ADD", "ALTER"):
            self._check(name, m, df)
        self._write({name: df}, ddl={**others, name: m})
        return Result("ALTER TABLE")

    def _without(self, name: str, m: dict, gone: str) -> None:
        """Takes a column out of a definition, with the constraints and indexes that need it; other tables' foreign keys forbid it."""
        for child in self._tables():
            if any(fk["parent"] == name and gone in fk["refs"] for fk in self._manifest(child)["constraints"].get("fks", ())):
                raise ConstraintError(f'"{child}" refers to column "{gone}"')
        c = m["constraints"]
        c["not_null"] = [x for x in c["not_null"] if x != gone]
        c["unique"] = [u for u in c["unique"] if gone not in u]
        c["primary"] = [] if gone in c["primary"] else c["primary"]
        c["fks"] = [fk for fk in c["fks"] if gone not in fk["cols"]]
        c["checks"] = [x for x in c["checks"] if gone not in map(_name, fe.tokens(x))]
        for part in ("default", "identity", "kinds"):
            c[part].pop(gone, None)
        m["indexes"] = {n: x for n, x in m["indexes"].items() if gone not in x["columns"]}

    def _renamed(self, name: str, m: dict, old: str, new: str) -> dict[str, dict]:
        """Renames a column throughout a definition; the definitions of other tables that refer to it."""
        named = lambda cols: [new if x == old else x for x in cols]
        c = m["constraints"]
        for part in ("not_null", "primary"):
            c[part] = named(c[part])
        c["unique"] = [named(u) for u in c["unique"]]
        c["checks"] = [" ".join(new if _name(t) == old and not t.startswith("'") else t for t in fe.tokens(x)) for x in c["checks"]]
        for fk in c["fks"]:
            fk["cols"] = named(fk["cols"])
            fk["refs"] = named(fk["refs"]) if fk["parent"] == name else fk["refs"]
        if old in c["identity"]:
            self.catalog.advance(name, new, least=self.catalog.sequence(name, old))
        for part in ("default", "identity", "kinds"):
            c[part] = {new if k == old else k: v for k, v in c[part].items()}
        for x in m["indexes"].values():
            x["columns"] = named(x["columns"])
        others = {}
        for child in self._tables():
            held = self._manifest(child)
            keys = [fk for fk in held["constraints"].get("fks", ()) if fk["parent"] == name and old in fk["refs"]]
            if child != name and keys:
                for fk in keys:
                    fk["refs"] = named(fk["refs"])
                others[child] = held
        return others

    def _do_create_index(self, toks):
        """Indexes are kept as metadata: results are the same with and without them, and pruning is the scan's."""
        unique = toks[1].upper() == "UNIQUE"
        k = 2 + unique
        on = _find(toks, "ON")
        name, table = _name(toks[k]), _name(toks[on + 1])
        at = on + 2
        method = "btree"
        if toks[at].upper() == "USING":
            method, at = toks[at + 1].lower(), at + 2
            if toks[at] == "(" and toks[at + 1].startswith("'"):
                method += " " + toks[at + 1]
                _, at = _group(toks, at)
        inner, _ = _group(toks, at)
        if any(t in ("->", "->>", "#>", "#>>") for t in inner):
            raise fe.SqlError("an index on a JSONB expression is not supported")
        cols = [_name(p[0]) for p in _split(inner)]
        m = self._manifest(table)
        if unique:
            m["constraints"]["unique"].append(cols)
            self._check(table, m, self.table(table), only_unique=True)
        m["indexes"][name] = {"columns": cols, "method": method, "unique": unique}
        self._write({}, ddl={table: m})
        return Result("CREATE INDEX")

    def _do_drop_index(self, toks):
        name = _name(toks[-1])
        for t in self._tables():
            m = self._manifest(t)
            if name in m["indexes"]:
                gone = m["indexes"].pop(name)
                if gone["unique"] and gone["columns"] in m["constraints"]["unique"]:
                    m["constraints"]["unique"].remove(gone["columns"])
                self._write({}, ddl={t: m})
                return Result("DROP INDEX")
        raise CatalogError(f'index "{name}" does not exist')

    def _do_sequence(self, toks):
        raise fe.SqlError("sequences are made by identity columns only")

    def _do_savepoint(self, toks):
        raise fe.SqlError("SAVEPOINT is not supported")

    # DML
    def _do_insert(self, toks):
        name = _name(toks[2])
        m = self._manifest(name)
        schema, c = StructType.fromJson(m["schema"]), m["constraints"]
        at, cols = 3, list(schema.names)
        given = False
        if at < len(toks) and toks[at] == "(":
            inner, at = _group(toks, at)
            cols, given = [_name(p[0]) for p in _split(inner)], True
        over = [t.upper() for t in toks[at : at + 3]]
        if over[:1] == ["OVERRIDING"]:
            if over[1] != "SYSTEM":
                raise fe.SqlError("OVERRIDING USER VALUE is not supported")
            at += 3
        if bad := [x for x in cols if x not in schema.names]:
            raise CatalogError(f'column "{bad[0]}" does not exist')
        if toks[at].upper() == "VALUES":
            rows = [_split(_group(p, 0)[0]) for p in _split(toks[at + 1 :])]
            if any(len(r) > len(cols) or given and len(r) != len(cols) for r in rows):
                raise fe.SqlError("INSERT has more or fewer expressions than columns")
            width = max(map(len, rows))
            cols = cols[:width]
            marks = [[k for k, x in enumerate(r) if [t.upper() for t in x] == ["DEFAULT"]] for r in rows]
            if any(marks) and any(x != marks[0] for x in marks):
                raise fe.SqlError("DEFAULT must stand in the same columns of each row")
            cols = [x for k, x in enumerate(cols) if k not in marks[0]]
            text = ", ".join("(" + ", ".join(self._value(x, schema[cols_all].dataType) for k, (x, cols_all) in enumerate(zip(r, schema.names if not given else self._named(toks), strict=False)) if k not in marks[0]) + ")" for r in rows)
            new = self.spark.sql(f"SELECT * FROM VALUES {text} AS v({', '.join(f'`{x}`' for x in cols)})")
            many = False
        else:
            got = self._select(" ".join(toks[at:]))
            if len(got.columns) > len(cols):
                raise fe.SqlError("INSERT has more or fewer expressions than columns")
            cols = cols[: len(got.columns)]
            new, many = got.toDF(*cols), True
        return Result(f"INSERT 0 {self._add(name, m, new, cols, over[:1] == ['OVERRIDING'], many)}")

    def _add(self, name: str, m: dict, new: DataFrame, cols: list[str], overriding: bool = False, many: bool = True) -> int:
        """Appends rows that have some columns: values are coerced, the others come from defaults and sequences. The number of rows."""
        schema, c = StructType.fromJson(m["schema"]), m["constraints"]
        numbered = [col for col in c["identity"] if col not in cols]
        if numbered:
            new = self._numbered(new) if many else new.withColumn("__o", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # VALUES: rows of a statement's text
        out = {}
        for f in schema:
            if f.name in cols:
                out[f.name] = self._coerced(F.col(f"`{f.name}`"), f, c)
            elif f.name in c["default"]:
                out[f.name] = F.expr(fe.rewrite(c["default"][f.name])).cast(f.dataType)
            else:
                out[f.name] = F.lit(None).cast(f.dataType)
        # numbers from sequences; these advance whatever becomes of the statement
        count = new.count() if numbered else None
        for col, kind in c["identity"].items():
            if kind == "always" and col in cols and not overriding:
                raise ConstraintError(f'column "{col}" is GENERATED ALWAYS')
            if col in numbered:
                now = self.catalog.advance(name, col, count)
                out[col] = (F.lit(now) + F.col("__o")).cast("long")
                if kind == "serial" and now + count > 2**31 - 1:
                    raise ConstraintError("sequence is exhausted")
            elif kind == "primary":
                self.catalog.advance(name, col, least=new.agg(F.max(F.col(f"`{col}`").cast("long"))).first()[0] or 0)
        new = new.select(*(e.alias(n) for n, e in out.items()))
        n = new.count()
        every = self.table(name).unionByName(new)
        self._check(name, m, every, new)
        self._write({name: every}, new)
        return n

    def _numbered(self, df: DataFrame) -> DataFrame:
        """Rows with numbers from 1 (``__o``): places within tasks, and the sums of the tasks before; no task holds them all."""
        at = f"{self.catalog.root}/_tmp/{uuid.uuid4().hex}"
        df.withColumn("__m", F.monotonically_increasing_id()).write.parquet(at)
        got = self.spark.read.parquet(at).withColumn("__t", F.shiftright("__m", 33))
        tasks = got.groupBy("__t").agg(F.count("*").alias("__k"))
        before = tasks.select("__t", (F.sum("__k").over(Window.orderBy("__t")) - F.col("__k")).alias("__b"))  # a row for each task
        return got.join(F.broadcast(before), "__t").withColumn("__o", F.col("__b") + (F.col("__m") - F.shiftleft("__t", 33)) + 1).drop("__t", "__m", "__b")

    def _named(self, toks: list[str]) -> list[str]:
        return [_name(p[0]) for p in _split(_group(toks, 3)[0])]

    @staticmethod
    def _value(x: list[str], kind: DataType) -> str:
        if isinstance(kind, ArrayType) and len(x) == 1 and x[0].startswith("'"):
            return f"from_json({fe.quote(fe.text_of(x[0]))}, 'array<double>')"
        up = " ".join(x).lower().replace(" ", "")
        if up in ("gen_random_uuid()", "uuid_generate_v4()"):
            return "uuid()"
        return fe.rewrite(" ".join(x))

    def _coerced(self, col, f: StructField, c: dict):
        kind = c["kinds"].get(f.name, "")
        if kind == "UUID":
            low = F.lower(col.cast("string"))
            return F.when(col.isNull() | low.rlike(_UUID), low).otherwise(F.raise_error(F.concat(F.lit("invalid UUID: "), col.cast("string"))).cast("string"))
        if kind == "JSON":
            text = col.cast("string")
            return F.when(J.valid(text), text).otherwise(F.raise_error(F.concat(F.lit("invalid JSON: "), text)).cast("string"))
        if kind == "JSONB":
            return J.canonical(col.cast("string"))
        if kind.startswith("VECTOR"):
            dim = int(kind[7:-1])
            v = col.cast(f.dataType)
            wrong = F.concat(F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(v).cast("string"))
            return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(wrong).cast(f.dataType))
        return col.cast(f.dataType)

    def _target(self, toks: list[str], at: int) -> tuple[str, str | None]:
        where = _find(toks, "WHERE")
        if where < len(toks) and where + 1 == len(toks):
            raise fe.SqlError("WHERE needs a condition")
        return _name(toks[at]), fe.rewrite(" ".join(toks[where + 1 :])) if where < len(toks) else None

    def _filtered(self, name: str, where: str | None) -> DataFrame:
        """The table with a flag of the rows that a condition (subqueries included) holds for."""
        df = self.table(name)
        if where is None:
            return df.withColumn("__hit", F.lit(True))
        for n, t in self._frames(where).items():
            t.createOrReplaceTempView(n)
        df.createOrReplaceTempView(name)
        return self.spark.sql(f"SELECT *, coalesce(({where}), false) AS __hit FROM {name}")

    def _do_delete(self, toks):
        if toks[1].upper() != "FROM":
            raise fe.SqlError("expected FROM")
        name, where = self._target(toks, 2)
        self._manifest(name)
        flagged = self._filtered(name, where)
        gone = flagged.where("__hit").drop("__hit")
        n = gone.count()
        changes = {name: flagged.where("NOT __hit").drop("__hit")}
        self._deleted(name, gone, changes)
        self._check_others(name, changes)
        self._write(changes)
        return Result(f"DELETE {n}")

    def _do_update(self, toks):
        name, where = self._target(toks, 1)
        m = self._manifest(name)
        schema = StructType.fromJson(m["schema"])
        sets = {}
        for part in _split(toks[_find(toks, "SET") + 1 : _find(toks, "WHERE")]):
            if len(part) < 3 or part[1] != "=":
                raise fe.SqlError("expected column = expression")
            sets[_name(part[0])] = part[2:]
        if bad := [x for x in sets if x not in schema.names]:
            raise CatalogError(f'column "{bad[0]}" does not exist')
        flagged = self._filtered(name, where)
        old = flagged.where("__hit").drop("__hit")
        always = [x for x in sets if m["constraints"]["identity"].get(x) == "always"]
        if always:
            raise ConstraintError(f'column "{always[0]}" is GENERATED ALWAYS')
        exprs = []
        for f in schema:
            e = F.col(f"`{f.name}`")
            if f.name in sets:
                e = F.when(F.col("__hit"), self._coerced(F.expr(self._value(sets[f.name], f.dataType)), f, m["constraints"])).otherwise(e)
            exprs.append(e.alias(f.name))
        new = flagged.select(*exprs)
        n = old.count()
        changes = {name: new}
        pairs = flagged.where("__hit").select(*(F.col(f"`{f.name}`").alias(f"o_{f.name}") for f in schema), *(e.alias(f"n_{f.name}") for f, e in zip(schema, exprs, strict=True)))
        self._updated(name, pairs, set(sets), changes)
        self._check(name, m, changes[name], changes=changes)
        self._check_others(name, changes)
        self._write(changes)
        return Result(f"UPDATE {n}")

    def _children(self, parent: str):
        for child in self._tables():
            for fk in self._manifest(child)["constraints"].get("fks", ()):
                if fk["parent"] == parent:
                    yield child, fk

    def _replaced(self, child: str, fk: dict, rows: DataFrame, action: str) -> dict:
        """What foreign key columns become where the parent's row goes or changes."""
        default = self._manifest(child)["constraints"]["default"]
        return {c: (F.expr(default[c]) if action == "SET DEFAULT" and c in default else F.lit(None)).cast(rows.schema[c].dataType) for c in fk["cols"]}

    def _deleted(self, parent: str, gone: DataFrame, changes: dict) -> None:
        """Foreign keys that name rows which go: their rows go too, lose the key, or forbid it."""
        for child, fk in self._children(parent):
            keys = gone.select(*(F.col(r).alias(f"__{c}") for c, r in zip(fk["cols"], fk["refs"], strict=True))).distinct()
            rows = changes.get(child, self.table(child))
            same = [F.col(c) == F.col(f"__{c}") for c in fk["cols"]]
            hit, rest = rows.join(keys, same, "left_semi"), rows.join(keys, same, "left_anti")
            action = fk["delete"]
            if action in ("RESTRICT", "NO ACTION"):
                if hit.limit(1).count():
                    raise ConstraintError(f'"{child}" still refers to "{parent}"')
            elif action == "CASCADE":
                changes[child] = rest
                # A table that refers to itself is followed until no row goes.
                if child != parent or hit.limit(1).count():
                    self._deleted(child, hit, changes)
            else:
                self._set(child, fk, rows, hit, keys, self._replaced(child, fk, rows, action), changes)

    def _updated(self, parent: str, pairs: DataFrame, columns: set[str], changes: dict) -> None:
        """Foreign keys that name rows whose key changes (pairs: old and new values, o_ and n_), through any number of tables."""
        for child, fk in self._children(parent):
            if not set(fk["refs"]) & columns:
                continue
            differ = " OR ".join(f"NOT (`o_{r}` <=> `n_{r}`)" for r in fk["refs"])
            keys = pairs.where(differ).select(*(F.col(f"o_{r}").alias(f"__{c}") for c, r in zip(fk["cols"], fk["refs"], strict=True)), *(F.col(f"n_{r}").alias(f"__new_{c}") for c, r in zip(fk["cols"], fk["refs"], strict=True))).distinct()
            rows = changes.get(child, self.table(child))
            hit = rows.join(keys, [F.col(c) == F.col(f"__{c}") for c in fk["cols"]], "left_semi")
            if not hit.limit(1).count():
                continue
            action = fk["update"]
            if action in ("RESTRICT", "NO ACTION"):
                raise ConstraintError(f'"{child}" still refers to "{parent}"')
            to = {c: F.col(f"__new_{c}").cast(rows.schema[c].dataType) for c in fk["cols"]} if action == "CASCADE" else self._replaced(child, fk, rows, action)
            self._set(child, fk, rows, hit, keys, to, changes)

    def _set(self, child: str, fk: dict, rows: DataFrame, hit: DataFrame, keys: DataFrame, to: dict, changes: dict) -> None:
        """Rows that meet keys get new foreign key columns, and what refers to these follows."""
        joined = rows.join(keys, [F.col(c) == F.col(f"__{c}") for c in fk["cols"]], "left")
        met = F.col(f"__{fk['cols'][0]}").isNotNull()
        new = [(F.when(met, to[c]).otherwise(F.col(f"`{c}`")) if c in to else F.col(f"`{c}`")).alias(c) for c in rows.columns]
        pairs = joined.where(met).select(*(F.col(f"`{c}`").alias(f"o_{c}") for c in rows.columns), *(e.alias(f"n_{c}") for c, e in zip(rows.columns, new, strict=True)))
        changes[child] = joined.select(*new)
        self._updated(child, pairs, set(to), changes)

    def _check_others(self, name: str, changes: dict) -> None:
        for child, df in changes.items():
            if child != name:
                self._check(child, self._manifest(child), df, changes=changes)

    def _check(self, name: str, m: dict, every: DataFrame, new: DataFrame | None = None, only_unique: bool = False, changes: dict | None = None) -> None:
        """Raises where a constraint fails; row checks look at new rows only where these are known."""
        c = m["constraints"]
        rows = every if new is None else new
        if not only_unique:
            bad = F.lit(None).cast("string")
            for col in c["not_null"]:
                bad = F.coalesce(bad, F.when(F.col(col).isNull(), F.lit(f'null value in column "{col}"')))
            for check in c["checks"]:
                bad = F.coalesce(bad, F.when(~F.expr(fe.rewrite(check)), F.lit(f"check constraint fails: {check}")))
            if first := rows.select(bad.alias("bad")).where("bad IS NOT NULL").first():
                raise ConstraintError(first["bad"])
            for fk in c["fks"]:
                parent = (every if fk["parent"] == name else changes[fk["parent"]] if changes and fk["parent"] in changes else self.table(fk["parent"])).select(*(F.col(r).alias(f"__{r}") for r in fk["refs"]))
                some = rows.where(" AND ".join(f"`{x}` IS NOT NULL" for x in fk["cols"]))
                if some.join(parent, [F.col(a) == F.col(f"__{b}") for a, b in zip(fk["cols"], fk["refs"], strict=True)], "left_anti").limit(1).count():
                    raise ConstraintError(f'no such key in "{fk["parent"]}"')
        for cols in c["unique"]:
            keyed = every.where(" AND ".join(f"`{x}` IS NOT NULL" for x in cols))
            if keyed.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
                raise ConstraintError(f"duplicate key: {', '.join(cols)}")

    # transactions
    def _do_begin(self, toks):
        if self.overlay is not None:
            raise fe.SqlError("already in a transaction")
        self.overlay, self.ddl, self.base = {}, {}, {}
        return Result("BEGIN")

    def _do_commit(self, toks):
        changes, ddl, self.overlay, self.ddl = self.overlay or {}, self.ddl, None, {}
        self._publish(changes, ddl)
        return Result("COMMIT")

    def _do_rollback(self, toks):
        if len(toks) > 1 and toks[1].upper() == "TO":
            raise fe.SqlError("SAVEPOINT is not supported")
        self.overlay, self.ddl = None, {}
        self.catalog.unlock(self)
        return Result("ROLLBACK")

    # utility
    def _do_show(self, toks):
        what = toks[1].upper()
        if what == "TABLES":
            return Result("SHOW", self.spark.createDataFrame([(t,) for t in self._tables()], "table_name string"))
        name = _name(toks[-1])
        m = self._manifest(name)
        if what == "COLUMNS":
            rows = [(f.name, m["constraints"]["kinds"].get(f.name, f.dataType.simpleString()), f.name not in m["constraints"]["not_null"]) for f in StructType.fromJson(m["schema"])]
            return Result("SHOW", self.spark.createDataFrame(rows, "column_name string, data_type string, is_nullable boolean"))
        if what in ("INDEX", "INDEXES"):
            return Result("SHOW", self.spark.createDataFrame([(n, ",".join(x["columns"]), x["method"], x["unique"]) for n, x in m["indexes"].items()], "index_name string, columns string, method string, is_unique boolean"))
        if what == "STATS":
            return Result("SHOW", self.statistics(name))
        raise fe.SqlError(f"SHOW {what} is not supported")

    def statistics(self, name: str) -> DataFrame:
        """column_name, n, ndv, nulls, lo, hi in one pass."""
        df = self.table(name)
        plain = [f.name for f in df.schema if not isinstance(f.dataType, ArrayType | BinaryType)]
        one = df.agg(F.count("*").alias("n"), *(x for c in plain for x in (F.approx_count_distinct(c, 0.0081).alias(f"ndv_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}"))))
        return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"ndv_{c}").alias("ndv"), F.col(f"nulls_{c}").alias("nulls"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in plain))).alias("s")).select("s.*")

    def _do_analyze(self, toks):
        return Result("ANALYZE", self.statistics(_name(toks[-1])))

    def _do_explain(self, toks):
        rest = toks[1:]
        while rest and rest[0].upper() in ("ANALYZE", "VERBOSE"):
            rest = rest[1:]
        sql = " ".join(rest)
        df = self._select(sql)
        plan = df._jdf.queryExecution().toString()
        keys = [c for n in self._frames(sql) for c in self._manifest(n)["constraints"].get("primary") or []]
        return Result("EXPLAIN", self.spark.createDataFrame([(f"workload: {fe.workload(sql)}",), (f"path: {scan_path(rest, keys)}",), *((x,) for x in plan.split("\n"))], "plan string"))

    def _do_vacuum(self, toks):
        n = sum(self.catalog.expire(t) for t in ([_name(toks[1])] if len(toks) > 1 else self._tables()))
        return Result(f"VACUUM {n}")

    _do_checkpoint = _do_vacuum

    def _do_copy(self, toks, data=None):
        """COPY t FROM|TO 'path' [csv|jsonl|parquet], or FROM STDIN with the lines given to execute; exports stay under the catalogue's root."""
        name, up = _name(toks[1]), [t.upper() for t in toks]
        if up[2] == "TO":
            path = fe.text_of(toks[3])
            copying.copy_to(self.table(name), path, "parquet", root=self.catalog.root)
            return Result("COPY")
        m = self._manifest(name)
        schema = StructType.fromJson(m["schema"])
        if toks[3].upper() == "STDIN":
            if data is None:
                raise fe.SqlError("COPY .. FROM STDIN needs data")
            new = copying.copy_from_stdin(self.spark, data, schema)
            return Result(f"COPY {self._add(name, m, new, new.columns)}")
        path = fe.text_of(toks[3])
        form = next((x for x in ("CSV", "JSONL", "PARQUET") if x in up[4:]), path.rsplit(".", 1)[-1].upper())
        read = {"CSV": lambda: copying.copy_from_csv(self.spark, path, schema), "JSONL": lambda: copying.copy_from_jsonl(self.spark, path, schema), "PARQUET": lambda: copying.copy_from_parquet(self.spark, path)}[form]
        new = read()
        # A column that the file doesn't have gets its default or its next number.
        has = [f.name for f in schema if f.name in new.columns and (form == "PARQUET" or f.name in self._header(path, form, schema))]
        return Result(f"COPY {self._add(name, m, new.select(*(f'`{c}`' for c in has)), has)}")

    def _header(self, path: str, form: str, schema: StructType) -> set[str]:
        """The columns that a text file names."""
        if form == "CSV":
            return set(self.spark.read.option("header", True).csv(path).columns)
        return set(self.spark.read.json(path).columns)
