"""Import of plain-text dumps: CREATE TABLE, COPY .. FROM stdin and INSERT; other statements are passed over."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql.types import StructType

from ..frontend import statements
from ..session import Session
from .copying import copy_from_stdin

#: Type names of dumps and what they become.
TYPES = {
    "character varying": "TEXT", "character": "TEXT", "timestamp without time zone": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP", "double precision": "DOUBLE", "smallint": "BIGINT", "integer": "BIGINT", "numeric": "NUMERIC",
    "bytea": "BYTEA", "boolean": "BOOLEAN", "bigint": "BIGINT", "real": "REAL", "uuid": "UUID", "jsonb": "JSONB", "json": "JSON", "text": "TEXT", "date": "DATE",
}


@dataclass
class Report:
    tables: list[str] = field(default_factory=list)
    rows: int = 0
    skipped: int = 0


def translate(create: str) -> str:
    """A dump's CREATE TABLE in the session's dialect."""
    out = re.sub(r"\bpublic\.", "", create)
    for name in sorted(TYPES, key=len, reverse=True):
        out = re.sub(rf"\b{name}\b(\(\d+\))?", TYPES[name], out, flags=re.I)
    out = re.sub(r"DEFAULT nextval\([^)]*\)", "", out, flags=re.I)
    return re.sub(r"('(?:[^']|'')*')::[A-Za-z ]+", r"\1", out)


def import_dump(session: Session, script: str) -> Report:
    report = Report()
    # COPY blocks are data, not statements: they are cut out first.
    parts = re.split(r"(?mi)^(COPY\s+[^;]+FROM\s+stdin[^;]*;)\n(.*?)^\\\.$", script, flags=re.S)
    for k in range(0, len(parts), 3):
        text = re.sub(r"(?m)^(--|\\|SET |SELECT pg_catalog).*$", "", parts[k])
        for statement in statements(text):
            head = " ".join(statement.split()[:2]).upper()
            if head == "CREATE TABLE":
                session.execute(translate(statement))
                report.tables.append(re.match(r"(?i)create table (?:public\.)?\"?(\w+)", statement)[1])
            elif head == "INSERT INTO":
                tag = session.execute(re.sub(r"\bpublic\.", "", statement, count=1)).tag
                report.rows += int(tag.split()[-1])
            else:
                report.skipped += 1
        if k + 2 < len(parts):
            m = re.match(r"(?i)copy\s+(?:public\.)?\"?(\w+)\"?\s*(?:\(([^)]*)\))?", parts[k + 1])
            report.rows += _copy(session, m[1].lower(), m[2], parts[k + 2])
    return report


def _copy(session: Session, name: str, columns: str | None, data: str) -> int:
    m = session._manifest(name)
    schema = StructType.fromJson(m["schema"])
    cols = [c.strip().strip('"') for c in columns.split(",")] if columns else schema.names
    lines = [x for x in data.split("\n") if x != ""]
    got = copy_from_stdin(session.spark, lines, StructType([schema[c] for c in cols]))
    session._add(name, m, got, cols)
    return len(lines)
