"""Full and differential backups of a catalogue, with checks.

A backup is a folder: a Parquet copy of each table (or of what changed since a base) and a manifest with row
counts and an order-free checksum of the rows, by which it can be verified without the source.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, CatalogError, diff_backup


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and the exclusive or and sum of their hashes (complex values by their text)."""
    cols = [F.col(f"`{c}`").cast("string") for c in df.columns]
    h = F.xxhash64(*(F.coalesce(c, F.lit("\0")) for c in cols))
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return r["n"], f"{r['x'] or 0}:{r['s'] or 0}"


def backup(catalog: Catalog, to: str, base: str | None = None) -> dict:
    """Writes a backup; with base (another backup's folder) only rows that are new and rows that are gone, where the catalogue still has the base's version with the same columns, and whole tables otherwise."""
    known = json.loads(catalog.files.read(f"{base}/backup.json") or "{}") if base else {}
    out = {"time": time.time(), "base": base, "tables": {}}
    for name in catalog.tables():
        m = catalog.manifest(name)
        lsn = m["versions"][-1]["lsn"]
        then = known.get("tables", {}).get(name)
        changed = diff_backup(catalog, name, then["lsn"]) if then else None
        info = {"lsn": lsn, "manifest": {k: m[k] for k in ("schema", "constraints", "indexes")}}
        if changed:
            new, gone = changed
            new.write.parquet(f"{to}/{name}/new")
            gone.write.parquet(f"{to}/{name}/gone")
            info["parts"] = {p: checksum(catalog.spark.read.parquet(f"{to}/{name}/{p}")) for p in ("new", "gone")}
        else:
            catalog.read(name).write.parquet(f"{to}/{name}/full")
            info["parts"] = {"full": checksum(catalog.spark.read.parquet(f"{to}/{name}/full"))}
        out["tables"][name] = info
    catalog.files.write(f"{to}/backup.json", json.dumps(out))
    return out


def verify(catalog: Catalog, at: str) -> list[str]:
    """What is wrong with a backup; empty if nothing."""
    text = catalog.files.read(f"{at}/backup.json")
    if text is None:
        return ["no manifest"]
    out = []
    for name, info in json.loads(text)["tables"].items():
        for part, want in info["parts"].items():
            try:
                got = checksum(catalog.spark.read.parquet(f"{at}/{name}/{part}"))
            except Exception as e:  # noqa: BLE001  any failure to read is what is looked for
                out.append(f"{name}/{part}: {type(e).__name__}")
                continue
            if list(got) != list(want):
                out.append(f"{name}/{part}: {got} instead of {tuple(want)}")
    return out


def restore(catalog: Catalog, chain: list[str]) -> list[str]:
    """Restores a full backup and the differential ones upon it, in order, into tables that don't exist yet."""
    from pyspark.sql.types import StructType

    rows: dict[str, DataFrame] = {}
    info: dict = {}
    for at in chain:
        if bad := verify(catalog, at):
            raise CatalogError("; ".join(bad))
        info = json.loads(catalog.files.read(f"{at}/backup.json"))["tables"]
        read = catalog.spark.read.parquet
        rows = {n: rows[n].exceptAll(read(f"{at}/{n}/gone")).unionByName(read(f"{at}/{n}/new")) if "new" in t["parts"] else read(f"{at}/{n}/full") for n, t in info.items()}
    for name, df in rows.items():
        m = info[name]["manifest"]
        catalog.create(name, StructType.fromJson(m["schema"]), m["constraints"])
        catalog.put(name, catalog.manifest(name) | {"indexes": m["indexes"]})
        catalog.commit(name, df)
    return sorted(rows)


def predict(catalog: Catalog, sample_rows: int = 256) -> dict[str, int]:
    """A guess of each table's size in bytes of text, from a sample of its rows."""
    out = {}
    for name in catalog.tables():
        df = catalog.read(name)
        width = df.limit(sample_rows).agg(F.avg(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
        out[name] = int(width * df.count())
    return out
