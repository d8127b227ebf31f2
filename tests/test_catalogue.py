"""Every catalogue query against its SQL, at the smallest scale; and the driver contract without the llm folders."""

import datetime
import glob
import math
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lumenq.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_approximate_search_finds_nearly_all(spark):
    from lumenq.operators import search as S

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    codes, books = S.product_quantize(vectors)
    assert len(books) == 8 and max(map(len, books)) <= 256 and codes.count() == vectors.count()
    query = [float(x) for x in vectors.where("vec_id = 3").first()["embedding"]]
    exact = [r["id"] for r in S.knn(vectors, query, 10).collect()]
    for got in (S.pq_knn(vectors, codes, books, query, 10), S.lsh_knn(vectors, query, 10)):
        assert len(set(exact) & {r["id"] for r in got.collect()}) >= 9


def test_texts_are_tokenised_once(spark):
    plan = QUERIES["bm25_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # once in each reading of the table: lengths and counts of all, scores of those that hold a term


def test_topn_plan_is_bounded(spark):
    assert "TakeOrderedAndProject" in QUERIES["topn"](spark, SF)._jdf.queryExecution().toString()
    scan = QUERIES["scan_project"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in scan
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in QUERIES["point_lookup"](spark, SF)._jdf.queryExecution().toString()


def test_entry_imports_without_llm(tmp_path):
    """What the driver does: the llm folders and the pipeline are gone."""
    for x in ("__spark_entry__.py", "bench.py"):
        (tmp_path / x).write_text((ROOT / x).read_text())
    os.makedirs(tmp_path / "lumenq")
    for x in (ROOT / "lumenq").iterdir():
        if x.name not in ("llm", "__pycache__"):
            os.symlink(x, tmp_path / "lumenq" / x.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_nothing_outside_llm_imports_it():
    for f in (ROOT / "lumenq").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:  # the subpackage itself
            assert not re.search(r"\bllm\b", f.read_text()), f
