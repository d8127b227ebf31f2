"""What the services' queries don't reach: refusals, odd rows and advice."""

import pytest

from lumenq.frontend import SqlError, tokens
from lumenq.operators import routing as R
from lumenq.operators import search as S
from lumenq.operators import sketches as K
from lumenq.session import Session
from lumenq.sources.rows import json_rows
from lumenq.streaming import log as L


def test_gate():
    R.vector_gate("Recommend")
    R.vector_gate(None, strict=False)
    R.vector_gate(None, allow_join=True)
    R.vector_gate("", suggestions_only=False)
    for purpose in (None, "", "report"):
        with pytest.raises(R.PolicyError):
            R.vector_gate(purpose)


@pytest.mark.parametrize(
    ("sql", "path"),
    [
        ("SELECT a FROM t WHERE id = 4", "IndexPoint"), ("SELECT a FROM t WHERE a = 4", "RowScan"), ("SELECT id FROM t", "RowScan"), ("SELECT a FROM t WHERE id > 4", "RowScan"),
        ("SELECT a FROM t WHERE a BETWEEN 1 AND 2", "ColumnScan"), ("SELECT id FROM t ORDER BY v <-> '[1]' LIMIT 2", "VectorHnsw"), ("SELECT a FROM t WHERE a @@ 'x'", "FtsInverted"),
    ],
)
def test_paths(sql, path):
    assert R.scan_path(tokens(sql), ["id"]) == path


def test_ring(spark):
    one = R.HashRing(["only"])
    assert one.owners(5, 3) == ["only"]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            R.HashRing(bad)
    ring = R.HashRing(["a", "b", "c"], points=16, slots=64)
    df = spark.createDataFrame([(None,), ("",), *((f"k{i}",) for i in range(200))], "k string")
    rows = df.select(ring.slot(df.k).alias("slot"), ring.replicas(df.k, 2).alias("r")).collect()
    assert all(list(r["r"]) == ring.owners(r["slot"], 2) for r in rows)


def test_advice():
    asked = ["SELECT a FROM t WHERE b = 1 AND c > 2", "SELECT a FROM t WHERE b IN (1, 2)", "SELECT a FROM t WHERE note = 'c = 1'", "DELETE FROM t WHERE data @> '{}'", "SELECT 1 FROM t WHERE data @> '{\"x\":1}'", "SELECT b FROM u WHERE b = 2"]
    tables = {"t": ["a", "b", "c", "data", "note"], "u": ["b"]}
    assert R.advise(asked, tables) == [("t", "b", "btree", 2), ("t", "data", "gin", 2)]
    assert R.advise([], tables) == [] and R.advise(asked, {}) == []


def test_json_rows(spark):
    schema = spark.createDataFrame([], "id long, name string").schema
    df = spark.createDataFrame([('[{"id":1,"name":"a"},{"id":2}]',), (" [] ",), ("",), (None,)], "body string")
    assert sorted(map(tuple, json_rows(df, "body", schema).collect()), key=str) == [(1, "a"), (2, None)]
    for bad in ('{"id":1}', "[{]", "x"):
        with pytest.raises(Exception):  # noqa: B017  the fault comes from the executors
            json_rows(spark.createDataFrame([(bad,)], "body string"), "body", schema).collect()


def test_reindex_and_json_paths(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None)], "doc_id long, text string")
    index = S.postings(docs)
    both = S.reindex(index, spark.createDataFrame([(2, "green"), (4, "red")], docs.schema), spark.createDataFrame([(1,), (4,)], "doc_id long"))
    assert sorted((r["term"], r["id"], r["tf"]) for r in both.collect()) == [("green", 2, 1)]
    assert sorted(map(str, S.reindex(index, docs.limit(0)).collect())) == sorted(map(str, index.collect()))
    rows = spark.createDataFrame([(1, '{"a":{"b":7}}'), (2, '{"a":{"b":"7"}}'), (3, '{"a":1}'), (4, None)], "id long, j string")
    held = S.json_path_index(rows, "id", "j", "a", "b")
    assert sorted(r["id"] for r in held.collect()) == [1, 2]
    assert sorted(r["id"] for r in S.json_path_lookup(rows, held, "id", "j", "7", "a", "b").collect()) == [1, 2]
    # An index that is behind the rows adds none that don't hold the value.
    moved = rows.where("id > 1").unionByName(spark.createDataFrame([(1, '{"a":{"b":8}}')], rows.schema))
    assert [r["id"] for r in S.json_path_lookup(moved, held, "id", "j", "7", "a", "b").collect()] == [2]


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "x long")
    assert tuple(K.bitmap_sizes(K.bitmap(none, "x"), K.bitmap(none, "x")).first()) == (0, 0, 0, 0)
    assert K.count_min_top(K.count_min(none, "x"), none, "x", 3).count() == 0
    some = spark.createDataFrame([(1,), (2,), (70000,)], "x long")
    assert tuple(K.bitmap_sizes(K.bitmap(some, "x"), K.bitmap(some.where("x > 1"), "x")).first()) == (2, 3, 1, 1)


def test_likev(spark, tmp_path):
    db = Session(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE v (id INT PRIMARY KEY, e VECTOR(2))")
    db.execute("INSERT INTO v VALUES (1, '[0, 1]'), (2, '[3, 0]'), (3, NULL)")
    assert [r["id"] for r in db.sql("LIKEV VEC [3, 0.5] IN v TOP 5").collect()] == [2, 1]
    db.execute("CREATE TABLE w (id INT)")
    for bad in ("LIKEV VEC [1] IN v", "LIKEV VEC [1] IN w TOP 2"):
        with pytest.raises(SqlError):
            db.sql(bad)


def test_running_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(None, 1.0), ("a", None), ("a", 4.0), ("a", 2.0)], "k string, v double").repartition(2).write.parquet(src)
    stream = L.running(spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(src), "k", "v")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for r in sorted(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect(), key=lambda r: r["n"]):
        last[r["k"]] = (r["n"], r["top"])
    assert last == {None: (1, 1.0), "a": (3, 4.0)}
