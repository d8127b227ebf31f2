"""Operator rules that the catalogue's data don't show: nulls, ties, empty groups."""

from pyspark.sql import functions as F

from lumenq.functions import json as J
from lumenq.functions import text as T
from lumenq.functions import vector as V
from lumenq.operators import search as S
from lumenq.operators import sketches as K


def one(df):
    return df.first()[0]


def test_aggregates_skip_nulls(spark):
    df = spark.createDataFrame([("a", 10), ("a", None), ("a", 20), ("b", None)], "k string, v int")
    got = {r["k"]: (r["a"], r["c"], r["s"]) for r in df.groupBy("k").agg(F.avg("v").alias("a"), F.count("v").alias("c"), F.sum("v").alias("s")).collect()}
    assert got == {"a": (15.0, 2, 30), "b": (None, 0, None)}


def test_null_keys_do_not_join(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    assert a.join(a.withColumnRenamed("k", "j"), F.col("k") == F.col("j")).count() == 1


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    got = df.select(V.l2(F.col("a"), F.col("b")).alias("d"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.negative_inner_product(F.col("a"), F.col("b")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.0), (0.0, 0.0, -25.0)]
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "vec_id int, embedding array<double>")
    assert S.knn(v, [0.9, 0.1, 0.0], 1).first()["id"] == 1


def test_bm25_counts_query_terms_and_breaks_ties_by_id(spark):
    d = spark.createDataFrame([(2, "cat dog"), (1, "dog cat"), (3, "bird bird"), (4, None)], "doc_id int, text string")
    assert [r["id"] for r in S.top(S.bm25(d, "cat"), 5).collect()] == [1, 2]
    once, twice = (S.bm25(d, q).where("id = 1").first()["score"] for q in ("cat", "cat cat"))
    assert abs(twice - 2 * once) < 1e-12 and S.bm25(d, "!").count() == 0


def test_fusion(spark):
    lex = spark.createDataFrame([(1, 3.0), (2, 2.0), (9, float("nan"))], "id int, score double")
    vec = spark.createDataFrame([(2, 0.1), (3, 0.2)], "id int, dist double")
    assert [r["id"] for r in S.top(S.rrf(lex, vec), 3).collect()] == [2, 1, 3]
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, score double")
    assert {r["id"]: r["score"] for r in S.weighted(same, vec, 0.5).collect()}[1] == 0.5
    assert {r["id"]: r["score"] for r in S.dbsf(same, vec).collect()}[1] == 0.0


def test_json(spark):
    df = spark.createDataFrame([('{"a": null, "n": 1.0, "t": true, "o": {"x": "1"}}',), ("[1,2]",), (None,)], "j string")
    j = F.col("j")
    got = df.select(J.has_key(j, "a").alias("k"), J.get_text(j, "a").alias("a"), J.contains(j, '{"n":1.0}').alias("n"), J.contains(j, '{"n":1}').alias("m"), J.contains(j, '{"o":{"x":1}}').alias("o"), J.contains(j, '{"t":true}').alias("t"), J.array_length(j).alias("l")).collect()
    assert tuple(got[0]) == (True, None, True, False, False, True, None) and tuple(got[1])[-1] == 2
    assert J.canonical_text('{"b":2, "a":{"z":1.0,"y":[1, "é"]}, "b":3}') == '{"a":{"y":[1,"é"],"z":1.0},"b":3}'


def test_text(spark):
    df = spark.createDataFrame([("Ab",), ("",), (None,), ("x-y é 42!",)], "t string")
    assert [r[0] for r in df.select(T.tokenise(F.col("t"))).collect()] == [["ab"], [], None, ["é", "42"]]
    assert one(df.limit(1).select(T.trigrams(F.col("t")))) == ["  a", " ab", "ab "]
    assert T.expand_terms(["a", "b"], T.synonym_map([["a", "c", "b"]], {"b": ["z"]})) == ["a", "b", "c", "z"]


def test_sketches_merge(spark):
    a, b = spark.range(0, 3000).withColumn("g", F.lit(1)), spark.range(1000, 4000).withColumn("g", F.lit(2))
    merged = one(K.hll_merge(K.hll(a, "id").union(K.hll(b, "id"))))
    assert abs(merged - 4000) < 200
    both = K.count_min(a, "id").union(K.count_min(b, "id")).groupBy("depth", "cell").agg(F.sum("n").alias("n"))
    est = {r["value"]: r["estimate"] for r in K.count_min_estimate(both, spark.range(1500, 1600), "id").collect()}
    assert all(v >= 2 for v in est.values())
    assert K.histogram(a.limit(0), "id").count() == 0
