from lumenq.operators.search import pq_knn, product_quantize, trigram_like, trigram_postings, update_weight
from lumenq.operators.sketches import between_selectivity
from lumenq.streaming import log as L


def test_log_is_applied_once(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    good = [L.log_line(i, f"stmt {i}") for i in (1, 2, 2, 3)]
    (src / "a.log").write_text("\n".join([*good, "4\t00000000\tbroken", "x\ty"]) + "\n")
    seen = []
    a = L.Applier(spark, str(tmp_path / "state"), lambda lsn, text: seen.append((lsn, text)))
    a.start(L.read_log(spark, str(src)), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [(1, "stmt 1"), (2, "stmt 2"), (3, "stmt 3")] and a.high_water == 3
    (src / "b.log").write_text("\n".join([good[0], L.log_line(5, "stmt 5")]) + "\n")
    a.start(L.read_log(spark, str(src)), str(tmp_path / "cp2")).awaitTermination(60)  # a replay from the start
    assert seen[3:] == [(5, "stmt 5")]


def test_upsert_and_replay(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    c = spark.createDataFrame([(10, "update", 1, "x"), (11, "delete", 2, None), (12, "insert", 3, "c"), (13, "update", 1, "y")], "lsn long, op string, k long, v string")
    assert sorted(map(tuple, L.upsert(t, c, "k").collect())) == [(1, "y"), (3, "c")]
    assert sorted((r["k"], r["v"]) for r in L.replay(c, "k", 12).collect()) == [(1, "x"), (3, "c")]


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "e"))
    stream = L.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "1 hour", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, L.tumbling(events, "ts", "1 hour", "event_type").collect()))


def test_small_parts(spark):
    assert update_weight(0.5, [1, 1, -1, 100]) == 0.95 and update_weight(0.5, [-100]) == 0.05
    assert between_selectivity([(1, 10), (2, 10)], 0, 2, 0, 1, 2) == 0.5
    docs = spark.createDataFrame([(1, "Hello World"), (2, "hello"), (3, None)], "doc_id long, text string")
    assert [r[0] for r in trigram_like(docs, "World", index=trigram_postings(docs)).select("doc_id").collect()] == [1]
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 0.0, 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    codes, books = product_quantize(v, 2, 8)
    assert pq_knn(v, codes, books, [0.0, 0.0, 0.0, 1.0], 1).first()["id"] == 0
