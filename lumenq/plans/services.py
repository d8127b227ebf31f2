"""Queries of what stands around a SELECT: statements, copies, dumps, backups, log shipping, procedures, sketches' merges and routing.

Each runs the operator over a session or folder of its own and returns what is left there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import routing as R
from ..operators import search as S
from ..operators import sketches as K
from ..streaming import log as L
from .base import database, query, table

_REGION = "r_regionkey INT PRIMARY KEY, r_name TEXT NOT NULL"
_NATION = "n_nationkey INT PRIMARY KEY, n_name TEXT UNIQUE, n_regionkey INT"
_ALL_REGIONS = "SELECT r_regionkey, r_name FROM region"


def _regions(db, name: str = "region"):
    return db.sql(f"SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM {name}")


def _lines(df) -> list[str]:
    """A few rows as lines of the text protocol."""
    return ["\t".join(r) for r in df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns)).toLocalIterator()]


# sources and sinks
@query("copy_stdin", _ALL_REGIONS)
def _stdin(spark, d):
    db = database(spark, d)
    db.execute(f"CREATE TABLE region ({_REGION})")
    db.execute("COPY region FROM STDIN", data=[*_lines(table(spark, d, "region").select("r_regionkey", "r_name")), "\\."])
    return _regions(db)


@query("dump_import", _ALL_REGIONS + " UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def _dump(spark, d):
    """A dump with a COPY block and INSERTs (those that dump_sql writes), read back."""
    from ..sources.copying import dump_sql
    from ..sources.pgdump import import_dump

    r = table(spark, d, "region").select("r_regionkey", "r_name")
    inserts = [x["sql"] for x in dump_sql(r.withColumn("r_regionkey", F.col("r_regionkey") + 100), "region").toLocalIterator()]
    head = "SET statement_timeout = 0;\nCREATE TABLE public.region (\n    r_regionkey integer NOT NULL,\n    r_name character varying(25)\n);\nCOPY public.region (r_regionkey, r_name) FROM stdin;"
    db = database(spark, d)
    import_dump(db, "\n".join([head, *_lines(r), "\\.", "", *inserts, ""]))
    return _regions(db)


@query("backup_restore", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def _backup(spark, d):
    """A full backup, a differential one after a DELETE, both restored elsewhere."""
    from ..sources import backup as B
    from ..sources.copying import scratch

    db, other = database(spark, d, nation=_NATION), database(spark, d)
    full, diff = scratch(spark, "full"), scratch(spark, "diff")
    B.backup(db.catalog, full)
    db.execute("DELETE FROM nation WHERE n_regionkey = 2")
    B.backup(db.catalog, diff, full)
    B.restore(other.catalog, [full, diff])
    return other.sql("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation")


@query("json_rows", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _json_rows(spark, d):
    """Arrays of up to a hundred objects, taken apart again."""
    from ..sources.rows import json_rows

    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    packed = c.groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).cast("binary").alias("body"))
    return json_rows(packed, "body", c.schema)


@query("columnar_export", "SELECT n_nationkey, n_name FROM nation")
def _columnar(spark, d):
    got = database(spark, d, nation=_NATION).to_arrow("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation")
    return spark.createDataFrame(got)


# statements
@query("drop_and_create", "SELECT 'nation' AS table_name")
def _drop(spark, d):
    db = database(spark, d, region=_REGION, nation=_NATION)
    for statement in ("DROP TABLE region", "DROP TABLE IF EXISTS region", "BEGIN", "DROP TABLE nation", "ROLLBACK"):
        db.execute(statement)
    return db.sql("SHOW TABLES")


@query("show_columns", "SELECT * FROM (VALUES ('n_nationkey', false), ('n_name', true), ('n_regionkey', true)) t (column_name, is_nullable)")
def _show(spark, d):
    return database(spark, d, nation=_NATION).sql("SHOW COLUMNS FROM nation").select("column_name", "is_nullable")


@query("show_stats", "SELECT 'n_name' AS column_name, count(*) AS n, count(DISTINCT n_name) AS ndv, min(n_name) AS lo, max(n_name) AS hi FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(DISTINCT n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation")
def _stats(spark, d):
    return database(spark, d, nation=_NATION).sql("SHOW STATS FROM nation").where("column_name <> 'n_nationkey'").select("column_name", "n", "ndv", "lo", "hi")


def _refused(db, *statements: str) -> list[bool]:
    from ..session import ConstraintError

    out = []
    for statement in statements:
        try:
            db.execute(statement)
            out.append(False)
        except ConstraintError:
            out.append(True)
    return out


@query("constraints", "SELECT s_suppkey, true AS all_refused FROM supplier UNION ALL SELECT -1, true")
def _constraints(spark, d):
    """A row that breaks a CHECK, NOT NULL, UNIQUE or primary key is refused and leaves nothing; a null passes a CHECK."""
    db = database(spark, d, supplier="s_suppkey BIGINT PRIMARY KEY, s_name TEXT NOT NULL UNIQUE, s_nationkey INT CHECK (s_nationkey >= 0)")
    one = table(spark, d, "supplier").select("s_suppkey", "s_name").first()
    bad = _refused(db, "INSERT INTO supplier VALUES (-2, 'x', -1)", "INSERT INTO supplier VALUES (-2, NULL, 1)", f"INSERT INTO supplier VALUES (-2, '{one['s_name']}', 1)", f"INSERT INTO supplier VALUES ({one['s_suppkey']}, 'x', 1)", "UPDATE supplier SET s_nationkey = -1")
    db.execute("INSERT INTO supplier VALUES (-1, 'nobody', NULL)")
    return db.sql("SELECT s_suppkey FROM supplier").withColumn("all_refused", F.lit(all(bad)))


@query("unique_index", "SELECT 'by_name' AS index_name, 'n_name' AS columns, true AS is_unique, true AS refused")
def _index(spark, d):
    db = database(spark, d, nation="n_nationkey INT, n_name TEXT, n_regionkey INT")
    for statement in ("CREATE UNIQUE INDEX by_name ON nation (n_name)", "CREATE INDEX by_region ON nation (n_regionkey)", "DROP INDEX by_region"):
        db.execute(statement)
    refused = _refused(db, "INSERT INTO nation SELECT n_nationkey + 100, n_name, 0 FROM nation")
    return db.sql("SHOW INDEX FROM nation").select("index_name", "columns", "is_unique").withColumn("refused", F.lit(refused[0]))


@query("write_conflict", _ALL_REGIONS + " WHERE r_regionkey <> 0")
def _conflict(spark, d):
    """Two sessions write one table; the one that commits later is turned away and its rows are not seen."""
    from ..catalog import ConflictError
    from ..session import Session

    db = database(spark, d, region=_REGION)
    late = Session(spark, db.catalog.root)
    late.execute("BEGIN")
    late.execute("INSERT INTO region VALUES (50, 'LATE')")
    db.execute("DELETE FROM region WHERE r_regionkey = 0")
    try:
        late.execute("COMMIT")
    except ConflictError:
        return _regions(db)
    raise AssertionError("the later commit must fail")


@query("vacuum", _ALL_REGIONS.replace("r_name", "'x' AS r_name") + " UNION ALL SELECT 1000, 'VACUUM 3'")
def _vacuum(spark, d):
    """Old versions go, the last stays."""
    db = database(spark, d, region=_REGION)
    for name in ("y", "x"):
        db.execute(f"UPDATE region SET r_name = '{name}'")
    return _regions(db).union(spark.createDataFrame([(1000, db.execute("VACUUM region").tag)], "r_regionkey int, r_name string"))


@query("schema_diff", "SELECT * FROM (VALUES ('ALTER TABLE nation ADD COLUMN extra STRING'), ('ALTER TABLE nation DROP COLUMN n_comment'), ('ALTER TABLE nation ALTER COLUMN n_regionkey TYPE BIGINT')) t (change)")
def _schema_diff(spark, d):
    from ..catalog import schema_diff

    old = table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int"), F.lit("").alias("n_comment")).schema
    new = table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("long"), F.lit("").alias("extra")).schema
    return spark.createDataFrame([(x,) for x in schema_diff(old, new, "nation")], "change string")


@query("explain_labels", "SELECT * FROM (VALUES ('oltp', 'IndexPoint'), ('analytics', 'ColumnScan'), ('search', 'FtsInverted'), ('oltp', 'RowScan')) t (workload, path)")
def _explain(spark, d):
    db = database(spark, d, nation=_NATION)
    asked = ("SELECT n_name FROM nation WHERE n_nationkey = 3", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_name FROM nation WHERE n_name @@ 'peru'", "SELECT n_name FROM nation WHERE n_regionkey = 3")
    plans = [[r["plan"] for r in db.sql(f"EXPLAIN {sql}").limit(2).collect()] for sql in asked]  # two label rows each
    return spark.createDataFrame([tuple(x.split(": ")[1] for x in p) for p in plans], "workload string, path string")


# the dialect
@query("jsonb_chain", "SELECT event_id, CAST(event_id % 7 AS VARCHAR) AS second FROM events WHERE json_extract_string(props, '$.k') = '5'")
def _chain(spark, d):
    """-> binds before ->>, and both before =."""
    db = database(spark, d)
    db.execute("CREATE TABLE e (event_id BIGINT, data JSONB)")
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"list":[0,'), F.col("event_id") % 7, F.lit('],"props":'), "props", F.lit("}")).alias("data"))
    e.createOrReplaceTempView("lumenq_chain_source")
    db.execute("INSERT INTO e SELECT event_id, data FROM lumenq_chain_source")
    return db.sql("SELECT event_id, data -> 'list' ->> 1 AS second FROM e WHERE data -> 'props' ->> 'k' = '5' AND data ? 'list'")


def _vectors(spark, d):
    db = database(spark, d)
    db.execute("CREATE TABLE v (vec_id BIGINT PRIMARY KEY, note TEXT, embedding VECTOR(64))")
    e = table(spark, d, "embeddings")
    db.catalog.commit("v", e.select("vec_id", F.concat(F.lit("row "), "vec_id").alias("note"), "embedding"))
    first = e.where("vec_id = 0").first()["embedding"]
    return db, "[" + ", ".join(repr(float(x)) for x in first) + "]"


_NEAR = "SELECT vec_id FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 7"


@query("vector_literal", "SELECT vec_id, CAST(len(embedding) AS INT) AS dim, true AS same FROM embeddings")
def _literal(spark, d):
    """Vectors written as text and parsed again."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    text = F.concat(F.lit("["), F.array_join(F.col("v").cast("array<string>"), ", "), F.lit("]"))
    back = V.parse(text)
    return e.select("vec_id", F.size(back).alias("dim"), (back.cast("array<double>") == F.col("v")).alias("same"))


@query("knn_statement", _NEAR)
def _knn_statement(spark, d):
    db, q = _vectors(spark, d)
    return db.sql(f"SELECT vec_id FROM v ORDER BY embedding <-> '{q}', vec_id LIMIT 7")


@query("likev_top", _NEAR)
def _likev(spark, d):
    db, q = _vectors(spark, d)
    return db.sql(f"LIKEV VEC {q} IN v TOP 7").select("vec_id")


@query("match_top", "SELECT doc_id FROM documents WHERE lang = 'en' AND list_has_any(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['license'])")
def _match(spark, d):
    """A condition beside MATCH; the report is longer than what matches."""
    db = database(spark, d)
    db.execute("CREATE TABLE documents (doc_id BIGINT, lang TEXT, text TEXT)")
    db.catalog.commit("documents", table(spark, d, "documents").select("doc_id", "lang", "text"))
    return db.sql("SELECT doc_id FROM documents WHERE lang = 'en' AND text MATCH 'license' TOP 100000000")


# sketches
@query("sketch_merge_cdf", "SELECT true AS cdf_close, true AS median_close")
def _merge(spark, d):
    li = table(spark, d, "lineitem")
    whole = K.quantile_merge(K.quantile_sketch(li, "l_extendedprice", "l_returnflag"))
    at = [1000.0, 20000.0, 60000.0]
    true = li.agg(*(F.avg((F.col("l_extendedprice") <= v).cast("double")).alias(f"c{i}") for i, v in enumerate(at)), F.percentile("l_extendedprice", 0.45).alias("lo"), F.percentile("l_extendedprice", 0.55).alias("hi"))
    got = K.cdf(whole, at).withColumn("median", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).crossJoin(F.broadcast(true))  # one row each
    near = F.lit(True)
    for i in range(len(at)):
        near = near & (F.abs(F.get("cdf", i) - F.col(f"c{i}")) < 0.03)
    return got.select(near.alias("cdf_close"), F.col("median").between(F.col("lo"), F.col("hi")).alias("median_close"))


@query("cms_merge_top", "SELECT CAST(5 AS BIGINT) AS n, true AS as_frequent")
def _top(spark, d):
    """Sketches of parts are summed; the values that the merged one puts on top are as frequent as the true top, within its error."""
    li = table(spark, d, "lineitem")
    parts = [K.count_min(li.where(F.col("l_returnflag") == x), "l_suppkey") for x in "ANR"]
    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("depth", "cell").agg(F.sum("n").alias("n"))
    true = li.groupBy(F.col("l_suppkey").alias("value")).agg(F.count("*").alias("n"))
    fifth = true.orderBy(F.desc("n")).limit(5).agg(F.min("n").alias("least"))
    top = K.count_min_top(merged, li, "l_suppkey", 5).join(true, "value")
    rows = li.agg(F.count("*").alias("rows"))
    return top.crossJoin(fifth).crossJoin(rows).agg(F.count("*").alias("n"), F.bool_and(F.col("n") >= F.col("least") - 2.718281828 / K.CMS_WIDTH * F.col("rows")).alias("as_frequent"))  # one row each


# search
_TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) > 1)"


@query("postings_stream", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang ELSE text END AS text FROM documents WHERE doc_id % 3 <> 2)) GROUP BY term")
def _reindex(spark, d):
    """Of an index of all documents a third is replaced and a third removed by a batch of changes."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    changed = docs.where("doc_id % 3 = 1").select("doc_id", F.col("lang").alias("text"))
    index = S.reindex(S.postings(docs), changed, docs.where("doc_id % 3 = 2"))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("json_path_lookup", "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '5'")
def _json_lookup(spark, d):
    e = table(spark, d, "events")
    return S.json_path_lookup(e, S.json_path_index(e, "event_id", "props", "k"), "event_id", "props", "5", "k").select("event_id", "event_type")


# routing
_INTENTS = {
    "SELECT name FROM t WHERE id = $1 LIMIT 1": "lookup", "SELECT id FROM t WHERE note LIKE '%x%' ORDER BY id": "search", "SELECT id FROM t WHERE note MATCH 'x' ORDER BY id": "search",
    "SELECT a, sum(b) FROM t GROUP BY a": "analytics", "SELECT rank() OVER (PARTITION BY a ORDER BY b), count(*) FROM t JOIN u": "analytics",
    "SELECT id FROM t WHERE note MATCH 'x' ORDER BY cosine(embedding, $1)": "hybrid", "SELECT id FROM t WHERE note LIKE 'x' ORDER BY vector_distance(v)": "hybrid", "SELECT 1": "lookup",
}


@query("query_intent", "SELECT * FROM (VALUES " + ", ".join("('" + sql.replace("'", "''") + f"', '{x}')" for sql, x in _INTENTS.items()) + ") t (statement, intent)")
def _intent(spark, d):
    asked = spark.createDataFrame([(sql,) for sql in _INTENTS], "statement string")
    return asked.select("statement", R.intent(F.col("statement")).alias("intent"))


@query("hash_ring", "SELECT count(*) AS n, true AS spread, true AS only_to_new, true AS replicas_differ FROM orders")
def _ring(spark, d):
    """Orders on four shards, then on five: none holds twice its share, and what moves goes to the new one."""
    four, five = R.HashRing(list("abcd")), R.HashRing(list("abcde"))
    o = table(spark, d, "orders").select(four.shard(F.col("o_orderkey")).alias("before"), five.shard(F.col("o_orderkey")).alias("after"), five.replicas(F.col("o_orderkey"), 3).alias("copies"))
    per = o.groupBy("before").agg(F.count("*").alias("n"), F.bool_and((F.col("before") == F.col("after")) | (F.col("after") == "e")).alias("moved"), F.bool_and((F.size(F.array_distinct("copies")) == 3) & (F.get("copies", 0) == F.col("after"))).alias("differ"))
    return per.agg(F.sum("n").alias("n"), (F.max("n") < 2 * F.sum("n") / 4).alias("spread"), F.bool_and("moved").alias("only_to_new"), F.bool_and("differ").alias("replicas_differ"))


# streams
def _as_stream(spark, df, files: int, per_batch: int):
    """df as a stream of so many files."""
    from ..sources.copying import scratch

    at = scratch(spark, "stream")
    df.repartition(files).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(at)


def _drained(spark, stream, mode: str = "append"):
    """What a stream has written once all its files are read."""
    from ..sources.copying import scratch

    out, state = scratch(spark, "sink"), scratch(spark, "state")
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_late", """SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) w
    WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)""")
def _late(spark, d):
    """Appended windows of a stream: those that the watermark (two hours behind the latest event) has closed."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp"), "event_type")  # a watermark needs an instant
    got = _drained(spark, L.tumbling(_as_stream(spark, events, 1, 1), "ts", "1 hour", "event_type", late="2 hours"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_stateful", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def _stateful(spark, d):
    """Running counts over four micro-batches; the last of each user counts."""
    events = table(spark, d, "events").select("user_id", "value")
    got = _drained(spark, L.running(_as_stream(spark, events, 4, 1), "user_id", "value"))
    return got.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("top", "n").alias("top"))


@query("stream_dedup", "SELECT DISTINCT event_id, event_type FROM events")
def _dedup(spark, d):
    """Events sent twice, in different batches, each kept once."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp"))
    stream = _as_stream(spark, e.union(e), 3, 1).withWatermark("ts", "3650 days").dropDuplicatesWithinWatermark(["event_id"])
    return _drained(spark, stream).select("event_id", "event_type")


@query("log_shipping", _ALL_REGIONS + " WHERE r_regionkey <> 3")
def _shipping(spark, d):
    """Statements written to a log, one sent twice and one damaged, applied to a session by a stream."""
    from ..sources.copying import scratch

    db = database(spark, d)
    made = [f"CREATE TABLE region ({_REGION})", *(f"INSERT INTO region VALUES ({r['r_regionkey']}, '{r['r_name']}')" for r in table(spark, d, "region").orderBy("r_regionkey").toLocalIterator()), "DELETE FROM region WHERE r_regionkey = 3"]
    lines = [L.log_line(i + 1, x) for i, x in enumerate(made)]
    at = scratch(spark, "log")
    spark.createDataFrame([(x,) for x in [*lines, lines[2], "99\t00000000\tDELETE FROM region"]], "value string").coalesce(1).write.text(at)
    L.Applier(spark, scratch(spark, "applied"), lambda _, text: db.execute(text)).start(L.read_log(spark, at), scratch(spark, "shipped")).awaitTermination()
    return _regions(db)


# procedures
@query("procedure_call", "SELECT n_nationkey, CAST(n_nationkey * 2 + (CASE WHEN n_regionkey > 2 THEN 10 ELSE 0 END) AS BIGINT) AS fee FROM nation")
def _procedure(spark, d):
    """A procedure with typed parameters, a branch and a registered function, called for each nation."""
    from ..procedures import Parameter, Procedures

    p = Procedures()
    p.register_function("twice", lambda v: v * 2)
    p.register("fee", "DECLARE extra = 0; IF region > 2 THEN SET extra = 10; END IF; RETURN twice(nation) + extra;", [Parameter("nation", "int"), Parameter("region", "int", 0)])
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").toLocalIterator()
    return spark.createDataFrame([(r[0], int(p.call("FEE", r[0], region=str(r[1])))) for r in rows], table(spark, d, "nation").select("n_nationkey").schema.add("fee", "long"))
