"""Query catalogue: one entry per operator, each with the SQL that gives the same rows.

``_SHARED`` is SQL that Spark and the checking engine both read; a Spark query is then that text over the
tables it names. Other entries build a DataFrame with the library and state the SQL beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..functions import vector as V
from ..operators import joins as X
from ..operators import search as S
from ..operators import sketches as K
from ..streaming import log as L
from . import services  # noqa: F401  registers its queries
from .base import BUILT as _BUILT
from .base import Build, database as _db, run_sql, table
from .base import query as _query

#: name -> SQL for both engines; tables in braces.
_SHARED: dict[str, str] = {
    "flagship": """SELECT c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total
        FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        WHERE n.n_regionkey = 3 GROUP BY c.c_mktsegment HAVING count(*) > 5 ORDER BY total DESC, c_mktsegment LIMIT 5""",
    # scans, projection, predicates
    "scan_project": "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}",
    "scan_all": "SELECT * FROM {nation}",
    "constant_select": "SELECT 42 AS answer, 'x' AS tag",
    "point_lookup": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey = 7",
    "indexed_eq_count": "SELECT count(*) AS n FROM {orders} WHERE o_orderpriority = '1-URGENT'",
    "filter_cmp": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_custkey <> 5 AND o_orderkey >= 10",
    "filter_and_or_not": "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus = 'F' OR o_custkey < 100) AND NOT (o_totalprice < 5000)",
    "filter_between": "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000",
    "filter_in": "SELECT p_partkey, p_brand FROM {part} WHERE p_size IN (1, 5, 9, 14)",
    "filter_null": "SELECT count(*) AS n, count(c_name) AS named FROM {customer} WHERE c_acctbal IS NOT NULL AND (c_name IS NULL OR c_custkey IS NOT NULL)",
    "filter_like": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type LIKE '%S%'",
    "filter_ilike": "SELECT p_partkey FROM {part} WHERE p_type ILIKE '%steel%'",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 20000 THEN 'medium' ELSE 'small' END AS size FROM {orders}",
    "computed_projection": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_linenumber AS minus FROM {lineitem}",
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_linenumber * 3 + 1 AS a, l_orderkey % 7 AS m, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS DOUBLE) AS d FROM {lineitem}",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "vectorised_filter_project": "SELECT sum(CASE WHEN l_quantity > 25 THEN l_linenumber * 2 + 1 ELSE 0 END) AS s, count(*) AS n FROM {lineitem} WHERE l_discount < 0.05".replace("sum(", "CAST(sum(").replace(" AS s", " AS BIGINT) AS s"),
    # subqueries and CTEs
    "subquery_in": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 150000)",
    "subquery_eq": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders})",
    "subquery_ne": "SELECT count(*) AS n FROM {orders} WHERE o_totalprice <> (SELECT min(o_totalprice) FROM {orders})",
    "scalar_subq_corr": "SELECT c.c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n_orders, (SELECT max(o.o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS top FROM {customer} c",
    "scalar_subq_uncorr": "SELECT n_nationkey, n_name, (SELECT count(*) FROM {region}) AS regions FROM {nation}",
    "scalar_subq_le": "SELECT n.n_nationkey, (SELECT count(*) FROM {nation} m WHERE m.n_nationkey <= n.n_nationkey) AS upto FROM {nation} n",
    "cte_multi": """WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 2), rich AS (SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 0)
        SELECT r.c_nationkey, CAST(sum(b.n) AS BIGINT) AS orders FROM big b JOIN rich r ON b.o_custkey = r.c_custkey GROUP BY r.c_nationkey""",
    "cte_recursive": "WITH RECURSIVE t(n, s) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 90) SELECT n, s FROM t",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM {supplier} s FULL JOIN {customer} c ON s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_three": "SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_three_filter": "SELECT p.p_brand, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE p.p_size < 10 AND s.s_acctbal > 0 GROUP BY p.p_brand",
    "join_chain": "SELECT r.r_name, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_filtered": "SELECT count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'O'",
    "join_self": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "join_theta": "SELECT a.r_regionkey AS a, n.n_nationkey AS n FROM {region} a JOIN {nation} n ON a.r_regionkey < n.n_regionkey",
    # aggregation
    "count_star": "SELECT count(*) AS n FROM {lineitem}",
    "count_col": "SELECT count(o_custkey) AS n FROM {orders} WHERE o_orderstatus = 'O'",
    "count_distinct": "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders}",
    "sum_all": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, round(sum(l_extendedprice), 2) AS t FROM {lineitem}",
    "avg_all": "SELECT round(avg(o_totalprice), 4) AS a, avg(o_totalprice) FILTER (WHERE o_orderkey < 0) AS none FROM {orders}",
    "min_max": "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS first, max(o_orderdate) AS last FROM {orders}",
    "sum_between": "SELECT round(sum(o_totalprice), 2) AS s, count(*) AS n FROM {orders} WHERE o_orderkey BETWEEN 100 AND 5000",
    "range_count": "SELECT count(*) AS n FROM {orders} WHERE o_orderkey BETWEEN 100 AND 1100",
    "filtered_agg": "SELECT round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F'",
    "agg_filter_clause": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
    "group_low_card": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n
        FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
    "group_high_card": "SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM {lineitem} GROUP BY l_partkey",
    "group_multi": "SELECT o_orderstatus, o_orderpriority, o_custkey % 4 AS k, count(*) AS n, max(o_totalprice) AS top FROM {orders} GROUP BY o_orderstatus, o_orderpriority, o_custkey % 4",
    "group_expr": "SELECT o_orderkey % 10 AS d, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM {orders} GROUP BY o_orderkey % 10",
    "having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 3 AND sum(o_totalprice) >= 1000",
    "group_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) = 1 AS is_sum FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "group_sets": "SELECT o_orderstatus, o_orderpriority, round(max(o_totalprice), 2) AS top FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    # windows
    "win_frames": """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, first_value(o_orderkey) OVER w AS f,
        last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}",
    "win_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS d FROM {orders}",
    "win_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM {customer}",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_running": """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 7) AS a, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "win_whole": "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS last FROM {nation}",
    "win_where_alias": "SELECT k, r FROM (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders} WHERE o_orderstatus <> 'P') x WHERE r <= 3",
    # sort, limit, set operations
    "topn": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "topn_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 100",
    "filter_topn": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 90000 ORDER BY o_totalprice, o_orderkey LIMIT 15",
    "sort_multi": "SELECT c_nationkey, c_mktsegment, c_custkey FROM {customer} ORDER BY c_nationkey DESC NULLS LAST, c_mktsegment ASC NULLS LAST, c_custkey ASC NULLS LAST",
    "limit_zero": "SELECT o_orderkey FROM {orders} LIMIT 0",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "except_chain": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} EXCEPT SELECT s_suppkey FROM {supplier}",
    "sort_nulls": """SELECT k, row_number() OVER (ORDER BY k DESC NULLS LAST, c_custkey) AS r, row_number() OVER (ORDER BY k ASC NULLS FIRST, c_custkey) AS q
        FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS k, c_custkey FROM {customer}) x""",
    # scalar functions
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, date_trunc('month', o_orderdate) AS month_start, o_orderdate + INTERVAL '3' DAY AS later, o_orderdate < TIMESTAMP '1995-06-01 00:00:00' AS early FROM {orders}",
    "fn_regex": "SELECT p_partkey, regexp_replace(p_type, '[A-Z]+$', 'x') AS t, regexp_extract(p_brand, '([0-9]+)', 1) AS d FROM {part}",
    "fn_string": "SELECT c_custkey, length(c_name) AS n, upper(c_mktsegment) AS u, lower(c_name) AS l, coalesce(c_name, '') AS c FROM {customer}",
    "fn_math": "SELECT c_custkey, abs(c_acctbal) AS a, greatest(c_acctbal, 0, c_custkey) AS g, least(c_acctbal, c_custkey) AS s FROM {customer}",
}

@_query("prepared_param", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000.5")
def _prepared(spark, d):
    return run_sql(spark, d, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :p1 AND o_totalprice > :p2", p1=10, p2=1000.5)


@_query("join_merge_hint", "SELECT o.o_orderkey AS k, c.c_nationkey AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _merge(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c.hint("merge"), o.o_custkey == c.c_custkey).select(o.o_orderkey.alias("k"), c.c_nationkey.alias("n"))


@_query("join_probe_rename", "SELECT n.n_nationkey AS key, n.n_name AS name, r.r_name AS probe_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def _probe(spark, d):
    build = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("probe_name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    return n.join(build, n.n_regionkey == build.k).select("key", "name", "probe_name")


@_query("join_broadcast_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 AND p_brand = 'Brand#11'")
def _lookup(spark, d):
    few = table(spark, d, "part").where("p_size = 7 AND p_brand = 'Brand#11'").select("p_partkey", "p_name")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(few, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@_query("quantile_exact", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def _quantile(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.5), 4).alias("p50"), F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90"))


# JSON
@_query("json_extract_text", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def _json_text(spark, d):
    return table(spark, d, "events").groupBy(J.get_text(F.col("props"), "k").alias("k")).agg(F.count("*").alias("n"))


@_query("json_extract_missing", "SELECT count(*) AS n FROM events WHERE json_extract_string(props, '$.zz.y') IS NULL")
def _json_missing(spark, d):
    return table(spark, d, "events").where(J.get_text(F.col("props"), "zz", "y").isNull()).agg(F.count("*").alias("n"))


@_query("json_arrow", "SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS k FROM events")
def _json_arrow(spark, d):
    return table(spark, d, "events").select("event_id", J.get(F.col("props"), "k").alias("k"))


@_query("json_key_exists", "SELECT count(*) AS n FROM events WHERE list_contains(json_keys(props), 'k')")
def _json_key(spark, d):
    return table(spark, d, "events").where(J.has_key(F.col("props"), "k")).agg(F.count("*").alias("n"))


@_query("json_contains", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def _json_contains(spark, d):
    return table(spark, d, "events").where(J.contains(F.col("props"), '{"k": 5}')).select("event_id")


_PAIR = "CASE event_type WHEN 'error' THEN '[]' WHEN 'click' THEN '[' || props || ']' ELSE '[' || props || ', [1, 2], ' || props || ']' END"


@_query("json_array_length", f"SELECT event_id, CAST(json_array_length({_PAIR}) AS INT) AS n, CAST(NULL AS INT) AS of_object FROM events")
def _json_len(spark, d):
    return table(spark, d, "events").select("event_id", J.array_length(F.expr(_PAIR)).alias("n"), J.array_length(F.col("props")).alias("of_object"))


@_query("json_valid", "SELECT count(*) AS n FROM events WHERE json_valid(props)")
def _json_valid(spark, d):
    return table(spark, d, "events").where(J.valid(F.col("props"))).agg(F.count("*").alias("n"))


@_query("jsonb_canonical", "SELECT event_id, replace(props, ' ', '') AS props FROM events")
def _jsonb(spark, d):
    return table(spark, d, "events").select("event_id", J.canonical(F.col("props")).alias("props"))


@_query("uuid_canonical", "SELECT c_custkey, lower('550E8400-E29B-41D4-A716-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS u FROM customer")
def _uuid(spark, d):
    raw = F.concat(F.lit("550E8400-E29B-41D4-A716-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return table(spark, d, "customer").select("c_custkey", F.lower(raw).alias("u")).where(F.col("u").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))


@_query("uuid_generate", "SELECT count(*) AS n, count(*) AS different, true AS well_formed FROM orders")
def _uuid4(spark, d):
    u = table(spark, d, "orders").select(F.uuid().alias("u"))
    return u.agg(F.count("*").alias("n"), F.countDistinct("u").alias("different"), F.bool_and(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"))


# text
_TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) > 1)"


@_query("tokenise", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n FROM documents")
def _tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokenise(F.col("text"))).cast("long").alias("n"))


@_query("fts_match", f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['license', 'idiot'])")
def _fts(spark, d):
    return S.match(table(spark, d, "documents"), "license idiot").select("doc_id")


def _bm25_sql(terms: list[str], limit: str = "ORDER BY score DESC, id LIMIT 10", cols: str = "id AS doc_id, round(score, 6) AS score") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
        q AS (SELECT unnest([{listed}]) AS term), p AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
        f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
        r AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY id)
        SELECT {cols} FROM r {limit}"""


@_query("bm25_topk", _bm25_sql(["license", "version", "work"]))
def _bm25(spark, d):
    return S.top(S.bm25(table(spark, d, "documents"), "license version work"), 10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@_query("inverted_index", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def _postings(spark, d):
    return S.postings(table(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_query("trigram_like", "SELECT doc_id FROM documents WHERE text LIKE '%License%'")
def _trigram(spark, d):
    return S.trigram_like(table(spark, d, "documents"), "License").select("doc_id")


@_query("trigram_index_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%mer#%12%' AND contains(c_name, '012')")
def _trigram_index(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    index = S.trigram_postings(c, "c_custkey", "c_name")
    return S.trigram_like(S.trigram_like(c, "012", "c_name", index, "c_custkey"), "mer#", "c_name", index, "c_custkey").where("c_name LIKE '%mer#%12%'").select("c_custkey")


@_query("trigram_sets", "SELECT p_partkey, CAST(len(list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', CAST(i AS INT), 3)))) AS BIGINT) AS n FROM part")
def _trigram_sets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(T.trigrams(F.col("p_name"))).cast("long").alias("n"))


@_query("synonym_expand", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'america,new world,usa' ELSE 'other' END AS t FROM nation")
def _synonyms(spark, d):
    known = T.synonym_map([["america", "usa", "new world"]])
    toks = F.array(F.when(F.col("n_regionkey") == 1, F.lit("america")).otherwise(F.lit("other")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(T.expand(toks, known), ",").alias("t"))


# vectors
def _vector_of(spark, d, i: int = 0):
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"]]


_QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_KNN = "SELECT vec_id, round({f}, 6) AS dist FROM embeddings ORDER BY {f}, vec_id LIMIT 10"


def _knn(metric):
    def run(spark, d):
        return S.knn(table(spark, d, "embeddings"), _vector_of(spark, d), 10, metric).select(F.col("id").alias("vec_id"), F.round("dist", 6).alias("dist"))

    return run


for _name, _metric, _f in (("knn_l2", "l2", "list_distance"), ("knn_cosine", "cosine", "list_cosine_distance"), ("knn_ip", "ip", "list_negative_inner_product")):
    _BUILT[_name] = (_knn(_metric), _KNN.replace("{f}", f"{_f}(CAST(embedding AS DOUBLE[]), {_QV})"))


@_query("search_dot", f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), {_QV}), 6) AS score FROM embeddings ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), {_QV}) DESC, vec_id LIMIT 10")
def _dot(spark, d):
    return S.search_dot(table(spark, d, "embeddings"), _vector_of(spark, d), 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@_query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, CAST(len(embedding) AS INT) AS dim FROM embeddings")
def _norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dim"))


def _recall(spark, d, search) -> DataFrame:
    """Whether an approximate search finds at least 0.9 of the ten nearest, over five queries against all rows."""
    vectors = table(spark, d, "embeddings")
    found = None
    for i in range(5):
        q = _vector_of(spark, d, i)
        both = search(vectors, q).select("id").join(S.knn(vectors, q, 10).select("id"), "id", "left_semi").agg(F.count("*").alias("n"))
        found = both if found is None else found.union(both)
    return found.agg((F.sum("n") >= 45).alias("recall_90"))


@_query("ann_lsh", "SELECT true AS recall_90")
def _lsh(spark, d):
    return _recall(spark, d, lambda vectors, q: S.lsh_knn(vectors, q, 10))


@_query("ann_pq", "SELECT true AS recall_90")
def _pq(spark, d):
    codes, books = S.product_quantize(table(spark, d, "embeddings"))
    return _recall(spark, d, lambda vectors, q: S.pq_knn(vectors, codes, books, q, 10))


_LEX = _bm25_sql(["license", "version", "work"], "ORDER BY score DESC, id LIMIT 50", "id, score")
_VEC = f"SELECT vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), {_QV}) AS dist FROM embeddings ORDER BY dist, id LIMIT 50"


def _hybrid(fusion):
    def run(spark, d):
        got = S.hybrid(table(spark, d, "documents"), table(spark, d, "embeddings"), "license version work", _vector_of(spark, d), 10, 50, fusion)
        return got.select("id", F.round("score", 9).alias("score"))

    return run


_BUILT["hybrid_rrf"] = (_hybrid("rrf"), f"""WITH l AS ({_LEX}), v AS ({_VEC}), u AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM l UNION ALL SELECT id, row_number() OVER (ORDER BY dist, id) FROM v)
    SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM u GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 10""")
_BUILT["hybrid_weighted"] = (_hybrid("weighted"), f"""WITH l0 AS ({_LEX}), v0 AS ({_VEC}), v1 AS (SELECT id, 1 - least(dist, 1.0) AS s FROM v0),
    l AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-10 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS x FROM l0),
    v AS (SELECT id, CASE WHEN max(s) OVER () - min(s) OVER () < 1e-10 THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS y FROM v1)
    SELECT coalesce(l.id, v.id) AS id, round(0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0), 9) AS score FROM l FULL JOIN v ON l.id = v.id ORDER BY 0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0) DESC, 1 LIMIT 10""")
_BUILT["hybrid_dbsf"] = (_hybrid("dbsf"), f"""WITH l0 AS ({_LEX}), v0 AS ({_VEC}), l AS (SELECT id, CASE WHEN stddev_pop(score) OVER () <= 1e-10 THEN 0.0 ELSE (score - avg(score) OVER ()) / stddev_pop(score) OVER () END AS x FROM l0),
    v AS (SELECT id, CASE WHEN stddev_pop(-dist) OVER () <= 1e-10 THEN 0.0 ELSE (-dist - avg(-dist) OVER ()) / stddev_pop(-dist) OVER () END AS y FROM v0)
    SELECT coalesce(l.id, v.id) AS id, round(coalesce(x, 0) + coalesce(y, 0), 9) AS score FROM l FULL JOIN v ON l.id = v.id ORDER BY coalesce(x, 0) + coalesce(y, 0) DESC, 1 LIMIT 10""")


@_query("hybrid_rerank", f"""WITH l AS ({_LEX}), v AS ({_VEC}), u AS (SELECT id FROM l UNION SELECT id FROM v)
    SELECT u.id, round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])) / len(e.embedding), 0), 4) AS score FROM u LEFT JOIN embeddings e ON e.vec_id = u.id WHERE e.vec_id IS NOT NULL""")
def _rerank(spark, d):
    lex = S.top(S.bm25(table(spark, d, "documents"), "license version work"), 50)
    vec = S.knn(table(spark, d, "embeddings"), _vector_of(spark, d), 50)
    return S.rrf(lex, vec).join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "id").select("id", F.round(S.mean_of_embedding(), 4).alias("score"))


# sketches, with their bounds as the result
@_query("hll", "SELECT true AS within_bound")
def _hll(spark, d):
    o = table(spark, d, "orders")
    merged = K.hll_merge(K.hll(o, "o_custkey", "o_orderstatus"))
    return merged.crossJoin(o.agg(F.countDistinct("o_custkey").alias("n"))).select((F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("within_bound"))


@_query("cms", "SELECT true AS never_below, true AS close")
def _cms(spark, d):
    li = table(spark, d, "lineitem")
    true = li.groupBy(F.col("l_partkey").alias("value")).agg(F.count("*").alias("n"))
    got = K.count_min_estimate(K.count_min(li, "l_partkey"), li, "l_partkey").join(true, "value")
    total = F.sum("n")
    return got.agg((F.min(F.col("estimate") - F.col("n")) >= 0).alias("never_below"), (F.percentile(F.col("estimate") - F.col("n"), 0.95) <= 2.718281828 / 2048 * total + 1).alias("close"))


@_query("bloom", "SELECT true AS no_false_negative, true AS few_false_positives")
def _bloom(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("v"))
    f = K.bloom(c, "v")
    inside = K.bloom_might_contain(f, c, "v").agg(F.bool_and("maybe").alias("no_false_negative"))
    outside = K.bloom_might_contain(f, spark.range(10_000_000, 10_002_000).select(F.col("id").alias("v")), "v").agg((F.avg(F.col("maybe").cast("int")) < 0.02).alias("few_false_positives"))
    return inside.crossJoin(outside)


@_query("quantile_approx", "SELECT true AS within_bound")
def _kll(spark, d):
    li = table(spark, d, "lineitem")
    q = K.quantiles(li, "l_extendedprice", [0.1, 0.5, 0.9])
    ranks = li.crossJoin(F.broadcast(q)).agg(*(F.avg((F.col("l_extendedprice") <= F.get("quantiles", i)).cast("double")).alias(f"r{i}") for i in range(3)))
    return ranks.select(((F.abs(F.col("r0") - 0.1) < 0.05) & (F.abs(F.col("r1") - 0.5) < 0.05) & (F.abs(F.col("r2") - 0.9) < 0.05)).alias("within_bound"))


@_query("trimmed_mean", "SELECT round(avg(o_totalprice), 4) AS trimmed_mean FROM orders, (SELECT quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders) q WHERE o_totalprice BETWEEN lo AND hi")
def _trimmed(spark, d):
    return K.trimmed_mean(table(spark, d, "orders"), "o_totalprice", 0.1, 0.9).select(F.round("trimmed_mean", 4).alias("trimmed_mean"))


@_query("topk_freq", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10")
def _freq(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


@_query("histogram", "SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor((o_totalprice - lo) / (hi - lo) * 16) + 1, 16) END AS INT) AS bucket, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) q WHERE o_totalprice IS NOT NULL GROUP BY 1")
def _hist(spark, d):
    return K.histogram(table(spark, d, "orders"), "o_totalprice")


@_query("bitmap_ops", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_and, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_or, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_and_not,
    (SELECT count(*) FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL) AS n_xor""")
def _bitmaps(spark, d):
    o = table(spark, d, "orders")
    return K.bitmap_sizes(*(K.bitmap(o.where(F.col("o_orderstatus") == x), "o_custkey") for x in "FO"))


@_query("analyze_table", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS ndv, round(count(DISTINCT o_custkey) / count(*), 6) AS selectivity, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders")
def _analyze(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("ndv"), F.round(F.countDistinct("o_custkey") / F.count("*"), 6).alias("selectivity"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))


@_query("shard_stats", "SELECT CAST(4 AS BIGINT) AS shards, count(*) AS n FROM orders")
def _shards(spark, d):
    per = table(spark, d, "orders").groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)).alias("shard")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("shards"), F.sum("n").alias("n"))


@_query("join_asof", """SELECT p.event_id, c.click_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT event_id AS click_id, user_id, ts FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def _asof(spark, d):
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    return X.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["click_id"]).select("event_id", "click_id")


@_query("join_interval", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_custkey >= p_partkey * 3 AND o_custkey < p_partkey * 3 + p_size")
def _interval(spark, d):
    spans = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("lo"), (F.col("p_partkey") * 3 + F.col("p_size")).alias("hi"))
    return X.interval_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), spans, "o_custkey", "lo", "hi", 64).select("o_orderkey", "p_partkey")


# copies in and out
@_query("copy_csv", "SELECT * FROM nation")
def _csv(spark, d):
    from ..sources.copying import copy_from_csv, copy_to, scratch

    at = scratch(spark, "csv")
    src = table(spark, d, "nation")
    copy_to(src, at, "csv", root=at)
    return copy_from_csv(spark, f"{at}/*.csv", src.schema)


@_query("copy_jsonl", "SELECT * FROM region")
def _jsonl(spark, d):
    from ..sources.copying import copy_from_jsonl, copy_to, scratch

    at = scratch(spark, "jsonl")
    src = table(spark, d, "region")
    copy_to(src, at, "json", root=at)
    return copy_from_jsonl(spark, f"{at}/*.json", src.schema)


@_query("copy_parquet", "SELECT * FROM supplier")
def _parquet(spark, d):
    from ..sources.copying import copy_from_parquet, copy_to, scratch

    at = scratch(spark, "parquet")
    copy_to(table(spark, d, "supplier"), at, "parquet", root=at)
    return copy_from_parquet(spark, at)


# what statements leave behind: each runs in a session over a catalogue of its own
_ORDERS = "o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT {}, o_orderstatus TEXT, o_totalprice DOUBLE CHECK (o_totalprice >= 0)"
_CUSTOMER = "c_custkey BIGINT PRIMARY KEY, c_nationkey INT"


@_query("delete_where", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 50000, false)")
def _delete(spark, d):
    db = _db(spark, d, orders=_ORDERS.format(""))
    db.execute("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000")
    return db.sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")


@_query("update_set", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders")
def _update(spark, d):
    db = _db(spark, d, orders=_ORDERS.format(""))
    db.execute("UPDATE orders SET o_totalprice = o_totalprice + 10 WHERE o_orderstatus = 'O'")
    return db.sql("SELECT o_orderkey, o_totalprice FROM orders")


@_query("insert_default", "SELECT r_regionkey, r_name, 'none' AS note FROM region UNION ALL SELECT 99, 'ATLANTIS', 'new'")
def _insert(spark, d):
    db = _db(spark, d, region="r_regionkey INT, r_name TEXT")
    db.execute("CREATE TABLE noted (r_regionkey INT PRIMARY KEY, r_name TEXT NOT NULL, note TEXT DEFAULT 'none')")
    db.execute("INSERT INTO noted (r_regionkey, r_name) SELECT r_regionkey, r_name FROM region")
    db.execute("INSERT INTO noted VALUES (99, 'ATLANTIS', 'new')")
    return db.sql("SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name, note FROM noted")


@_query("insert_identity", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS numbers, CAST(1 AS BIGINT) AS lo, CAST(count(*) AS BIGINT) AS hi FROM customer")
def _identity(spark, d):
    db = _db(spark, d, customer="c_custkey BIGINT, c_name TEXT")
    db.execute("CREATE TABLE numbered (id INT GENERATED ALWAYS AS IDENTITY, c_custkey BIGINT)")
    db.execute("INSERT INTO numbered (c_custkey) SELECT c_custkey FROM customer")
    return db.sql("SELECT count(*) AS n, count(DISTINCT id) AS numbers, min(id) AS lo, max(id) AS hi FROM numbered")


@_query("alter_add_drop", "SELECT n_nationkey AS nation_id, n_name, CAST(NULL AS VARCHAR) AS extra FROM nation")
def _alter(spark, d):
    db = _db(spark, d, nation="n_nationkey INT PRIMARY KEY, n_name TEXT UNIQUE, n_regionkey INT")
    for change in ("ADD COLUMN extra TEXT", "RENAME COLUMN n_nationkey TO nation_id", "DROP COLUMN n_regionkey"):
        db.execute(f"ALTER TABLE nation {change}")
    return db.sql("SELECT CAST(nation_id AS INT) AS nation_id, n_name, extra FROM nation")


@_query("fk_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _fk_cascade(spark, d):
    db = _db(spark, d, customer=_CUSTOMER, orders=_ORDERS.format("REFERENCES customer (c_custkey) ON DELETE CASCADE"))
    db.execute("DELETE FROM customer WHERE c_nationkey = 3")
    return db.sql("SELECT o_orderkey, o_custkey FROM orders")


@_query("fk_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def _fk_set_null(spark, d):
    db = _db(spark, d, customer=_CUSTOMER, orders=_ORDERS.format("REFERENCES customer (c_custkey) ON DELETE SET NULL"))
    db.execute("DELETE FROM customer WHERE c_nationkey = 3")
    return db.sql("SELECT o_orderkey, o_custkey FROM orders")


@_query("fk_update_cascade", "SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _fk_update(spark, d):
    db = _db(spark, d, customer=_CUSTOMER, orders=_ORDERS.format("REFERENCES customer (c_custkey) ON UPDATE CASCADE"))
    db.execute("UPDATE customer SET c_custkey = c_custkey + 1000000 WHERE c_nationkey = 3")
    return db.sql("SELECT o_orderkey, o_custkey FROM orders")


@_query("truncate", "SELECT r_regionkey FROM region WHERE false")
def _truncate(spark, d):
    db = _db(spark, d, region="r_regionkey INT, r_name TEXT")
    db.execute("TRUNCATE TABLE region")
    return db.sql("SELECT CAST(r_regionkey AS INT) AS r_regionkey FROM region")


@_query("transaction", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _transaction(spark, d):
    db = _db(spark, d, supplier="s_suppkey BIGINT PRIMARY KEY, s_acctbal DOUBLE")
    for statement in ("BEGIN", "DELETE FROM supplier", "ALTER TABLE supplier ADD COLUMN gone TEXT", "ROLLBACK", "BEGIN", "UPDATE supplier SET s_acctbal = 0 WHERE s_acctbal < 0", "COMMIT"):
        db.execute(statement)
    return db.sql("SELECT s_suppkey, s_acctbal FROM supplier")


@_query("schema_columns", "SELECT column_name, CAST(ordinal_position AS INT) AS ordinal_position, CASE WHEN column_name = 'n_nationkey' THEN 'NO' ELSE 'YES' END AS is_nullable FROM information_schema.columns WHERE table_name = 'nation'")
def _columns(spark, d):
    db = _db(spark, d, nation="n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT")
    return db.sql("SELECT column_name, ordinal_position, is_nullable FROM information_schema.columns WHERE table_name = 'nation'")


@_query("column_sum_as_of", "SELECT round(sum(value), 4) AS s, count(value) AS n FROM events WHERE event_id <= 4100")
def _sum_as_of(spark, d):
    db = _db(spark, d, events="event_id BIGINT, value DOUBLE")
    db.execute("DELETE FROM events WHERE event_id > 4100")
    lsn = db.catalog.manifest("events")["versions"][-1]["lsn"]
    db.execute("INSERT INTO events VALUES (-1, 1000000)")
    return db.as_of("events", lsn=lsn).agg(F.round(F.sum("value"), 4).alias("s"), F.count("value").alias("n"))


@_query("mvcc_visible", """SELECT k, v FROM (SELECT event_id % 500 AS k, value AS v, event_id AS created, lead(event_id) OVER (PARTITION BY event_id % 500 ORDER BY event_id) AS deleted FROM events) x
    WHERE created <= 5000 AND (deleted IS NULL OR deleted > 5000)""")
def _mvcc(spark, d):
    key = (F.col("event_id") % 500).alias("k")
    rows = table(spark, d, "events").select(key, F.col("value").alias("v"), F.col("event_id").alias("created"), F.lead("event_id").over(Window.partitionBy(F.col("event_id") % 500).orderBy("event_id")).alias("deleted"))
    return rows.where(L.visible(F.col("created"), F.col("deleted"), 5000)).select("k", "v")


@_query("pitr_as_of", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 6000) x WHERE r = 1 AND event_type <> 'error'")
def _pitr(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op")
    return L.replay(table(spark, d, "events").select("user_id", "event_id", "value", op), "user_id", 6000, lsn="event_id").select("user_id", "event_id", "value")


@_query("upsert_changes", "SELECT user_id, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) x WHERE r = 1 AND event_type <> 'error' UNION ALL SELECT -1, 0.5")
def _upsert(spark, d):
    old = spark.sql("SELECT CAST(-1 AS BIGINT) AS user_id, 0.5D AS value UNION ALL SELECT CAST(0 AS BIGINT), -1D UNION ALL SELECT CAST(1 AS BIGINT), -1D")
    changes = table(spark, d, "events").select("user_id", "value", F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"))
    return L.upsert(old, changes, "user_id")


@_query("wal_apply_dedup", "SELECT event_id AS lsn, event_type AS text FROM events WHERE event_id > 50 AND event_id % 7 <> 0")
def _wal(spark, d):
    """Log lines, some sent again and some damaged, above a high-water mark."""
    e = table(spark, d, "events")
    right = F.concat_ws("\t", "event_id", F.lpad(F.lower(F.hex(F.crc32(F.col("event_type").cast("binary")))), 8, "0"), "event_type")
    lines = e.select(F.when(F.col("event_id") % 7 == 0, F.concat(right, F.lit("x"))).otherwise(right).alias("value"))
    return L.once(L.parse_log(lines.union(lines.where(F.xxhash64("value") % 3 == 0))), 50).select("lsn", "text")


# windows over event time
@_query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@_query("stream_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY ALL")
def _sliding(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@_query("stream_session", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _session(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@_query("top_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


def _shared(sql: str) -> Build:
    return lambda spark, d: run_sql(spark, d, sql)


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


QUERIES: dict[str, Build] = {**{n: _shared(s) for n, s in _SHARED.items()}, **{n: fn for n, (fn, _) in _BUILT.items()}}
ORACLES: dict[str, str] = {**{n: _plain(s) for n, s in _SHARED.items()}, **{n: s for n, (_, s) in _BUILT.items() if s}}
