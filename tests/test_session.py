"""The session: predicates, identity, constraints, transactions, JSON and vectors, on small tables."""

import pytest

from lumenq.catalog import CatalogError, ConflictError
from lumenq.frontend import SqlError, classify, rewrite, statements, workload
from lumenq.functions.json import JsonError
from lumenq.session import ConstraintError, Session


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, str(tmp_path / "db"))


def ids(db, sql, params=None):
    return [r[0] for r in db.sql(sql, params).collect()]


CODE = "7d0c61ae-93f2-4b58-8a17-0000000000"


@pytest.fixture
def q(db):
    """Six parcels; what their info says differs in kind as much as in value."""
    db.execute("CREATE TABLE parcel (id INTEGER PRIMARY KEY, depot INTEGER, grams INTEGER, state TEXT, code UUID, info JSONB)")
    rows = [
        (11, 7, 250, "stored", '{"kind":"letter","to":{"town":"Bergen","zip":"5003"},"marks":["fragile"]}'),
        (12, 7, 900, "sent", '{"kind":"box","to":{"town":"Oslo"},"marks":["heavy","fragile"],"tries":2}'),
        (13, 8, 4100, "sent", '{"kind":"box","to":{"town":"Bergen"},"tries":2.0,"paid":false}'),
        (14, 8, 60, "lost", '{"kind":null,"to":null}'),
        (15, 9, 1500, "stored", '{"to":{"town":"Voss","gate":{"no":"4b"}},"tries":"2"}'),
        (16, 9, 75, "stored", '{}'),
    ]
    db.execute("INSERT INTO parcel VALUES " + ", ".join(f"({i}, {d}, {g}, '{st}', '{CODE.upper()}{i}', '{info}')" for i, d, g, st, info in rows))
    return db


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("state = 'sent'", [12, 13]),
        ("grams BETWEEN 75 AND 900", [11, 12, 16]),
        ("depot = 9 AND NOT grams > 100", [16]),
        ("depot = 7 OR state = 'lost'", [11, 12, 14]),
        ("info ->> 'kind' = 'box'", [12, 13]),
        ("info #>> '{to,town}' = 'Bergen'", [11, 13]),
        ("info #>> '{to,gate,no}' = '4b'", [15]),
        ("info -> 'to' -> 'town' = '\"Oslo\"'", [12]),
        ("info -> 'marks' ->> 1 = 'fragile'", [12]),
        ("info ? 'kind'", [11, 12, 13, 14]),
        ("info ? 'town'", []),
        ("info @> '{\"kind\":\"box\"}'", [12, 13]),
        ("info @> '{\"to\":{\"gate\":{\"no\":\"4b\"}}}'", [15]),
        ("info @> '{\"kind\":null}'", [14]),
        ("info @> '{\"tries\":2}'", [12]),
        ("info @> '{\"tries\":2.0}'", [13]),
        ("info @> '{\"tries\":\"2\"}'", [15]),
        ("info @> '{\"paid\":false}'", [13]),
        ("info @> '{}'", [11, 12, 13, 14, 15, 16]),
        ("info @> '7'", []),
        (f"code = '{CODE}14'", [14]),
    ],
)
def test_predicates(q, where, want):
    assert ids(q, f"SELECT id FROM parcel WHERE {where} ORDER BY id") == want


def test_parameters_order_and_indexes(q):
    assert ids(q, "SELECT id FROM parcel WHERE depot = $2 AND state = $1 ORDER BY id", ["sent", 8]) == [13]
    assert ids(q, "SELECT id FROM parcel WHERE depot > 7 ORDER BY grams DESC LIMIT 2 OFFSET 1") == [15, 16]
    q.prepare("heavy", "SELECT id FROM parcel WHERE grams >= $1 ORDER BY id")
    assert [[r[0] for r in q.execute_prepared("heavy", [g]).df.collect()] for g in (1000, 5000)] == [[13, 15], []]
    before = ids(q, "SELECT id FROM parcel WHERE state = 'stored' ORDER BY id")
    q.execute("CREATE INDEX by_state ON parcel (state)")
    assert ids(q, "SELECT id FROM parcel WHERE state = 'stored' ORDER BY id") == before == [11, 15, 16]
    for bad in ("info @> '[\"kind\"]'", "info @> '{\"kind\"'"):
        with pytest.raises(JsonError):
            q.sql(f"SELECT id FROM parcel WHERE {bad}")


def test_update_and_delete(q):
    assert q.execute("UPDATE parcel SET grams = grams * 2, state = 'weighed' WHERE info @> '{\"kind\":\"box\"}'").tag == "UPDATE 2"
    assert [tuple(r) for r in q.sql("SELECT id, grams FROM parcel WHERE state = 'weighed' ORDER BY id").collect()] == [(12, 1800), (13, 8200)]
    assert q.execute("DELETE FROM parcel WHERE grams < 100 OR depot = 7").tag == "DELETE 4"
    assert sorted(ids(q, "SELECT id FROM parcel")) == [13, 15]
    for bad in ("DELETE FROM parcel WHERE", "DROP TABLE IF EXISTS", "UPDATE parcel SET colour = 1", "SELECT 'x FROM parcel", "SAVEPOINT a", "CREATE SEQUENCE s"):
        with pytest.raises((SqlError, CatalogError)):
            q.execute(bad)
    first = q.catalog.manifest("parcel")["versions"][1]
    assert q.as_of("parcel", lsn=first["lsn"]).count() == 6


def test_identity(db):
    db.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, name TEXT UNIQUE)")
    add = lambda v, c="(name)": db.execute(f"INSERT INTO a {c} VALUES ({v})")
    add("'a'")
    add("'b'")
    add("100, 'c'", "(id, name)")
    add("'d'")
    db.execute("DELETE FROM a WHERE id = 101")
    db.execute("BEGIN")
    add("'e'")
    assert 102 in ids(db, "SELECT id FROM a")
    db.execute("ROLLBACK")
    assert 102 not in ids(db, "SELECT id FROM a")
    add("'f'")
    with pytest.raises(ConstraintError):
        add("'f'")
    add("'g'")
    assert sorted(ids(db, "SELECT id FROM a")) == [1, 2, 100, 103, 105]
    db.execute("CREATE TABLE g (id INT GENERATED ALWAYS AS IDENTITY, b INT GENERATED BY DEFAULT AS IDENTITY, n TEXT)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO g (id, n) VALUES (7, 'x')")
    db.execute("INSERT INTO g (id, b, n) OVERRIDING SYSTEM VALUE VALUES (100, 50, 'x')")
    db.execute("INSERT INTO g (n) VALUES ('y'), ('z')")
    assert sorted(tuple(r) for r in db.sql("SELECT id, b, n FROM g").collect()) == [(1, 1, "y"), (2, 2, "z"), (100, 50, "x")]


def test_constraints(db):
    db.execute("CREATE TABLE p (id INT PRIMARY KEY, v INT CHECK (v > 0), d TEXT DEFAULT 'none' NOT NULL)")
    db.execute("CREATE TABLE c (id INT PRIMARY KEY, p INT REFERENCES p (id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.execute("CREATE TABLE s (id INT PRIMARY KEY, p INT DEFAULT 2 REFERENCES p (id) ON DELETE SET NULL)")
    db.execute("CREATE TABLE r (id INT PRIMARY KEY, p INT REFERENCES p (id) ON DELETE RESTRICT)")
    db.execute("INSERT INTO p (id, v) VALUES (1, 1), (2, 2), (3, 3)")
    db.execute("INSERT INTO c VALUES (1, 1), (2, 1), (3, 2)")
    db.execute("INSERT INTO s VALUES (1, 1), (2, 2)")
    db.execute("INSERT INTO r VALUES (1, 3)")
    for bad in ("INSERT INTO p (id, v) VALUES (1, 5)", "INSERT INTO p (id, v) VALUES (9, 0)", "INSERT INTO p (id, d) VALUES (9, NULL)", "INSERT INTO c VALUES (9, 99)", "DELETE FROM p WHERE id = 3", "UPDATE p SET v = -1 WHERE id = 1"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("INSERT INTO p (id, v) VALUES (4, NULL)")  # a null passes a check
    db.execute("DELETE FROM p WHERE id = 1")
    assert ids(db, "SELECT id FROM c") == [3]
    assert [tuple(x) for x in db.sql("SELECT id, p FROM s ORDER BY id").collect()] == [(1, None), (2, 2)]
    assert [x[0] for x in db.sql("SELECT d FROM p").collect()] == ["none"] * 3


def test_json_vectors_and_text(db):
    db.execute("CREATE TABLE j (id INT PRIMARY KEY, raw JSON, bin JSONB)")
    db.execute("""INSERT INTO j VALUES (1, '{"b":2, "a":1}', '{"b":2, "a":1, "b":3}')""")
    assert tuple(db.sql("SELECT raw, bin FROM j").first()) == ('{"b":2, "a":1}', '{"a":1,"b":3}')
    with pytest.raises(Exception, match="invalid JSON"):
        db.execute("INSERT INTO j VALUES (2, '{\"name\":}', NULL)")
    db.execute("CREATE TABLE v (id INT PRIMARY KEY, text TEXT, embedding VECTOR(2))")
    db.execute("INSERT INTO v VALUES (1, 'alpha needle', '[0,0]'), (2, 'beta', '[1,0]'), (3, 'needle needle', '[2,0]')")
    assert ids(db, "SELECT id FROM v ORDER BY embedding <-> '[0.1,0]' LIMIT 3") == [1, 2, 3]
    assert ids(db, "SELECT id FROM v WHERE text @@ 'needle' ORDER BY id") == [1, 3]
    assert db.sql("SEARCH HYBRID ON v LEXICAL 'needle' VECTOR [2,0] TOP 2").first()["id"] == 3
    with pytest.raises(Exception, match="expected 2, got 3"):
        db.execute("INSERT INTO v VALUES (4, 'x', '[1,2,3]')")


def test_ddl_utility_and_copy(db, tmp_path):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, a TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'x'), (2, NULL)")
    db.execute("ALTER TABLE t ADD COLUMN b INT DEFAULT 7")
    db.execute("ALTER TABLE t RENAME COLUMN a TO name")
    assert [tuple(r) for r in db.sql("SELECT id, name, b FROM t ORDER BY name").collect()] == [(1, "x", 7), (2, None, 7)]
    assert ids(db, "SELECT id FROM t ORDER BY name DESC") == [2, 1]
    assert [r[0] for r in db.sql("SHOW TABLES").collect()] == ["t"] and db.sql("SHOW COLUMNS FROM t").count() == 3 and db.sql("SHOW STATS FOR t").count() == 3
    assert "workload" in db.sql("EXPLAIN SELECT count(*) FROM t").first()[0]
    db.execute("COPY t TO 'out'")
    with pytest.raises(ValueError):
        db.execute("COPY t TO '../../out'")
    (tmp_path / "in.csv").write_text('b,id,name\n5,10,"a ""q"", b"\nbad,11,y\n')
    assert db.execute(f"COPY t FROM '{tmp_path}/in.csv'").tag == "COPY 2"
    assert [tuple(r) for r in db.sql("SELECT id, name, b FROM t WHERE id >= 10 ORDER BY id").collect()] == [(10, 'a "q", b', 5), (11, "y", None)]
    db.execute("VACUUM t")
    assert db.sql("SELECT * FROM t").count() == 4
    db.execute("TRUNCATE TABLE t")
    assert db.sql("SELECT * FROM t").count() == 0
    db.execute("DROP TABLE t")
    with pytest.raises(CatalogError):
        db.execute("DROP TABLE t")
    assert db.execute("DROP TABLE IF EXISTS t").tag == "DROP TABLE"


def test_write_locks(spark, tmp_path):
    a = Session(spark, str(tmp_path / "x"))
    b = Session(spark, str(tmp_path / "x"))
    b.catalog = a.catalog
    a.execute("CREATE TABLE t (id INT)")
    a.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(CatalogError):
        b.execute("INSERT INTO t VALUES (2)")
    assert b.sql("SELECT * FROM t").count() == 0
    a.execute("COMMIT")
    b.execute("INSERT INTO t VALUES (2)")
    assert sorted(ids(a, "SELECT id FROM t")) == [1, 2]


def test_frontend():
    assert rewrite("SELECT a FROM t ORDER BY a DESC, b LIMIT 3") == "SELECT a FROM t ORDER BY a DESC NULLS FIRST , b NULLS LAST LIMIT 3"
    assert "'a -> b'" in rewrite("SELECT 'a -> b' FROM t")
    assert rewrite("SELECT $1 + $12") == "SELECT :p1 + :p12"
    assert statements("SELECT ';'; SELECT 2;") == ["SELECT ';'", "SELECT 2"]
    assert classify("with a as (select 1) select * from a") == "SELECT" and classify("create unique index i on t (a)") == "CREATE INDEX"
    assert [workload(s) for s in ("SELECT a <-> '[1]' FROM t", "SELECT 1 FROM t WHERE b @@ 'x'", "SELECT count(*) FROM t", "SELECT a FROM t WHERE id = 1")] == ["vector", "search", "analytics", "oltp"]


def test_information_schema_match_and_arrow(q):
    assert q.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'parcel' ORDER BY ordinal_position").first()[0] == "id"
    assert q.sql("SELECT * FROM information_schema.tables").count() == 1
    assert [r[1] for r in q.sql("SELECT * FROM information_schema.table_constraints").collect()] == ["PRIMARY KEY"]
    assert q.to_arrow("SELECT id, grams FROM parcel WHERE depot = 8 ORDER BY id").column("grams").to_pylist() == [4100, 60]


def test_match_keeps_the_rest_of_the_query(db):
    db.execute("CREATE TABLE memo (id INT PRIMARY KEY, desk INT, body TEXT)")
    db.execute("INSERT INTO memo VALUES (1, 4, 'harbour harbour crane'), (2, 5, 'harbour'), (3, 4, 'a long memo that names the harbour once among other words'), (4, 4, 'crane')")
    got = db.sql("SELECT id AS memo_id FROM memo WHERE desk = 4 AND body MATCH 'harbour' TOP 5")
    assert got.columns == ["memo_id"] and [r[0] for r in got.collect()] == [1, 3]
    assert ids(db, "SELECT m.id FROM memo m WHERE m.body MATCH 'crane harbour' TOP 1") == [1]
    assert ids(db, "SELECT id FROM memo WHERE body MATCH 'harbour' TOP 2 ORDER BY id DESC") == [3, 2]
    assert "match_score" in db.sql("SELECT * FROM memo WHERE body MATCH 'crane' TOP 1").columns
    for bad in ("SELECT desk, count(*) FROM memo WHERE body MATCH 'x' TOP 1 GROUP BY desk", "SELECT 1 FROM memo a JOIN memo b ON a.id = b.id WHERE body MATCH 'x' TOP 1"):
        with pytest.raises(SqlError):
            db.sql(bad)


def test_definitions_follow_their_columns(db):
    db.execute("CREATE TABLE crew (id INT PRIMARY KEY, badge TEXT UNIQUE, age INT CHECK (age > 15), nick TEXT DEFAULT 'none')")
    db.execute("CREATE TABLE shift (id INT PRIMARY KEY, who INT REFERENCES crew (id) ON DELETE CASCADE)")
    db.execute("INSERT INTO crew (badge, age) VALUES ('k1', 20), ('k2', 30)")
    db.execute("INSERT INTO shift (who) VALUES (1), (2)")
    db.execute("CREATE INDEX by_badge ON crew (badge)")
    for old, new in (("id", "crew_id"), ("badge", "pass"), ("age", "years"), ("nick", "alias")):
        db.execute(f"ALTER TABLE crew RENAME COLUMN {old} TO {new}")
    db.execute("INSERT INTO crew (pass, years) VALUES ('k3', 40)")
    assert sorted(map(tuple, db.sql("SELECT crew_id, pass, alias FROM crew").collect())) == [(1, "k1", "none"), (2, "k2", "none"), (3, "k3", "none")]
    for bad in ("INSERT INTO crew (pass, years) VALUES ('k3', 41)", "INSERT INTO crew (pass, years) VALUES ('k4', 3)", "INSERT INTO shift (who) VALUES (77)", "ALTER TABLE crew DROP COLUMN crew_id"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("DELETE FROM crew WHERE crew_id = 1")
    assert ids(db, "SELECT who FROM shift") == [2]
    db.execute("ALTER TABLE crew DROP COLUMN pass")
    db.execute("ALTER TABLE crew DROP COLUMN years")
    db.execute("INSERT INTO crew (alias) VALUES ('x'), ('x')")
    assert db.table("crew").count() == 4 and db.sql("SHOW INDEX FROM crew").count() == 0


def test_definitions_are_transactional(db):
    db.execute("CREATE TABLE a (id INT PRIMARY KEY, x TEXT)")
    db.execute("INSERT INTO a VALUES (1, 'p')")
    db.execute("BEGIN")
    for statement in ("ALTER TABLE a ADD COLUMN z INT DEFAULT 3", "CREATE TABLE b (id INT)", "INSERT INTO b VALUES (8)", "CREATE UNIQUE INDEX u ON a (x)", "INSERT INTO a VALUES (2, 'q', 4)"):
        db.execute(statement)
    assert sorted(ids(db, "SELECT z FROM a")) == [3, 4] and ids(db, "SELECT id FROM b") == [8]
    db.execute("ROLLBACK")
    assert [tuple(r) for r in db.sql("SELECT * FROM a").collect()] == [(1, "p")] and db.catalog.tables() == ["a"] and not db.catalog.manifest("a")["indexes"]
    db.execute("BEGIN")
    db.execute("DROP TABLE a")
    with pytest.raises(CatalogError):
        db.table("a")
    db.execute("ROLLBACK")
    assert ids(db, "SELECT id FROM a") == [1]
    db.execute("BEGIN")
    db.execute("ALTER TABLE a ADD COLUMN z INT")
    db.execute("UPDATE a SET z = 9")
    db.execute("CREATE TABLE c (id INT)")
    n = db.catalog.next_lsn()
    db.execute("COMMIT")
    assert db.catalog.next_lsn() == n + 1 and [tuple(r) for r in db.sql("SELECT * FROM a").collect()] == [(1, "p", 9)] and db.catalog.tables() == ["a", "c"]


def test_keys_follow_through_many_tables(db):
    db.execute("CREATE TABLE a (id INT PRIMARY KEY)")
    db.execute("CREATE TABLE b (id INT PRIMARY KEY REFERENCES a (id) ON UPDATE CASCADE ON DELETE CASCADE)")
    db.execute("CREATE TABLE c (k INT PRIMARY KEY, b INT REFERENCES b (id) ON UPDATE CASCADE ON DELETE SET NULL)")
    db.execute("CREATE TABLE d (k INT PRIMARY KEY, b INT NOT NULL REFERENCES b (id) ON UPDATE SET NULL)")
    db.execute("CREATE TABLE tree (id INT PRIMARY KEY, up INT REFERENCES tree (id) ON DELETE CASCADE ON UPDATE CASCADE)")
    for t, rows in {"a": "(1), (2), (3)", "b": "(1), (2)", "c": "(1, 1), (2, 2), (3, NULL)", "tree": "(1, NULL), (2, 1), (3, 2), (4, NULL)"}.items():
        db.execute(f"INSERT INTO {t} VALUES {rows}")
    db.execute("UPDATE a SET id = id + 10 WHERE id < 3")
    assert sorted(ids(db, "SELECT id FROM b")) == [11, 12] and [tuple(r) for r in db.sql("SELECT k, b FROM c ORDER BY k").collect()] == [(1, 11), (2, 12), (3, None)]
    db.execute("INSERT INTO d VALUES (1, 11)")
    with pytest.raises(ConstraintError, match="null value"):
        db.execute("UPDATE a SET id = 21 WHERE id = 11")
    assert sorted(ids(db, "SELECT id FROM a")) == [3, 11, 12]
    db.execute("DELETE FROM a WHERE id = 12")
    assert ids(db, "SELECT id FROM b") == [11] and ids(db, "SELECT b FROM c WHERE k = 2") == [None]
    db.execute("UPDATE tree SET id = 100 WHERE id = 1")
    assert sorted(map(tuple, db.sql("SELECT id, coalesce(up, 0) FROM tree").collect())) == [(2, 100), (3, 2), (4, 0), (100, 0)]
    db.execute("DELETE FROM tree WHERE id = 100")
    assert ids(db, "SELECT id FROM tree") == [4]


def test_two_sessions_lose_no_rows(spark, tmp_path):
    a, b = (Session(spark, str(tmp_path / "shared")) for _ in range(2))
    a.execute("CREATE TABLE t (id INT)")
    a.execute("CREATE TABLE u (id INT)")
    a.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (10)")
    a.execute("INSERT INTO u VALUES (10)")
    b.execute("INSERT INTO t VALUES (20)")
    with pytest.raises(ConflictError):
        a.execute("COMMIT")
    assert ids(a, "SELECT id FROM t") == [20] and ids(b, "SELECT id FROM u") == []  # all or nothing
    a.execute("INSERT INTO t VALUES (10)")
    assert sorted(ids(b, "SELECT id FROM t")) == [10, 20]
    b.execute("CREATE TABLE s (id INT PRIMARY KEY, x INT)")
    for who, k in ((a, 1), (b, 2), (a, 3)):
        who.execute(f"INSERT INTO s (x) VALUES ({k})")
    assert sorted(map(tuple, a.sql("SELECT id, x FROM s").collect())) == [(1, 1), (2, 2), (3, 3)]


def test_a_crash_leaves_whole_tables(spark, tmp_path, monkeypatch):
    """A writer that dies before its record stands leaves nothing; after it, everything."""
    root = str(tmp_path / "crash")
    db = Session(spark, root)
    db.execute("CREATE TABLE t (id INT)")
    db.execute("CREATE TABLE u (id INT)")
    db.execute("INSERT INTO t VALUES (1)")

    def commit():
        db.execute("BEGIN")
        db.execute("INSERT INTO t VALUES (2)")
        db.execute("DELETE FROM u")
        db.execute("INSERT INTO u VALUES (3)")
        db.execute("COMMIT")

    create = db.catalog.files.create
    for step in ("rows", "before", "after"):
        with monkeypatch.context() as m:
            if step == "rows":
                m.setattr(db.catalog, "with_version", lambda *a, **k: 1 / 0)
            elif step == "before":
                m.setattr(db.catalog.files, "create", lambda *a: 1 / 0)
            else:
                m.setattr(db.catalog.files, "create", lambda *a: create(*a) and 1 / 0)
            with pytest.raises(ZeroDivisionError):
                commit()
        other = Session(spark, root)
        assert (sorted(ids(other, "SELECT id FROM t")), ids(other, "SELECT id FROM u")) == (([1, 2], [3]) if step == "after" else ([1], []))


def test_inserts_add_files_and_summaries_shorten_the_log(spark, tmp_path, monkeypatch):
    from lumenq import catalog as C

    monkeypatch.setattr(C, "SUMMARY_EVERY", 3)
    db = Session(spark, str(tmp_path / "log"))
    db.execute("CREATE TABLE t (id INT)")
    for k in range(4):
        db.execute(f"INSERT INTO t VALUES ({k})")
    assert [len(v["paths"]) for v in db.catalog.manifest("t")["versions"]] == [0, 1, 2, 3, 4]
    db.execute("DELETE FROM t WHERE id = 0")
    assert len(db.catalog.manifest("t")["versions"][-1]["paths"]) == 1
    other = Session(spark, str(tmp_path / "log"))
    assert other.catalog._n == 6 and sorted(ids(other, "SELECT id FROM t")) == [1, 2, 3]
    assert db.execute("VACUUM t").tag == "VACUUM 5" and sorted(ids(other, "SELECT id FROM t")) == [1, 2, 3]


def test_copy_is_checked_like_insert(db, tmp_path):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, note TEXT DEFAULT 'none', info JSONB, code UUID)")
    (tmp_path / "good.csv").write_text('info,code\n"{""b"": 1, ""a"": 2}",7D0C61AE-93F2-4B58-8A17-000000000001\n,\n')
    assert db.execute(f"COPY t FROM '{tmp_path}/good.csv'").tag == "COPY 2"
    assert sorted(map(tuple, db.sql("SELECT id, note, info, code FROM t WHERE info IS NOT NULL").collect())) in ([(k, "none", '{"a":2,"b":1}', "7d0c61ae-93f2-4b58-8a17-000000000001")] for k in (1, 2))
    assert sorted(ids(db, "SELECT id FROM t")) == [1, 2]
    for name, text in {"json.csv": "info\n{bad\n", "uuid.csv": "code\nnope\n", "key.csv": "id\n2\n"}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017  JSON and UUID faults come from the executors
            db.execute(f"COPY t FROM '{tmp_path}/{name}'")
    assert db.table("t").count() == 2
    assert db.execute("COPY t FROM STDIN", data=["7\tx\t{\"k\": 1}\t\\N", "\\."]).tag == "COPY 1"
    assert tuple(db.sql("SELECT id, note, info, code FROM t WHERE id = 7").first()) == (7, "x", '{"k":1}', None)
    with pytest.raises(SqlError):
        db.execute("COPY t FROM STDIN")


def test_backup_and_restore(spark, q, tmp_path):
    from lumenq.sources import backup as B

    full, diff, late = (str(tmp_path / x) for x in ("full", "diff", "late"))
    B.backup(q.catalog, full)
    q.execute("DELETE FROM parcel WHERE depot = 9")
    q.execute("UPDATE parcel SET grams = 1 WHERE id = 14")
    assert B.backup(q.catalog, diff, full)["tables"]["parcel"]["parts"]["new"][0] == 1
    assert B.verify(q.catalog, full) == [] and B.predict(q.catalog)["parcel"] > 0
    want = [(11, 250), (12, 900), (13, 4100), (14, 1)]
    other = Session(spark, str(tmp_path / "other"))
    assert B.restore(other.catalog, [full, diff]) == ["parcel"]
    assert sorted(map(tuple, other.sql("SELECT id, grams FROM parcel").collect())) == want
    # Without the base's version a differential backup holds the whole table.
    q.execute("ALTER TABLE parcel ADD COLUMN extra INT")
    q.execute("VACUUM parcel")
    assert list(B.backup(q.catalog, late, full)["tables"]["parcel"]["parts"]) == ["full"]
    third = Session(spark, str(tmp_path / "third"))
    B.restore(third.catalog, [full, late])
    assert sorted(map(tuple, third.sql("SELECT id, grams FROM parcel").collect())) == want and "extra" in third.table("parcel").columns
    spark.range(1).write.mode("overwrite").parquet(f"{full}/parcel/full")
    assert B.verify(q.catalog, full)


def test_dump_import(db):
    from lumenq.sources.copying import dump_sql
    from lumenq.sources.pgdump import import_dump

    script = r"""--
SET statement_timeout = 0;
CREATE TABLE public.people (
    id integer NOT NULL,
    name character varying(20),
    born timestamp without time zone
);
ALTER TABLE public.people OWNER TO me;
COPY public.people (id, name, born) FROM stdin;
1<tab>Ann\tB<tab>2020-01-02 03:04:05
2<tab>\N<tab>\N
\.

INSERT INTO public.people VALUES (3, 'O''Neil; x', NULL);
""".replace("<tab>", chr(9))
    r = import_dump(db, script)
    assert r.tables == ["people"] and r.rows == 3
    assert [tuple(x) for x in db.sql("SELECT id, name FROM people ORDER BY id").collect()][1:] == [(2, None), (3, "O'Neil; x")]
    assert "INSERT INTO people (id, name, born) VALUES (3, 'O''Neil; x', NULL);" in [x[0] for x in dump_sql(db.table("people"), "people").collect()]
