"""Near duplicates and repeated passages against brute force."""

import hashlib
import random


from lumenq.llm import jaccard_join as J
from lumenq.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, extra string"


def brute_components(rows):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, len(sets[i]), find(i)) for i in ids}


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def mutate(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = rng.randrange(len(ws))
        kind = rng.randrange(3)
        if kind == 0:
            ws[k] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            del ws[k]
        else:
            ws.insert(k, f"y{rng.randrange(10**6)}")
    return ws


def corpus(seed, copies=150):
    """A large group of near copies that are not all alike, small groups, shared passages, short and odd texts."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 70)
    texts = [" ".join(mutate(rng, base, rng.randrange(0, 9))) for _ in range(copies)]
    texts += [" ".join(words(rng, rng.randrange(40, 90)) + passage + words(rng, rng.randrange(5, 60))) for _ in range(60)]
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 23, 30, 31, 45, 200):
        ws = words(rng, n)
        texts += [" ".join(mutate(rng, ws, k % 3)) if n > 3 else " ".join(ws) for k in range(6)]
    texts += ["", None, "  \n", "A b C d E f", "a B c D e F", "ß É", "one\x0btwo\x0cthree", *texts[:25]]
    rng.shuffle(texts)
    return [(i, t, "e") for i, t in enumerate(texts)]


def test_components(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {tuple(r) for r in J.group(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        assert got == brute_components(rows)


def test_hot_keys_do_not_change_results(spark, monkeypatch):
    """Frequencies only choose where to look."""
    rows = corpus(3, 60)
    want = brute_components(rows)
    for hot in (1, 10**9):
        monkeypatch.setattr(J, "HOT_FROM", hot)
        assert {tuple(r) for r in J.group(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_sets_without_allocation_are_joined_by_elements(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 0)  # no one-deletion neighbours: small sets that cluster can't be allocated
    rows = corpus(4, 20)
    assert {tuple(r) for r in J.group(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_components(rows)


def test_empty_and_repeated(spark):
    assert J.group(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, None, ""), (None, "a b c d e f", "")]
    got = sorted(J.group(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, 1)]


def brute_substrings(rows):
    first, out = {}, set()
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = [a for a, g in zip(w, gone) if not g]
        out.add((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substrings(spark, monkeypatch):
    rng = random.Random(5)
    base, passage, loop = words(rng, 300), words(rng, 90, 30), ["la"] * 200
    texts = [" ".join(mutate(rng, base, rng.randrange(6))) for _ in range(30)]
    texts += [" ".join(words(rng, 30) + passage[a : a + n] + words(rng, 30)) for a, n in [(0, 49), (0, 50), (1, 50), (0, 90), (20, 60), (40, 50)] * 3]
    texts += [" ".join(loop), " ".join(loop[:120]), " ".join(loop[:49]), "", None, " ".join(base), " ".join(base), " ".join(base[:50]), " ".join(base).upper()]
    rng.shuffle(texts)
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    for heavy in (2, 10**9):
        monkeypatch.setattr(D, "HEAVY", heavy)
        df = D.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4))
        got = {(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()}
        assert got == brute_substrings(rows)
    assert D.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_substrings_of_odd_tables(spark):
    """Very long texts, nulls, repeated rows and further columns with the operator's own names."""
    rng = random.Random(15)
    passage = words(rng, 70)
    long_ = words(rng, 30_000)
    long_[20_000:20_000] = passage
    rows = [(1, " ".join(words(rng, 20) + passage)), (2, " ".join(long_)), (3, " ".join(long_[10_000:12_000])), (3, " ".join(long_[10_000:12_000])), (4, None), (5, ""), (6, "la " * 9_000), (7, "la " * 60)]
    df = spark.createDataFrame([(i, t, 1, "x", [1], True) for i, t in rows], "doc_id long, text string, hi int, group string, ranges array<int>, whole boolean")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in D.deduplicate(df).collect())
    want = brute_substrings([r for k, r in enumerate(rows) if k != 3])
    assert set(got) == want and len(got) == len(rows)
    none = spark.createDataFrame([(None, rows[0][1]), (9, rows[0][1])], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in D.deduplicate(none).collect()) == [(0, 0), (9, 0)]


def test_subtrees_find_the_smallest_document_of_each_window():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    depth = D.LENGTH - D.GRAM
    base = [rng.choice("abc") for _ in range(92)]
    group, doc, n, off, texts = [], [], [], [], []
    for k in range(60):
        lo, hi = sorted((rng.randrange(depth + 1), rng.randrange(depth + 1)))  # windows start hi..lo words before the suffix
        ws = list(base)
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(92)] = rng.choice("abcd")
        group.append(k % 2)
        doc.append(rng.randrange(40))
        n.append(hi - lo + 1)
        off.append(hi)
        texts.append(" ".join(ws[depth - hi : depth - lo + D.LENGTH]).encode())
    got = D.smallest(*(np.array(x) for x in (group, doc, n, off)), pa.array(texts, pa.binary()))
    for a in range(60):
        for j in range(n[a]):
            d = off[a] - j
            w = texts[a].split()[j : j + D.LENGTH]
            same = [doc[b] for b in range(60) if group[b] == group[a] and 0 <= off[b] - d < n[b] and texts[b].split()[off[b] - d : off[b] - d + D.LENGTH] == w]
            assert got[a, j] == min(same)


def test_sliding_anchors():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    w = D.LENGTH - D.GRAM + 1
    assert D.anchors(x).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]


def test_allocation_reaches_its_sum():
    import numpy as np

    rng = random.Random(6)
    for _ in range(200):
        size = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))])
        need = rng.randrange(1, 16)
        got = J.allocate(size, np.array([rng.randrange(4) for _ in size]), need)
        if got is None:
            assert len(size) + (size > 1).sum() < need
        else:
            assert len(got[0]) + len(got[1]) >= min(need, len(got[0]) + len(got[1])) and len(got[0]) + len(got[1]) == need or len(got[0]) == need
            assert (size[got[1]] > 1).all()




def test_components_of_graphs(spark):
    from lumenq.llm.graph import components

    rng = random.Random(8)
    n = 400
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, n), rng.randrange(200, n)) for _ in range(90)] + [(5, 5), (300, 150)]
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_leave_shared_nodes(spark, monkeypatch):
    """Different sets with one hash get nodes of their own (the hash is narrowed to force clashes)."""
    rng = random.Random(8)
    texts = [" ".join(words(rng, 12)) for _ in range(40)]
    rows = [(i, t, "e") for i, t in enumerate(texts + texts[:5])]
    plain = J.node_of

    def narrow(h, seed, moved=frozenset()):
        a, b = plain(h, seed)
        for x in (a % 16, a):
            if x not in moved:
                return x, b
        raise AssertionError

    monkeypatch.setattr(J, "node_of", narrow)
    nodes, _ = J.join(spark.createDataFrame(rows, SCHEMA))
    assert nodes.select("node").distinct().count() == 40
    a, b = plain(np_array([5, 9, 12]), 1)
    moved = plain(np_array([5, 9, 12]), 1, frozenset([a]))
    assert moved[0] != a and moved[1] == b and plain(np_array([5, 9, 12]), 1, frozenset([a, moved[0]]))[0] not in (a, moved[0])


def np_array(x):
    import numpy as np

    return np.array(x, np.uint64)


def test_jaccard_of_odd_tables(spark):
    """Very long texts, nulls, repeated rows and further columns with the operator's own names."""
    rng = random.Random(18)
    long_ = words(rng, 25_000, 10**6)
    rows = [(1, " ".join(long_)), (2, " ".join(mutate(rng, long_, 50))), (3, " ".join(long_[:9_000])), (4, None), (5, " \t\n "), (6, "a b"), (7, "A  b"), (7, "A  b")]
    df = spark.createDataFrame([(i, t, 1, "x", [1]) for i, t in rows], "doc_id long, text string, node int, key string, a array<int>")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.group(df).collect())
    assert set(got) == brute_components(rows) and len(got) == len(rows)


def test_words_are_hashed_by_their_bytes(monkeypatch):
    known = J._Hasher(1)
    text = "a  bb\tccc\nbb a \x0b\x0c\r dd\u00a0dd é \x1c x" + " zz" * 50
    h = known.words(text.encode())
    found = text.encode().split()
    assert len(h) == len(found) and len(set(h.tolist())) == len(set(found))
    assert {(a, b) for a, b in zip(found, h.tolist(), strict=True)} == {(a, known.words(a).tolist()[0]) for a in found}
    monkeypatch.setattr(J, "PART", 7)
    assert known.words(text.encode()).tolist() == h.tolist() and known.words(b" \n ").tolist() == [] and known.words(b"").tolist() == []
