"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns; and brute force for what has no SQL."""

import random
import time
import zlib

import numpy as np
import pytest

from lumenq.llm import html_extract as H
from lumenq.llm import license_scan as L
from lumenq.llm import quality_rules as Q
from lumenq.llm import toxicity as T


def lcs(a, b):
    now = [0] * (len(b) + 1)
    for x in a:
        before, now = now, [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
    return now[-1]


# op3
@pytest.mark.parametrize("seed", range(4))
def test_planted_notices_are_found_each_time(seed):
    rng = random.Random(seed)
    forms = [(name, t) for name, many in L.TEMPLATES.items() for t in many]
    parts, want = [], []
    for _ in range(25):
        name, t = rng.choice(forms)
        parts.append(t)
        want.append(name)
        parts.append(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 30]))))
    text = " ".join(parts)
    got = L.Scanner().scan(text)
    assert [x[2] for x in got] == want
    ws = L.normal(text)
    for first, end, name, share in got:  # what is reported is there: by the plain longest common subsequence
        assert any(lcs(ws[first:end], f) >= share * len(f) - 1e-9 for f in map(L.normal, L.TEMPLATES[name]))


def test_close_copies_with_changes_are_found_each_time():
    rng = random.Random(9)
    for name in ("MIT", "BSD-3-Clause", "Apache-2.0"):
        form = L.TEMPLATES[name][-1].split()
        copies = []
        for _ in range(20):
            at = rng.randrange(len(form))
            keep = L.normal(form[at]) and L.normal(form[at])[0] in L.REQUIRED.get(name, "").split()
            copies += form if keep else [*form[:at], "changed", *form[at + 1 :]]
        assert [x[2] for x in L.Scanner().scan(" ".join(copies))] == [name] * 20


def test_many_notices_take_linear_time():
    form = L.TEMPLATES["MIT"][-1]
    began = time.perf_counter()
    assert len(L.Scanner().scan(f"{form} " * 2000)) == 2000
    assert len(L.Scanner().scan("Released under the MIT License. " * 20_000)) == 20_000
    L.Scanner().scan("license mit permission redistribution " * 50_000)
    assert time.perf_counter() - began < 30


def test_licences_of_odd_tables(spark):
    mit = "Released under the MIT License."
    rows = [(1, mit), (1, mit), (None, mit), (2, None), (3, ""), (4, f"{'x ' * 200_000}{mit}")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, notices string, license int")
    got = sorted(((r["doc_id"] or 0, [(n["license"], n["first"]) for n in r["notices"]]) for r in L.scan_licenses(df).collect()), key=str)
    assert got == [(0, [("MIT", 0)]), (1, [("MIT", 0)]), (1, [("MIT", 0)]), (2, []), (3, []), (4, [("MIT", 200_000)])]
    assert L.scan_licenses(df.limit(0)).count() == 0


# op1
def test_quality_of_odd_tables(spark):
    """Repeated rows are judged each; further columns may be named like the operator's own."""
    good, bad = " ".join(f"word{i}" for i in range(80)), " ".join(["spam # $"] * 40)
    rows = [(i, good if i % 2 else bad, 1.0, "x") for i in range(60)] + [(1, good, 1.0, "x"), (None, good, 2.0, None), (100, None, 0.0, "x"), (101, "", 0.0, "x"), (102, "a " * 60_000, 0.0, "x"), (103, good + " u" * 150_000, 0.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stats double, kept string")
    labels = spark.createDataFrame([(i, i % 2, 0, 7) for i in range(60)] + [(None, 1, 0, 7), (1, None, 0, 7), (999, 0, 0, 7)], "doc_id long, quality int, toxic int, n_words int")
    out = Q.judge(df, labels)
    assert out.columns == [*df.columns, "__judged"]
    got = [(r["doc_id"], r["stats"], r["__judged"]["n_words"], r["__judged"]["kept"]) for r in out.collect()]
    assert len(got) == len(rows) and [x for x in got if x[0] == 1] == [(1, 1.0, 80, True)] * 2 and (None, 2.0, 80, True) in got
    assert {x[0]: x[2:] for x in got if x[0] is not None and x[0] >= 100} == {100: (0, False), 101: (0, False), 102: (60_000, False), 103: (150_080, False)}
    assert not any(x[3] for x in got if x[0] is not None and x[0] < 60 and x[0] % 2 == 0)
    assert Q.judge(df.limit(0), labels).count() == 0 and Q.judge(df, labels.limit(0)).where("__judged.kept").count() == 32


# op7
def test_toxicity_of_odd_tables(spark):
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["amber", "brook", "cedar", "dune", "ember", "fjord"]) for _ in range(20))
    rows = [(i, f"{clean()} grotling {clean()}" if i % 5 == 0 else clean(), 0.5, 1, "x") for i in range(300)]
    odd = [(None, "grotling", 0.1, 1, "x"), (0, rows[0][1], 0.2, 1, "x"), (1000, None, 0.3, 1, "x"), (1001, f"{'amber ' * 200_000}grotling", 0.4, 1, "x"), (1002, "amber " * 200_000, 0.4, 1, "x")]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, score double, toxic int, voter string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    w, b = T.fit(df, labels)
    got = [(r["doc_id"], r["score"]) for r in T.score_rows(df, w, b).collect()]
    assert len(got) == len(rows) + len(odd)
    told = dict(got)
    assert told[None] >= 0.3 and told[1001] >= 0.3 and told[1000] < 0.3 and told[1002] < 0.3 and len([x for x in got if x[0] == 0]) == 2
    assert all((s >= 0.3) == (i % 5 == 0) for i, s in got if i is not None and i < 300)
    assert T.fit(df.limit(0), labels)[0] == {} and T.score_rows(df.limit(0), w, b).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = [(i, "a b grotling c" if i % 3 == 0 else "a b c d") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = lambda flip: spark.createDataFrame([(i, 1, int((i % 3 == 0) != (flip and out(i)))) for i in range(200)], "doc_id long, quality int, toxic int")
    assert T.fit(df, labels(False)) == T.fit(df, labels(True))


def test_label_model_against_its_own_makings():
    """Votes drawn from known rates, labels with known noise: the model finds rates and truth; a doubled voter counts half.

    An abstaining voter is no witness for "clean", so rates lie up to 0.1 farther apart than those drawn from, and the labels are trusted a little less.
    """
    rng = np.random.default_rng(4)
    n = 6000
    truth = rng.random(n) < 0.3
    rates = np.array([[0.02, 0.10, 0.01], [0.60, 0.40, 0.30]])
    votes = (rng.random((n, 3)) < rates[truth.astype(int)]).astype(float)
    given = np.where(rng.random(n) < 0.1, ~truth, truth).astype(float)
    post, rate, weight, trust = T.label_model(votes, given)
    assert np.abs(rate - rates).max() < 0.12 and abs(trust - 0.9) < 0.08 and (weight > 0.9).all()
    assert ((post > 0.5) == truth).mean() > (given == truth).mean()
    _, _, doubled, _ = T.label_model(np.hstack([votes, votes[:, :1]]), given)
    assert doubled[0] == pytest.approx(doubled[3]) and doubled[0] <= 0.55 and (doubled[1:3] > 0.9).all()


def test_regression_meets_its_gradient():
    """At the optimum the penalised gradient is nought, or points below the bound of a weight that is nought."""
    rng = np.random.default_rng(6)
    x = (rng.random((400, 5)) < 0.3).astype(float)
    y = 1 / (1 + np.exp(-(x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5]) - 1)))
    w, b = T.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = x.T @ (p - y) + 0.02 * w
    assert (w >= 0).all() and abs((p - y).sum()) < 1e-2 and (np.abs(slope[w > 1e-6]) < 1e-2).all() and (slope[w <= 1e-6] > -1e-2).all()


# op9
def test_pages_of_odd_tables(spark):
    long_ = "<article>" + "".join(f"<p>block {i}</p>" for i in range(40_000)) + "</article>"
    rows = [(1, "http://a.example/", "<p>x</p>"), (1, "http://a.example/", "<p>x</p>"), (None, None, None), (2, None, ""), (3, "not a url", "<p>y &amp; z</p>"), (4, "http://a.example/l", long_)]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], "page_id long, url string, html string, text string, n_chars int, host string")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in H.extract(df).collect()), key=str)
    want = [(1, "http://a.example/", "x", 1)] * 2 + [(0, None, "", 0), (2, None, "", 0), (3, "not a url", "y & z", 5)]
    body = "\n".join(f"block {i}" for i in range(40_000))
    assert got == sorted([*want, (4, "http://a.example/l", body, len(body))], key=str)
    assert H.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and H.extract(df.limit(0)).count() == 0


def test_importance_against_brute_force(spark):
    """Presentation and content importance of each node, from the blocks of all pages in plain Python."""
    rng = random.Random(8)
    pages = [
        (i, f"http://h{i % 2}.example/{i}", f"<div class='a'><p>text {rng.randrange(6)}</p><p><a href='/'>more</a> words</p></div><div class='b'><p>same</p></div>" + ("<div class='c'><p><a href='/x'>go</a></p></div>" if i % 3 else ""))
        for i in range(30)
    ]
    tree = {(r["host"], r["path"]): r for r in H.style_tree(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    known: dict = {}
    for i, _, html in pages:
        for path, text, _, _, linked in H.judged(html):
            known.setdefault((f"h{i % 2}.example", path), {}).setdefault(i, []).append((text, linked))
    assert set(tree) == set(known)
    for key, by_page in known.items():
        n = len(by_page)
        whole = [tuple(t for t, _ in x) for x in by_page.values()]
        share = np.array([whole.count(x) for x in set(whole)]) / n
        content = float(-(share * np.log(share)).sum() / np.log(n)) if n > 1 else 1.0
        chars, linked = sum(len(t) for x in by_page.values() for t, _ in x), sum(m for x in by_page.values() for _, m in x)
        r = tree[key]
        assert r["n_pages"] == n and r["content"] == pytest.approx(content, abs=1e-9) and r["presentation"] == pytest.approx(1 - linked / max(chars, 1))
