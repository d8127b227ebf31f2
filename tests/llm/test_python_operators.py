"""Chat templates, licence notices, toxicity and page extraction."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenq.llm import chat_format as C
from lumenq.llm import html_extract as H
from lumenq.llm import license_scan as L
from lumenq.llm import toxicity as T

TEXT = st.text(st.sampled_from("a\\<|>\n im_start end é\U0001F600"), max_size=30)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    write = C.compile_template(C.CHATML).turn
    parts = [C.render(write, r, t) for r, t in turns]
    assert C.read_back("".join(p for p, _ in parts)) == turns
    for (out, spans), (role, text) in zip(parts, turns, strict=True):
        assert [C.unescape(out[a:b]) for a, b in spans] == ([text] if role == "assistant" else [])


def test_templates_are_folded_and_closed():
    tree = C.parse("a{% if 'x' == 'y' %}no{% else %}b{% endif %}{{ 'c' + 'd' }}{% for message in messages %}{{ message.text }}{% endfor %}")
    assert tree[0] == C.Const("abcd") and len(tree) == 2
    for bad in ("{% for message in messages %}", "{{ __import__('os') }}", "{{ message.__class__ }}{% for message in messages %}{% endfor %}", "{% for message in messages %}{{ message.text | run }}{% endfor %}", "no loop"):
        with pytest.raises(C.TemplateError):
            C.compile_template(bad)
    t = C.compile_template("<s>{% for message in messages %}{% if message.role == 'user' and not message.text == '' %}U{% elif message.role != 'user' %}A{% endif %}{% endfor %}</s>")
    assert C.render(t.before)[0] == "<s>" and [C.render(t.turn, r, x)[0] for r, x in (("user", "x"), ("user", ""), ("bot", ""))] == ["U", "", "A"]


def test_template_language():
    one = lambda t, *a, **k: C.render(C.compile_template("{% for message in messages %}" + t + "{% endfor %}").turn, *a, **k)[0]
    assert one("{% set who = message['role'] | upper %}{{ who + ': ' + message.text[1:-1] }}", "bot", "xhix") == "BOT: hi"
    assert one("{% if loop.first %}^{% endif %}{{ loop.index | text }}{% if loop.last %}${% endif %}", first=False, last=True, index=3) == "3$"
    assert one("{{ 'abcdef'[2:4] + ((1 + 2) | text) }}") == "cd3" and one("{{ message.role | line }}", "a\nb\\n\r") == "a\\nb\\\\n\\r"
    assert C.parse("{% set a = 'x' %}{{ a }}{% for message in messages %}{% endfor %}") and C.unescape(C.line("a\nb\\n\r<|")) == "a\nb\\n\r<|"
    for bad in ("{{ who }}", "{% set loop = 'x' %}", "{% set a %}", "{{ message['mood'] }}", "{{ 'a' + 1 }}", "{{ message.text[1] }}", "{{ loop.length }}"):
        with pytest.raises(C.TemplateError):
            one(bad)
    for bad in ("{{ loop.first | text }}{% for message in messages %}{% endfor %}", "{% for message in messages %}{% set a = 'x' %}{% endfor %}{{ a }}"):
        with pytest.raises(C.TemplateError):
            C.compile_template(bad)
    with pytest.raises(C.TemplateError):
        one("{{ loop.index }}")


def test_parts_around_the_loop_are_rendered(spark):
    rows = [(c, t, r, x, 1, "k") for c, n in ((1, 3), (2, 1)) for t, r, x in [(0, "user", "q"), (1, "assistant", "a"), (2, "user", None)][:n]]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss int, formatted string").repartition(3)
    got = C.format_turns(df, "PRE{% for message in messages %}{{ loop.index | text }}{% generation %}{{ message.text }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}POST")
    told = {}
    for r in sorted(got.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        told.setdefault(r["conv_id"], []).append((r["formatted"], [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]))
    assert told == {1: [("PRE1q,", ["q"]), ("2a,", ["a"]), ("3POST", [""])], 2: [("PRE1qPOST", ["q"])]}
    assert C.format_turns(df.limit(0)).count() == 0
    none = C.digests(C.format_turns(spark.createDataFrame([(None, 1, "a\nb", "x" * 10**6), (None, None, None, None)], "conv_id long, turn int, role string, text string"))).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in none] == [(None, 2)]


def test_chat_digests(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["x<|im_end|>\n", None, "", "\\<|", "long " * 50])) for c in (1, 2, 7) for t in range(5)] + [(3, None, "user", "n"), (2, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in C.digests(C.format_turns(df)).collect()}
    for conv in (1, 7, 3):
        mine = [(r or "", x or "") for c, _, r, x in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        loss = "".join(x for r, x in mine if r == "assistant")
        want = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == want
    assert got[2]["n_turns"] == 6 and C.digests(C.format_turns(df.limit(0))).count() == 0


def lcs(a, b):
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1, j + 1] = m[i, j] + 1 if x == y else max(m[i, j + 1], m[i + 1, j])
    return m[-1, -1]


@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_is_a_common_subsequence(a, b):
    got = L.align(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert len(got) <= lcs(a, b) and (len(got) > 0) == (lcs(a, b) > 0)
    if a == b:
        assert len(got) == len(a)


def test_notices(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    cases = [
        (f"{noise(300)} {mit} {noise(5)} {gpl}", ["MIT", "GPL-3.0"]), (f"{mit}\n{mit} {mit}", ["MIT"] * 3), (f"{noise(9)} THIS work is now licensed under the GNU general public license version 3 {noise(2)}", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("", []), (None, []), ("the public under license", []), (noise(4000), []), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], "doc_id long, text string, notices string")
    got = {r["doc_id"]: [n["license"] for n in r["notices"]] for r in L.scan_licenses(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_toxicity_holds_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        ws = [f"w{rng.randrange(2000)}" .replace("w", "word" + "abcdefghij"[rng.randrange(10)]) for _ in range(30)]
        bad = i % 8 == 0
        if bad:
            ws[rng.randrange(30)] = rng.choice(["grot", "vilething", "nastyish", "scumly"]) + rng.choice(["", "er"])
        rows.append((i, " ".join(ws), 0.5))
        labels.append((i, 1, int(bad)))
    df = spark.createDataFrame([*rows, (5000, None, 0.1), (5001, "", 0.1)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    w, b = T.fit(df, lab)
    got = {r["doc_id"]: r["score"] for r in T.score_rows(df, w, b).collect()}
    out = [i for i, *_ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 1202 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == (i % 8 == 0) for i in out) >= 0.97 * len(out)
    assert got[5000] == got[5001] < 0.3
    assert T.score_rows(df, *T.fit(df, lab.limit(0))).where("score > 0.3").count() == 0


def page(body, nav="<nav><ul><li><a href='/'>Home</a></li></ul></nav>"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{nav}<!-- x -->{body}<footer>&copy; me</footer></body></html>"


def test_main_text():
    cases = {
        page("<article><h1>T &amp; t</h1><p>a  b\n c<p><b>d<br>e</b><ul><li>one<li>two</ul></article>"): "T & t\na b c\nd e\none\ntwo",
        page("<div class='ad'>buy</div><main><p>x</p><aside>side</aside><div class='cookie-notice'>ok?</div><section id='comments'><p>me too</p></section><form>f<input></form></main>"): "x",
        page("<div><p>plain page</p><p>second &lt;p&gt;</p></div><div class='sidebar'>s</div>"): "plain page\nsecond <p>",
        page("<div class='header'>no</div><article><div class='article-header'><h1>T</h1></div><p>x</p><div class='share-bar'>s</div></article>"): "T\nx",
        "no markup &eacute;": "no markup é", "": "", "<p>open <i>and <b>never closed": "open and never closed", "<article><p>cut <": "cut <",
    }
    for html, want in cases.items():
        assert H.main_text(html) == want, html
    assert H.main_text(None) == ""


def test_style_tree_removes_template_branches(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div class='body'><p>text number {i}</p></div><div class='promo2x'>Same words everywhere</div>"), "n") for i in range(20)]
    rows += [(100, "http://other.example/", page("<div class='promo2x'>Same words everywhere</div>"), "n"), (101, None, None, "n"), rows[0]]
    rows += [(200 + i, f"http://copies.example/{i}", page("<article><p>published twice</p></article>"), "n") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got[3] == "text number 3" and got[100] == "Same words everywhere" and got[101] == "" and got[205] == "published twice"
    assert H.extract(df).count() == len(rows) and H.extract(df.limit(0)).count() == 0


def test_style_tree_judges_marked_articles(spark):
    said = "<div class='promo2x'><p>same words on every page</p></div>"
    rows = [(i, f"http://h.example/{i}", page(f"<article><h1>Title {i}</h1><p>text number {i}</p>{said}<p>Write to us.</p></article>")) for i in range(20)]
    rows += [(100 + i, f"http://copies.example/{i}", page(f"<article><p>published twice</p>{said}</article>")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: f"Title {i}\ntext number {i}" for i in range(20)} | {100 + i: "published twice\nsame words on every page" for i in range(12)}


def test_wrappers_do_not_drop_a_marked_article():
    for body in ("<div class='has-sidebar'>{}<div class='sidebar'>s</div></div>", "<div class='content-sidebar-wrap'>{}</div>", "<form action='/'>{}<p>state</p></form>"):
        for mark in ("article", "main"):
            assert H.main_text(page(body.format(f"<{mark}><p>x</p></{mark}>"))) == "x", body
    assert H.main_text(page("<main><p>x</p></main><aside><article><p>teaser</p></article></aside>")) == "x"
    assert H.main_text(page("<div hidden><article><p>x</p></article></div><p>y</p>")) == "y"


def test_content_overrules_ambiguous_words(spark):
    body = "<article><p>text {0}</p><div class='legal-text'><p>clause {0}</p></div><div id='related-work'><p>as {0} shows</p></div><div class='notice'>note {0}</div><div class='cookie-notice'>ok {0}</div><div class='notice'>of the site</div><div class='ad'>buy {0}</div></article>"
    body = body.replace("<div class='notice'>of the site</div>", "<div class='notice small'>of the site</div>")
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(body.format(i))) for i in range(20)] + [(50, "http://one.example/", page(body.format(50)))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: f"text {i}\nclause {i}\nas {i} shows\nnote {i}" for i in range(20)} | {50: "text 50"}


def test_notices_of_related_licences():
    scan = lambda t: [x[2] for x in L.Scanner().scan(t)]
    for name in L.TEMPLATES:
        for form in L.TEMPLATES[name]:
            assert scan(f"some words before. {form} and some after") == [name], form
    bsd2, bsd3 = L.TEMPLATES["BSD-2-Clause"][-1], L.TEMPLATES["BSD-3-Clause"][-1]
    assert scan(bsd2) == ["BSD-2-Clause"] and scan(f"{bsd2} x {bsd3}") == ["BSD-2-Clause", "BSD-3-Clause"]
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    assert scan(agpl) == ["AGPL-3.0"] and scan(lgpl) == ["LGPL-2.1"] and scan(agpl.replace("Affero ", "")) == ["GPL-3.0"]
    assert scan("Released under the ISC License. Released under the MIT License.") == ["ISC", "MIT"]
    assert scan("It is licensed under the same license.") == [] == scan("Licensed under X BY 4.0.")
    for t in ("Released under the terms of the MIT license", "Distributed under the MIT License", "released under MIT license"):
        assert scan(t) == ["MIT"], t
    first, end, name, _ = L.Scanner().scan(f"a b c {L.TEMPLATES['MIT'][-1]} d e")[0]
    assert (first, end, name) == (3, 3 + len(L.normal(L.TEMPLATES["MIT"][-1])), "MIT")


def test_broken_markup_takes_linear_time():
    import time

    from lumenq.llm.html_extract import main_text

    began = time.perf_counter()
    for page in ("<a '" * 200_000, "<a \"" * 200_000 + ">", "<span class=ad>" * 60_000, "<p>x</p>" + "<div title='" * 100_000, "<" * 300_000, "<!-- " * 100_000, "<b hidden>" * 40_000 + "</b>" * 40_000):
        main_text(page)
    assert time.perf_counter() - began < 20
    assert main_text("<p>one</p><p title='never closed>two</p><p>three</p>").split("\n")[0] == "one" and "three" in main_text("<p>one</p><p title='never closed>two</p><p>three</p>")
    assert main_text("<p>a <span hidden>b <span>c</span> d</span> e</p>") == "a e"
    assert main_text("<p title='x>y'>in</p>") == "in" and main_text("<p>end <a href") == "end <a href"
