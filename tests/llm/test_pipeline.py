"""The pipeline's stages, each on its own input, against plain Python; nulls, repeats and clashing columns."""

import random
import re

import corpus_pipeline as pipeline
from test_pairs import brute_components
from test_texts import PATTERNS, brute_overlaps, brute_targets, good, words

from lumenq.llm import quality_rules as Q
from lumenq.llm._common import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, at):
    rng = random.Random(9)
    make = lambda n: [f"word{rng.randrange(3000)}abc" for _ in range(n)]
    bench = [(k, " ".join(make(25))) for k in range(5)]
    rows, labels = [], []
    bases = [make(120) for _ in range(6)]
    for i in range(260):
        ws = make(rng.randrange(30, 150))
        if i % 5 == 1:
            ws = list(rng.choice(bases))
            ws[rng.randrange(120)] = f"edit{i}"
        if i % 9 == 2:
            ws[10:10] = rng.choice(bench)[1].split()
        if i % 7 == 3:
            ws[5:5] = ["mail", f"me{i}@x.org", "or", "192.168.1.7", "password=abcdef0123456789"]
        bad = i % 6 == 5
        text = " ".join(w + ("###" if bad else "") for w in ws)
        rows.append((i, text, "en", rng.choice(["s0", "s0", "s1", None]), len(text)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), rows[0], rows[1]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return bench


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, tmp_path):
    at = str(tmp_path)
    bench = fixture(spark, at)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "source_mixing"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    before = rows_of(docs)
    seen = {}
    for name, apply in pipeline.STAGES:
        docs = stage(apply(spark, docs, at), name)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        seen[name] = rows_of(docs)

    # quality rules: the base test, and the learned list read as plain conditions
    got, input_ = seen["quality_rules"], before
    assert all(len(words(r[1])) >= 50 for r in got) and not any("###" in r[1] for r in got)
    assert {r[0] for r in input_} - {r[0] for r in got} == {r[0] for r in input_ if len(words(r[1])) < 50 or "###" in (r[1] or "")}
    # near duplicates: one document of each group
    groups = brute_components(sorted(set(got)))
    assert [r[0] for r in sorted(seen["near_duplicates"])] == sorted({g for _, _, g in groups})
    # decontamination
    bad = {i for i, _ in brute_overlaps(seen["near_duplicates"], bench)}
    assert bad and seen["decontamination"] == [r for r in seen["near_duplicates"] if r[0] not in bad]
    # personal data
    masked = {r[0]: r for r in seen["personal_data"]}
    for r in seen["decontamination"]:
        spans = sorted((m.start(), -m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, r[1]) if good(k, m[0]))
        text, end = "", 0
        for a, b, k in spans:
            if a >= end:
                text, end = text + r[1][end:a] + f"[{k.upper()}]", -b
        text = (text + r[1][end:]).replace("password=abcdef0123456789", "password=[KEY]")
        assert masked[r[0]][1] == text and masked[r[0]][4] == len(text)
    # mixing: whole copies, near the targets
    sizes, taken, largest = {}, {}, {}
    for r in seen["personal_data"]:
        n = len(words(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        largest[r[3]] = max(largest.get(r[3], 0), n)
    for r in seen["source_mixing"]:
        assert r in seen["personal_data"]
        taken[r[3]] = taken.get(r[3], 0) + len(words(r[1]))
    assert max(seen["source_mixing"].count(r) for r in seen["source_mixing"]) <= 3
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= largest[s]
    assert rows_of(pipeline.run(spark, at)) == seen["source_mixing"]


def test_stages_take_empty_input(spark, tmp_path):
    at = str(tmp_path)
    fixture(spark, at)
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, apply in pipeline.STAGES:
        assert apply(spark, docs, at).count() == 0


def test_rows_without_doc_id_stay(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13), (None, None, None, None, None)]
    got = dict(pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert rows_of(got) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_learned_list_is_readable(spark, tmp_path):
    at = str(tmp_path)
    fixture(spark, at)
    rules = Q.learn(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    assert rules and all(" -> reject (" in str(r) for r in rules)
