"""Toxicity by weak supervision.

1. Voters. Some are known beforehand and owe nothing to the labels: a short lexicon of insults in four languages,
   shouting, and runs of exclamation marks (``LEXICON``, ``KNOWN``). Further, every word and every word prefix of three
   to eight letters (a pattern) of the labelled training
   texts is a possible voter. Spark counts, for each, the texts of either label that hold it; support and log odds
   alone decide, there is no cap on their number. Voters that fire in the same texts are one (its longest
   word). Of these, a greedy cover takes the one that finds
   most toxic texts, each counting half as much with every voter that has found it, until too few are left. A voter says "toxic"
   when a text holds it and abstains otherwise. Prefixes catch inflected forms that training lacks.
2. Label model. A latent class per text; each voter fires with its own rate under either class, and the
   given label is one more, noisy, voter. EM estimates the rates (the accuracies). Correlations of voters
   within a class are taken from the posterior, and a voter counts 1 / (1 + its summed correlations), so
   that a word and its prefix are not two witnesses.
3. Classifier. Logistic regression on the voters' hits, trained on the posterior labels.

Fit: on at most ``fit_rows`` (20,000) labelled rows, the first by a hash of doc_id; one row a doc_id.
Scores: on every row, by a narrow map. Inputs of a score are the text's words alone.

Null and empty texts, and texts in which nothing votes, get the same low score; very long texts are read whole; repeated
rows are scored each; rows without a doc_id are scored but never fitted on; empty tables give no scores, or scores without voters; doc_ids in labels without a text, and null labels, are left out; with no usable label every score
is 0; other columns are dropped.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, table

FIT_ROWS, MIN_SUPPORT = 20_000, 4
#: Common insults (English, German, French, Spanish).
LEXICON = frozenset(
    "asshole bastard bitch coward cretin dumbass filth freak fool garbage idiot imbecile jerk loser moron pathetic pig scum shit slut stupid trash ugly vermin whore worthless "
    "abschaum arschloch depp dreckschwein dummkopf feigling hurensohn idiotin mistkerl schlampe schwachkopf schwein trottel versager wichser "
    "abruti connard connasse crétin débile enfoiré imbécile ordure pourriture salaud salope stupide "
    "asqueroso basura cabrón escoria estúpido gilipollas idiota imbécil malparido maldito puta tonto zorra".split()
)
PREFIXES = range(3, 9)
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


_BANG = re.compile(r"!{2,}|[?!]{3,}")
#: Voters that owe nothing to the labels.
KNOWN = ("@insult", "@shout", "@bang")


def known_voters(text: str, words: set[str]) -> set[str]:
    """An insult of the lexicon; half of ten words or more in capitals; a run of exclamation marks."""
    out = set() if words.isdisjoint(LEXICON) else {"@insult"}
    if _BANG.search(text):
        out.add("@bang")
    said = _WORD.findall(text) if text.upper() == text or sum(map(str.isupper, text)) * 3 > len(text) else ()
    if len(said) >= 10 and sum(w.isupper() for w in said) * 2 >= len(said):
        out.add("@shout")
    return out


def candidates(text: str | None) -> set[str]:
    """The words of a text, its prefixes as "abc*", and the known voters it holds."""
    text = text or ""
    out = set(_WORD.findall(text.lower()))
    return out | {f"{w[:n]}*" for w in out for n in PREFIXES if len(w) > n} | known_voters(text, out)


def cover(hits: list[np.ndarray], labels: np.ndarray, min_support: int) -> list[int]:
    """Voters (each the rows it fires in), best first. Each hit halves what a text counts for later voters, so that texts are found in several ways."""
    if not hits:
        return []
    left, out, toxic = np.ones(len(labels)), [], (labels > 0).astype(float)
    rare = toxic.sum() / max((1 - toxic).sum(), 1)
    rows = np.concatenate(hits)
    of = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    total = lambda x: np.bincount(of, weights=x[rows], minlength=len(hits))
    free = total(toxic) >= min_support
    cost = 2 * max(rare, 0.2) * total(1 - toxic)
    while free.any():
        gain = np.where(free, total(left * toxic) - cost, -np.inf)
        best = int(np.argmax(gain))
        if gain[best] < min_support / 2:
            break
        out.append(best)
        free[best] = False
        left[hits[best]] *= 0.5
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of each row, firing rates by class (2 x voters), voter weights, and the accuracy of the given labels."""
    n, m = votes.shape
    post = np.where(labels > 0, 0.95, 0.05)
    weight, trust = np.ones(m), 0.95
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        mass = np.array([(1 - post).sum(), post.sum()])
        rate = np.stack([((1 - post) @ votes + 0.05) / (mass[0] + 5), (post @ votes + 0.05) / (mass[1] + 5)])
        trust = float(np.clip((post * labels + (1 - post) * (1 - labels)).mean(), 0.8, 0.99))
        # conditional correlations, from the class-weighted covariance
        corr = np.zeros((m, m))
        for c, p in ((0, 1 - post), (1, post)):
            z = votes - rate[c]
            cov = (z * p[:, None]).T @ z / max(mass[c], 1)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            corr += np.abs(cov / sd[:, None] / sd[None, :]) * mass[c] / n
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.where(corr > 0.3, corr, 0).sum(axis=1))
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        # A voter that abstains says nothing (its language may not be the text's); that none votes does.
        on = np.log(rate[1] / rate[0])
        silent = votes.sum(axis=1) == 0
        none = math.log(((post[silent].sum() + 0.5) / (mass[1] + 1)) / (((1 - post)[silent].sum() + 0.5) / (mass[0] + 1)))
        logit = math.log(prior / (1 - prior)) + votes @ (weight * on) + none * silent + np.where(labels > 0, 1, -1) * math.log(trust / (1 - trust))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, rate, weight, trust


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with weights that aren't negative (accelerated projected gradient).

    A voter has nothing to say for "clean", so a negative weight could only correct another voter's.
    """
    start = math.log(max(y.mean(), 1e-4) / max(1 - y.mean(), 1e-4))
    # Rows with the same votes are one row with their number and mean label: mostly those without a vote.
    x, at, c = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    y = np.bincount(at.ravel(), weights=y) / c
    n, m = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(m + 1)
    w[-1] = start
    penalty = np.append(np.full(m, ridge), 1e-6)
    scale = 1 / np.sqrt(np.maximum(c @ a, 1))  # rare voters are scaled up, for even steps
    b = a * scale
    rate = 1 / (0.25 * np.linalg.eigvalsh((b * c[:, None]).T @ b)[-1] + ridge)
    v = u = w / scale
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b @ u, -30, 30)))
        new = u - rate * (b.T @ (c * (p - y)) + penalty * u * scale**2)
        new[:-1] = np.maximum(new[:-1], 0)
        u = new + k / (k + 3) * (new - v)
        v = new
    w = v * scale
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, min_support: int = MIN_SUPPORT) -> tuple[dict[str, float], float]:
    """Weights of the voters, and the intercept."""
    spark = documents.sparkSession
    chosen = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = stage(chosen, "toxic-labels")  # at most fit_rows rows of 16 bytes: small enough to broadcast

    def split(batches):
        for batch in batches:
            got = [sorted(candidates(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_pylist(), pa.int32()), pa.array(got, pa.list_(pa.string()))], names=["doc_id", "toxic", "held"])

    rows = stage(documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(split, "doc_id long, toxic int, held array<string>"), "toxic-rows")
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = size["n"], size["t"] or 0
    if not t or t == n:
        return {}, -math.inf if not t else 5.0
    counted = rows.select("toxic", F.explode("held").alias("voter")).groupBy("voter").agg(F.sum("toxic").alias("on"), F.count("*").alias("of")).where(F.col("on") >= min_support)
    odds = F.log(((F.col("on") + 0.5) / t) / ((F.col("of") - F.col("on") + 0.5) / (n - t)))
    gain = F.when(odds > 1.5, F.col("on") * odds)
    wanted = stage(counted.withColumn("gain", gain).where(F.col("gain").isNotNull() | F.col("voter").isin(*KNOWN)).select("voter", F.coalesce("gain", F.lit(0.0)).alias("gain")), "toxic-voters")
    # Voters that fire in the same rows are one. At most fit_rows rows are listed, each with the voters of one text.
    held = rows.select("doc_id", F.explode("held").alias("voter")).join(wanted, "voter").groupBy("voter", "gain").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    best = F.max(F.struct("gain", F.length("voter").alias("size"), "voter"))
    one = held.groupBy(F.sha2(F.array_join(F.transform("docs", lambda x: x.cast("string")), ","), 256).alias("same")).agg(best.alias("b"), F.first("docs").alias("docs"))
    told = one.select("b.gain", "b.size", "b.voter", "docs").orderBy(F.desc("gain"), F.desc("size"), "voter").collect()
    if not told:
        return {}, math.log(t / (n - t))
    labelled = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow()
    ids, y = labelled.column("doc_id").to_numpy(), labelled.column("toxic").to_numpy().astype(float)
    voters, hits = [r["voter"] for r in told], [np.searchsorted(ids, r["docs"]) for r in told]
    chosen_voters = cover(hits, y, min_support)
    known = [i for i, v in enumerate(voters) if v in KNOWN and i not in chosen_voters and len(hits[i]) >= min_support]
    chosen_voters += known
    if not chosen_voters:
        return {}, math.log(t / (n - t))
    votes = np.zeros((len(ids), len(chosen_voters)))
    for k, v in enumerate(chosen_voters):
        votes[hits[v], k] = 1
    post, *_ = label_model(votes, y)
    w, b = logistic(votes, post)
    return {voters[v]: float(w[i]) for i, v in enumerate(chosen_voters)}, b


def score_rows(documents: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """doc_id, score for each row."""

    def run(batches):
        # Each word's share is worked out once: its own weight and those of its prefixes.
        known: dict[str, tuple] = {}
        stop = set(weights)
        told = not stop.isdisjoint(KNOWN)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                held = {v for v in known_voters(text or "", words) if v in stop} if told else set()
                for w in words:
                    got = known.get(w)
                    if got is None:
                        if len(known) > 500_000:
                            known.clear()
                        got = known[w] = tuple(v for v in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n)) if v in stop)
                    held.update(got)
                z = intercept + math.fsum(weights[v] for v in held)
                out.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_weak_supervision(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_rows(documents, *fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
