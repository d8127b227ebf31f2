"""Quality rules: a learned decision list, applied as one Spark conditional expression.

Statistics of every whole text are native array and string functions in a narrow map. The list is learned
from labelled rows (``quality`` 0 or 1) by sequential covering:

* grow: literals ``feature >= t`` or ``feature < t`` are added to a conjunction while they raise FOIL's
  gain for quality 0 on the growing part of the rows (two thirds, by a hash of doc_id);
* prune: the prefix of the conjunction with the best (p - n) / (p + n) on the pruning part is kept;
* a rule stays while its precision on all labelled rows is at least ``min_precision``; the rows that it
  covers are set aside and the next rule is grown.

Each step is one Spark aggregation to counts by feature and bin; the driver sees only those counts. The
result is ``CASE WHEN rule 1 THEN reject WHEN rule 2 ... ELSE keep``.

Fit: on at most ``fit_rows`` (20,000) labelled rows, the first by a hash of doc_id. Thresholds are quantiles of
these rows and the midpoints between them. Statistics, base test and verdict cover every row.

Null and empty texts have no words, so they fail the base test; repeated rows are judged each; null labels
and labels without a text are left out; without labels of both kinds the list is empty and only the base
test decides. Clashing column names of the input are kept apart by a struct (:func:`judge`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NOT_WS, stage, table, words

FIT_ROWS, BINS, MAX_RULES, MAX_LITERALS, MIN_PRECISION = 20_000, 24, 12, 4, 0.9
#: Up to so many different repeated windows a text's windows are looked up one by one; beyond, by sorting.
FEW = 24

FEATURES = ("symbol_share", "upper_share", "digit_share", "punct_share", "dup_line_share", "repeat_share", "distinct_share", "mean_word", "words_per_line", "n_words")


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """df and a struct of base statistics and features of its text.

    Temporary columns are named by out, and each is used more than once, so that the planner keeps
    the steps apart instead of working them out again.
    """
    w, tri, dup, base = (f"__{out}_{x}" for x in ("w", "tri", "dup", "base"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumn(tri, F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<string>")))
    # Windows found twice or more: those equal to their neighbour once sorted.
    df = df.withColumn(
        dup,
        F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.array().cast("array<string>")).otherwise(
            F.transform(F.array(F.sort_array(tri)), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))[0]
        ),
    )

    def flagged(hit) -> Column:
        """Words j with a repeated window at j, j - 1 or j - 2; hit: an array of booleans by window."""
        on = lambda f, i: F.coalesce(F.get(f, i), F.lit(False))
        return F.transform(F.array(hit), lambda f: F.size(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda j: on(f, j) | F.when(j >= 1, on(f, j - 1)).otherwise(False) | F.when(j >= 2, on(f, j - 2)).otherwise(False))))[0]

    def by_sorting() -> Column:
        pairs = F.sort_array(F.transform(F.col(tri), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["x"] == x, F.lit(False))
        starts = F.transform(F.array(pairs), lambda s: F.sort_array(F.transform(F.filter(s, lambda p, k: same(s, k + 1, p["x"]) | F.when(k > 0, same(s, k - 1, p["x"])).otherwise(False)), lambda p: p["i"])))[0]
        return F.transform(F.array(starts), lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))[0]

    repeats = F.when(F.size(dup) == 0, 0).when(F.size(dup) <= FEW, flagged(F.transform(F.col(tri), lambda x: F.array_contains(F.col(dup), x)))).otherwise(by_sorting())
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_WS))
    n = F.size(w).cast("long")
    df = df.withColumn(
        base,
        F.struct(
            n.alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))[0].alias("lines"),
            repeats.cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"),
            F.regexp_count(t, F.lit("[A-Z]")).alias("upper"), F.regexp_count(t, F.lit("[0-9]")).alias("digits"), F.regexp_count(t, F.lit("[!?.,:;]")).alias("punct"),
        ),
    )
    b = F.col(base)
    some = lambda x: F.greatest(x, F.lit(1)).cast("double")
    chars, count = some(b["word_chars"]), some(b["n_words"])
    return df.withColumn(
        out,
        F.struct(
            b["n_words"].alias("n_words"), b["word_chars"].alias("word_chars"), b["n_symbols"].alias("n_symbols"), b["lines"]["d"].cast("long").alias("n_dup_lines"), b["n_repeat_words"].alias("n_repeat_words"),
            (b["n_symbols"] / chars).alias("symbol_share"), (b["upper"] / chars).alias("upper_share"), (b["digits"] / chars).alias("digit_share"), (b["punct"] / chars).alias("punct_share"),
            (b["lines"]["d"] / some(b["lines"]["n"])).alias("dup_line_share"), (b["n_repeat_words"] / count).alias("repeat_share"), (b["n_distinct"] / count).alias("distinct_share"),
            (b["word_chars"] / count).alias("mean_word"), (b["n_words"] / some(b["lines"]["n"])).alias("words_per_line"),
        ),
    ).drop(w, tri, dup, base)


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    rejected: int
    clean: int

    def holds(self, stats: Column) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.holds(stats)
        return out

    def __str__(self) -> str:
        return f"{' AND '.join(map(str, self.literals))} -> reject ({self.rejected}:{self.clean})"


def verdict(rules: list[Rule], stats: Column) -> Column:
    """True where no rule rejects."""
    out = None
    for rule in rules:
        out = F.when(rule.holds(stats), F.lit(False)) if out is None else out.when(rule.holds(stats), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list, most gainful rule first."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "__label_id")
    chosen = stage(chosen, "quality-labels")  # at most fit_rows rows of 16 bytes: small enough to broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id"))
    rows = with_statistics(rows).select((F.col("__quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"), *(F.col("stats")[f].cast("double").alias(f) for f in FEATURES))
    rows = stage(rows, "quality-rows")
    cuts = rows.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES)).first()
    # Midpoints too: where classes lie apart, the cut falls between them and not on the edge of one.
    cuts = {f: sorted(set(cuts[f] or ())) for f in FEATURES}
    cuts = {f: sorted({*c, *((a + b) / 2 for a, b in zip(c, c[1:], strict=False))}) for f, c in cuts.items()}
    binned = rows.select("bad", "grow", F.array(*(sum(((F.col(f) >= t).cast("int") for t in cuts[f]), F.lit(0)) for f in FEATURES)).alias("bins"))
    binned = stage(binned, "quality-bins")
    place = {f: i for i, f in enumerate(FEATURES)}

    def inside(literals) -> Column:
        out = F.lit(True)
        for x in literals:
            b, k = F.col("bins")[place[x.feature]], cuts[x.feature].index(x.threshold)
            out = out & ((b > k) if x.at_least else (b <= k))
        return out

    def counts(left: Column, literals):
        """(feature, bin, grow) -> [bad, clean] of what is left and inside."""
        got = binned.where(left & inside(literals)).select("bad", "grow", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "grow").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("n")).collect()
        return {(r["f"], r["b"], r["grow"]): (r["p"], r["n"] - r["p"]) for r in got}

    def total(c, grow):
        got = [v for (f, _, g), v in c.items() if f == 0 and g == grow]
        return sum(v[0] for v in got), sum(v[1] for v in got)

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        literals: list[Literal] = []
        c = counts(left, literals)
        trail = []
        while len(literals) < MAX_LITERALS:
            p, n = total(c, True)
            if not p or not n:
                break
            best, gain = None, 1e-9
            for f, i in place.items():
                below = [0, 0]
                for k, t in enumerate(cuts[f]):
                    x = c.get((i, k, True), (0, 0))
                    below = [below[0] + x[0], below[1] + x[1]]
                    for at_least, (a, b) in ((True, (p - below[0], n - below[1])), (False, below)):
                        if a and (g := a * (math.log(a / (a + b)) - math.log(p / (p + n)))) > gain:
                            best, gain = Literal(f, at_least, t), g
            if not best:
                break
            literals.append(best)
            c = counts(left, literals)
            trail.append((total(c, True), total(c, False)))
        if not literals:
            break
        worth = [((v[0] - v[1]) / (v[0] + v[1]) if sum(v) else -1.0) for _, v in trail]
        keep = max(range(len(worth)), key=lambda k: (worth[k], -k)) + 1
        (p, n), (pv, nv) = trail[keep - 1]
        if (p + pv) / max(p + pv + n + nv, 1) < min_precision or p + pv < 3:
            break
        rules.append(Rule(tuple(literals[:keep]), p + pv, n + nv))
        left = left & ~inside(literals[:keep])
    return rules


def judge(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """documents with a struct ``__judged``: the statistics, base_failed and kept.

    The struct holds a row number that nothing needs: being non-deterministic, it keeps the planner from pushing
    a filter on the verdict down through the statistics, which would repeat them for each literal.
    """
    rules = learn(documents, labels, **settings)
    s = F.col("__stats")
    failed = base_failed(s)
    return with_statistics(documents, out="__stats").withColumn("__judged", F.struct(*(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & verdict(rules, s)).alias("kept"), F.monotonically_increasing_id().alias("row"))).drop("__stats")


def filter_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    return judge(docs, table(spark, sf_dir, "labels")).where("__judged.kept").drop("__judged")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", *(f"__judged.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
