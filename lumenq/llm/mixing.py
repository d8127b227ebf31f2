"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target
stops at ``cap`` times its source's words and the excess is shared again. That fixed point is a water
level: sources sorted by cap / weight are full up to the first that is not, which running sums find at once.

Rates: documents keep rates r close to 1 in relative entropy, subject to one token constraint a source
(sum of size * r = target). The convex dual has one multiplier per source, and its solution tilts
exponentially: r = min(cap, exp(lambda * size / mean size)). Newton's method runs on the dual, kept inside a
bracket; gradient and curvature are Spark sums over the distinct (source, size) pairs.

Copies: the whole part of r, and its fraction by systematic rounding: documents of a source, dealt by a
hash of doc_id into parts of about ``part`` documents, are taken from the largest to the smallest, and a
copy more falls due whenever the running fraction passes a whole. A part errs by about half a document, so
a hot source is split and a source comes near its target. Reruns agree: only hashes of doc_id are used.

Null text has size 0; a null source is a source; repeated rows are documents of their own; an empty table
gives none; other columns stay with their rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, n_words, stage, table

CAP, PART, WEIGHTS = 3.0, 1000, (1.0, 2.0, 3.0)
_ONE = 1 << 30


def targets(sources: DataFrame, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size, ...) with target; one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*(F.lit(float(x)) for x in weights))
    df = sources.withColumn("weight", F.get(w, (F.row_number().over(order) - 1) % len(weights))).withColumn("full", cap * F.col("source_size"))
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    total, total_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (total_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") > F.col("level"))
    # The first source that isn't filled sees the level of all that aren't.
    water = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("target", F.least("full", F.coalesce(water * F.col("weight"), F.col("full")))).drop("weight", "full", "level", "open")


def solve(sizes: DataFrame, sources: DataFrame, cap: float = CAP, rounds: int = 60, near: float = 5e-4) -> DataFrame:
    """source and its multiplier; sizes: source, size, n (distinct); sources: source, mean_size, target."""
    big = 1e9
    now = stage(sources.select("source", "mean_size", "target", "source_size", F.lit(0.0).alias("lam"), F.lit(-big).alias("lo"), F.lit(big).alias("hi"), (F.col("target") <= 0).alias("done")), "mix-lambda")
    u = F.col("size") / F.col("mean_size")
    tilt = F.exp(F.least(F.col("lam") * u, F.lit(math.log(cap))))
    free = (F.col("lam") * u < math.log(cap)).cast("double")
    for _ in range(rounds):
        if not now.where("not done").limit(1).count():
            break
        # Sums by source of the tilted tokens, and of their derivative.
        sums = sizes.join(now.where("not done").select(F.col("source").alias("s"), "lam", "mean_size"), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(F.col("n") * F.col("size") * tilt).alias("g"), F.sum(F.col("n") * F.col("size") * u * tilt * free).alias("h"))
        step = F.when(F.col("h") > 0, (F.col("target") - F.col("g")) / F.col("h")).otherwise(F.lit(big))
        reach = F.greatest(F.lit(1.0), 2 * F.abs("lam"))
        moved = now.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        moved = moved.withColumn("lo", F.when(F.col("g") < F.col("target"), F.greatest("lo", "lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("g") > F.col("target"), F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.least(F.greatest(step, -reach), reach)
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        met = F.col("done") | (F.abs(F.col("g") - F.col("target")) <= near * F.col("target")) | (F.abs("lam") > 1e8)
        further = stage(moved.withColumn("met", met).withColumn("lam", F.when(F.col("met"), F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)).select("source", "mean_size", "target", "source_size", "lam", "lo", "hi", F.col("met").alias("done")), "mix-lambda")
        discard(now)
        now = further
    if now.where("not done").limit(1).count():
        raise RuntimeError(f"the multipliers haven't met their targets after {rounds} rounds")
    return now


def plan_copies(documents: DataFrame, cap: float = CAP, part: int = PART) -> DataFrame:
    """documents with a struct ``__mix``: size, source_size, target, copies."""
    sized = documents.withColumn("__size", n_words(F.col("text")))
    slim = stage(sized.select(F.col("source"), F.col("__size").alias("size")).groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    per = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    per = stage(targets(per, cap).withColumn("mean_size", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))), "mix-targets")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    lam = solve(slim, per.where(~full), cap)
    told = per.select(F.col("source").alias("__s"), "source_size", "target", "docs", "mean_size").join(lam.select(F.col("source").alias("__l"), "lam"), F.col("__s").eqNullSafe(F.col("__l")), "left").drop("__l")
    told = stage(told.withColumn("__told", F.struct("source_size", "target", "docs", "mean_size", "lam")).select("__s", "__told"), "mix-rates")
    t = F.col("__told")
    rate = F.when(t["target"] <= 0, F.lit(0.0)).when(t["lam"].isNull(), F.lit(float(cap))).otherwise(F.exp(F.least(t["lam"] * F.col("__size") / t["mean_size"], F.lit(math.log(cap)))))
    df = sized.join(told, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("__rate", F.least(rate, F.lit(float(cap))))
    df = df.withColumn("__units", F.round(F.col("__rate") * _ONE).cast("long")).withColumn("__part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(t["docs"] / part).cast("long")))
    by = Window.partitionBy("source", "__part").orderBy(F.desc("__size"), F.xxhash64("doc_id"), "doc_id")
    upto = lambda end: F.coalesce(F.sum("__units").over(by.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    whole = lambda x: F.shiftright(x + _ONE // 2, 30)
    copies = F.least(whole(upto(0)) - whole(upto(-1)), F.lit(int(cap)).cast("long"))
    return df.withColumn("__mix", F.struct(F.col("__size").alias("size"), t["source_size"].alias("source_size"), t["target"].alias("target"), copies.alias("copies"))).drop("__size", "__told", "__rate", "__units", "__part")


def mix(documents: DataFrame, cap: float = CAP) -> DataFrame:
    """Each document as often as the mix takes it."""
    return plan_copies(documents, cap).where("__mix.copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, __mix.copies)"))).drop("__mix", "__copy")


def mix_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage."""
    return mix(docs)


def op6_entropy_mix(spark, sf_dir: str) -> DataFrame:
    planned = plan_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", (F.col("__mix.size") * F.col("__mix.copies")).alias("taken"), "__mix.copies")
