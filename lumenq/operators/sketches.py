"""Mergeable sketches as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_LG_K, CMS_WIDTH, CMS_DEPTH = 14, 2048, 5


def hll(df: DataFrame, col: str, *keys: str, lg_k: int = HLL_LG_K) -> DataFrame:
    """One HyperLogLog sketch a group (column sketch)."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, lg_k).alias("sketch"))


def hll_merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias("estimate"))


def count_min(df: DataFrame, col: str, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> DataFrame:
    """depth, cell, n: a count-min sketch as a table of at most width * depth counters; merge by summing n.

    Values are counted first, so that a frequent value reaches the shuffle once a task.
    """
    counted = df.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    rows = counted.select("n", F.posexplode(F.array(*(F.pmod(F.xxhash64(F.lit(d), "v"), F.lit(width)) for d in range(depth)))).alias("depth", "cell"))
    return rows.groupBy("depth", "cell").agg(F.sum("n").alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, col: str, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> DataFrame:
    """value, estimate (never below the true count)."""
    asked = values.select(F.col(col).alias("value")).distinct().select("value", F.posexplode(F.array(*(F.pmod(F.xxhash64(F.lit(d), "value"), F.lit(width)) for d in range(depth)))).alias("depth", "cell"))
    return asked.join(F.broadcast(sketch), ["depth", "cell"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom(df: DataFrame, col: str, bits: int = 1 << 17, hashes: int = 7) -> DataFrame:
    """bucket, bitmap: a Bloom filter of a fixed number of bits; merge by bitmap_or_agg."""
    at = df.select(F.explode(_positions(F.col(col), bits, hashes)).alias("p"))
    return at.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def _positions(value: Column, bits: int, hashes: int) -> Column:
    return F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(h), value), F.lit(bits)) + 1 for h in range(hashes))))


def bloom_might_contain(filter_: DataFrame, values: DataFrame, col: str, bits: int = 1 << 17, hashes: int = 7) -> DataFrame:
    """value, maybe: false is sure."""
    asked = values.select(F.col(col).alias("value")).distinct().select("value", F.explode(_positions(F.col("value"), bits, hashes)).alias("p"))
    found = asked.join(F.broadcast(filter_), F.bitmap_bucket_number("p") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.bitmap_bit_position("p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("1") * F.pow(F.lit(2), F.bitmap_bit_position("p") % 8)
    on = F.coalesce((F.floor(byte / bit) % 2) == 1, F.lit(False))
    return found.groupBy("value").agg(F.bool_and(on).alias("maybe"))


def quantiles(df: DataFrame, col: str, ps: list[float]) -> DataFrame:
    """One row: an array of quantiles from a KLL sketch."""
    return df.agg(F.kll_sketch_agg_double(F.col(col).cast("double")).alias("s")).select(F.array(*(F.kll_sketch_get_quantile_double("s", F.lit(p)) for p in ps)).alias("quantiles"))


def quantile_sketch(df: DataFrame, col: str, *keys: str) -> DataFrame:
    """One KLL sketch a group (column sketch)."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(col).cast("double")).alias("sketch"))


def quantile_merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of parts as one of the whole."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def cdf(sketches: DataFrame, values: list[float]) -> DataFrame:
    """sketches with an array of the shares of rows at or below each value."""
    return sketches.withColumn("cdf", F.array(*(F.kll_sketch_get_rank_double("sketch", F.lit(float(v))) for v in values)))


def count_min_top(sketch: DataFrame, values: DataFrame, col: str, k: int, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> DataFrame:
    """value, estimate of the k most frequent values by the sketch."""
    return count_min_estimate(sketch, values, col, width, depth).orderBy(F.desc("estimate"), "value").limit(k)


def trimmed_mean(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    cuts = df.agg(F.percentile(col, lo).alias("lo"), F.percentile(col, hi).alias("hi"))
    return df.crossJoin(F.broadcast(cuts)).where(F.col(col).between(F.col("lo"), F.col("hi"))).agg(F.avg(col).alias("trimmed_mean"))  # cuts is one row


def histogram(df: DataFrame, col: str, buckets: int = 16) -> DataFrame:
    """bucket (from 1), n over equal widths between minimum and maximum."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    x = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(ends))  # ends is one row
    bucket = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets) + 1, F.lit(buckets)))
    return x.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def between_selectivity(hist: list[tuple[int, int]], lo: float, hi: float, a: float, b: float, buckets: int = 16) -> float:
    """The share of rows in [a, b], from a histogram over [lo, hi]."""
    total = sum(n for _, n in hist)
    if not total or hi <= lo:
        return 0.0 if not total else float(a <= lo <= b)
    width = (hi - lo) / buckets
    inside = sum(n * max(0.0, min(b, lo + k * width) - max(a, lo + (k - 1) * width)) / width for k, n in hist)
    return min(1.0, max(0.0, inside / total))


def bitmap(df: DataFrame, col: str) -> DataFrame:
    """bucket, bitmap of a set of non-negative ids."""
    return df.select(F.col(col).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bitmap"))


def bitmap_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of set sizes: n_and, n_or, n_xor, n_and_not (in a but not in b); a and b are bitmaps by bucket."""
    pair = a.withColumnRenamed("bitmap", "x").join(b.withColumnRenamed("bitmap", "y"), "bucket", "full")
    none = F.lit(0).cast("long")
    size = lambda c: F.coalesce(F.bitmap_count(c), none)
    both = a.unionByName(b).groupBy("bucket").agg(F.when(F.count("*") == 2, F.bitmap_count(F.bitmap_and_agg("bitmap"))).otherwise(none).alias("n"))
    joined = pair.join(both, "bucket").select(size("x").alias("x"), size("y").alias("y"), "n")
    total = lambda c: F.coalesce(F.sum(c), none)
    return joined.agg(total(F.col("n")).alias("n_and"), total(F.col("x") + F.col("y") - F.col("n")).alias("n_or"), total(F.col("x") + F.col("y") - 2 * F.col("n")).alias("n_xor"), total(F.col("x") - F.col("n")).alias("n_and_not"))
