"""Benchmark decontamination by spaced-seed hashing.

A mask is a pattern such as ``110110101``: of the words under it only those at a 1 are hashed, so a
substituted word at a 0 does not hide a match. Every position of every text and of every benchmark item is
hashed under each mask; equal hashes give hits (document, item, diagonal). Around a hit the two texts are
laid over each other on its diagonal and compared word by word over the whole item: the best stretch (+1 for
an equal word, -``penalty`` for a substituted one) must score ``min_score`` and hold ``min_words`` equal words.
A text is cut into blocks of as many words as the longest item has (``BLOCK`` at least), each with as many
words of the next; a hit meets the one block that holds its window, never the whole text, so a very long text with
very many hits is many small rows in many tasks. A seed that very many documents have (a stop phrase in an item)
gives each of them a hit, which costs one comparison as long as the item and is never dropped.

Recall of the masks: of all stretches of 10 to 20 words that reach the default score, 99.7 % or more hold a seed at each
length (all with one substitution or none; ``tests/llm`` counts them).

Words are lower-cased runs of ``[^\\x20\\x09-\\x0D]``. Items with fewer words than the shortest mask have no hash
and match nothing: so short a phrase is no evidence. Null texts and rows without a doc_id match nothing; repeated rows are one document
with one result; repeated items count each; an empty benchmark or table gives no rows; very long texts and items
are compared whole. Clashing further columns are never read. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage, table, words

#: Fixed masks of weight six. A stretch of ten words with any one substituted has a hit under one of them.
MASKS = ("111111", "11011101", "1101001011")
MIN_WORDS, MIN_SCORE, PENALTY = 10, 8, 2
#: Seeds of the benchmark are broadcast up to this many rows (about 100 MB in memory), else joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Words of a text's block at least; hits and texts meet by block.
BLOCK = 256


def _hashed(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))


def seeds(hashes: Column, n: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """For each mask in turn, the hash at each position that the mask has room for."""
    def under(k: int, mask: str) -> Column:
        first, *rest = (i for i, c in enumerate(mask) if c == "1")
        assert first == 0
        hashed = F.transform(F.slice(hashes, 1, n - len(mask) + 1), lambda x, p: F.xxhash64(F.lit(k), x, *(F.get(hashes, p + i) for i in rest)))
        return F.when(n >= len(mask), hashed).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*(under(k, mask) for k, mask in enumerate(masks)))


def with_seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """One row for each seed: the key columns, seed, pos."""
    keys = [c for c in df.columns if c != "text"]
    df = df.select(*keys, _hashed(F.col("text")).alias("__h")).withColumn("__n", F.size("__h"))
    df = df.select(*keys, "__n", F.posexplode(seeds(F.col("__h"), F.col("__n"), masks)).alias("__i", "seed"))
    # The running index tells the mask and the position.
    pos, base = F.lit(None).cast("int"), F.lit(0)
    for mask in masks:
        room = F.greatest(F.col("__n") - len(mask) + 1, F.lit(0))
        pos = F.when(pos.isNull() & (F.col("__i") < base + room), F.col("__i") - base).otherwise(pos)
        base = base + room
    return df.select(*keys, "seed", pos.alias("pos"))


def best_stretch(equal: Column, penalty: int) -> Column:
    """Of an array of booleans: score, number of equal words, first and end of the best stretch; a fold."""
    zero = F.struct(*(F.lit(0).alias(c) for c in ("i", "run", "hit", "from", "score", "equal", "first", "end")))

    def step(a, x):
        fresh = a["run"] <= 0
        run = F.when(fresh, 0).otherwise(a["run"]) + F.when(x, 1).otherwise(-penalty)
        hit = F.when(fresh, 0).otherwise(a["hit"]) + F.when(x, 1).otherwise(0)
        start = F.when(fresh, a["i"]).otherwise(a["from"])
        better = run > a["score"]
        pick = lambda new, old: F.when(better, new).otherwise(a[old])
        return F.struct((a["i"] + 1).alias("i"), run.alias("run"), hit.alias("hit"), start.alias("from"), pick(run, "score").alias("score"), pick(hit, "equal").alias("equal"), pick(start, "first").alias("first"), pick(a["i"] + 1, "end").alias("end"))

    return F.aggregate(equal, zero, step)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_score: int = MIN_SCORE, penalty: int = PENALTY) -> DataFrame:
    """doc_id, item_id, first and end word in the document, equal (words), score: the best overlap of each pair that has one."""
    items = stage(benchmark.where("text is not null").select("item_id", "text"), "items")
    item_seeds = stage(with_seeds(items, masks).withColumnRenamed("pos", "item_pos").distinct(), "item-seeds")
    if item_seeds.count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    docs = documents.where("text is not null").select("doc_id", "text")
    hits = with_seeds(docs, masks).join(item_seeds, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    longest = items.agg(F.max(F.size(words("text")))).first()[0] or 0
    block = max(longest, BLOCK)
    block_of = F.floor(F.greatest("diagonal", F.lit(0)) / block).cast("int")
    hits = stage(hits.withColumn("block", block_of), "seed-hits")
    # Only documents with a hit are read again, cut into blocks.
    hit_docs = hits.select(F.col("doc_id").alias("hit_id")).distinct()
    texts = docs.join(hit_docs, F.col("doc_id") == F.col("hit_id"), "left_semi").select("doc_id", words(F.lower("text")).alias("d"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("d") - 1) / block).cast("int")), lambda k: F.struct(k.alias("block"), F.slice("d", k * block + 1, block + longest).alias("part")))
    blocks = texts.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.block", "p.part")
    pairs = hits.join(blocks, ["doc_id", "block"]).join(items.select("item_id", words(F.lower("text")).alias("w")), "item_id")
    pairs = pairs.withColumn("at", F.col("diagonal") - F.col("block") * block)
    equal = F.transform("w", lambda x, i: F.coalesce(F.when(F.col("at") + i >= 0, F.get(F.col("part"), F.col("at") + i)) == x, F.lit(False)))
    found = pairs.select("doc_id", "item_id", "diagonal", best_stretch(equal, penalty).alias("b")).where((F.col("b.score") >= min_score) & (F.col("b.equal") >= min_words))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("b.score", "b.equal", (-F.col("diagonal")).alias("back"), "b.first", "b.end")).alias("m"))
    return best.select("doc_id", "item_id", (F.col("m.first") - F.col("m.back")).cast("long").alias("first_word"), (F.col("m.end") - F.col("m.back")).cast("long").alias("end_word"), F.col("m.equal").cast("long").alias("equal_words"), F.col("m.score").cast("long").alias("score"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap an item go."""
    bad = stage(find_overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")


def op10_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
