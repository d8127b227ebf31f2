"""Full-text, vector and hybrid retrieval as DataFrame plans.

The corpus is only ever filtered and aggregated: query terms and vectors are literals, postings come from
the texts that hold a query term, and what is ranked is cut to the top before it is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import get_text
from ..functions.text import tokenise, trigrams
from ..functions.vector import METRICS, dot, literal

K1, B, RRF_K = 1.2, 0.75, 60


def query_tokens(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", query.lower()) if len(t.encode()) > 1]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, id, tf, dl: the inverted index. A document that is given again replaces the former."""
    toks = docs.select(F.col(id_col).alias("id"), tokenise(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    return toks.select("id", "dl", F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def reindex(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index after a batch of changed documents and removed ids (both by id_col); only the batch is tokenised."""
    gone = changed.select(F.col(id_col).alias("id"))
    if removed is not None:
        gone = gone.union(removed.select(F.col(id_col).alias("id")))
    new = postings(changed, id_col, text_col)
    if removed is not None:
        new = new.join(removed.select(F.col(id_col).alias("id")), "id", "left_anti")
    return index.join(gone, "id", "left_anti").select("term", "id", "dl", "tf").unionByName(new.select("term", "id", "dl", "tf"))


def json_path_index(rows: DataFrame, id_col: str, col: str, *steps: str | int) -> DataFrame:
    """value, id: what an index on a path of a JSON column holds; rows without the path aren't in it."""
    return rows.select(get_text(F.col(col), *steps).alias("value"), F.col(id_col).alias("id")).where(F.col("value").isNotNull())


def json_path_lookup(rows: DataFrame, index: DataFrame, id_col: str, col: str, value: str, *steps: str | int) -> DataFrame:
    """Rows whose path has the value: ids from the index, then checked again on the rows themselves."""
    hit = index.where(F.col("value") == value).select(F.col("id").alias(id_col)).distinct()
    return rows.join(hit, id_col, "left_semi").where(get_text(F.col(col), *steps) == value)


def _times(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """id, score of every document with a query term; a term that is given twice counts twice.

    Each row is tokenised once: length and term frequencies come out of one fold over its tokens, and the
    one struct they make is all that is passed on. Texts without any of the terms add their length only.
    Document frequencies and the mean length are one aggregate of a few numbers.
    """
    terms = query_tokens(query)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")

    def counted(tokens: Column) -> Column:
        return F.struct(F.size(tokens).alias("dl"), *(_times(tokens, t).alias(f"tf{i}") for i, t in enumerate(distinct)))

    # A generator of one row: what it makes is computed once and not copied into each expression that reads it.
    once = F.explode(F.transform(F.array(tokenise(F.col(text_col))), counted)).alias("c")
    d = docs.select(F.col(id_col).alias("id"), once).select("id", "c.*")
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))))
    # Only texts that contain a term as letters can hold it as a token: the others are not tokenised again.
    lowered = F.lower(F.col(text_col))
    maybe = docs.where(F.greatest(*(lowered.contains(t) for t in distinct)) if len(distinct) > 1 else lowered.contains(distinct[0]))
    hit = maybe.select(F.col(id_col).alias("id"), once).select("id", "c.*").where(sum((F.col(f"tf{i}") for i in range(1, len(distinct))), F.col("tf0")) > 0)
    joined = hit.crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}").cast("double")
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        score = score + part * terms.count(t)
    return joined.select("id", score.alias("score"))


def match(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """``@@``: rows that hold any of the query's terms."""
    terms = query_tokens(query)
    return docs.where(F.arrays_overlap(tokenise(F.col(text_col)), F.array(*map(F.lit, terms)))) if terms else docs.where("false")


def top(scored: DataFrame, k: int, by: str = "score", descending: bool = True) -> DataFrame:
    return scored.orderBy(F.desc(by) if descending else F.asc(by), "id").limit(k)


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, dist of the k nearest; a top-k plan, no full sort."""
    d = vectors.select(F.col(id_col).alias("id"), METRICS[metric](F.col(vec_col), literal(query)).alias("dist"))
    return top(d, k, "dist", descending=False)


def search_dot(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return top(vectors.select(F.col(id_col).alias("id"), dot(F.col(vec_col), literal(query)).alias("score")), k)


def trigram_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, id: what a trigram index of a text column holds."""
    return docs.select(F.col(id_col).alias("id"), F.explode(trigrams(F.col(text_col))).alias("gram"))


def trigram_like(docs: DataFrame, pattern: str, text_col: str = "text", index: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """LIKE '%pattern%'. With an index only rows that have all the pattern's trigrams are read; each is checked again, so the result is LIKE's own."""
    grams = list(dict.fromkeys(pattern.lower()[i : i + 3] for i in range(len(pattern) - 2)))
    if index is not None and grams:
        held = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams))
        docs = docs.join(held.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return docs.where(F.col(text_col).contains(pattern))


def _ranked(scored: DataFrame, by: str, descending: bool) -> DataFrame:
    """Ranks from 0. scored is a top list already, so one task ranks a list of fixed length."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by) if descending else F.asc(by), "id")) - 1)


def rrf(lexical: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of top lists (id, score) and (id, dist)."""
    finite = lambda df, c: df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    both = _ranked(finite(lexical, "score"), "score", True).select("id", "rank").unionByName(_ranked(finite(vector, "dist"), "dist", False).select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def _spread(df: DataFrame, col: str, out: str, fn) -> DataFrame:
    w = Window.partitionBy()
    return df.select("id", fn(F.col(col), w).alias(out))


def weighted(lexical: DataFrame, vector: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * lexical + (1 - alpha) * similarity, each min-max normalised; a missing side is 0."""

    def norm(x: Column, w) -> Column:
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        return F.when(hi - lo < 1e-10, F.lit(1.0)).otherwise((x - lo) / (hi - lo))

    v = vector.select("id", (1 - F.least(F.col("dist"), F.lit(1.0))).alias("sim"))
    both = _spread(lexical, "score", "l", norm).join(_spread(v, "sim", "v", norm), "id", "full")
    return both.select("id", (alpha * F.coalesce("l", F.lit(0.0)) + (1 - alpha) * F.coalesce("v", F.lit(0.0))).alias("score"))


def dbsf(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Sum of z-scores of lexical score and negative distance."""

    def z(x: Column, w) -> Column:
        sd = F.stddev_pop(x).over(w)
        return F.when(sd <= 1e-10, F.lit(0.0)).otherwise((x - F.avg(x).over(w)) / sd)

    v = vector.select("id", (-F.col("dist")).alias("neg"))
    both = _spread(lexical, "score", "l", z).join(_spread(v, "neg", "v", z), "id", "full")
    return both.select("id", (F.coalesce("l", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("score"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], k: int = 10, pool: int = 100, fusion: str = "rrf", rerank: Column | None = None, id_col: str = "doc_id", vec_id: str = "vec_id", metric: str = "l2", alpha: float = 0.5) -> DataFrame:
    """Top pool of each side, fused, re-ranked by an expression over the vector if one is given, top k."""
    lex, vec = top(bm25(docs, query, id_col), pool), knn(vectors, vector, pool, metric, vec_id)
    fused = {"rrf": lambda: rrf(lex, vec), "weighted": lambda: weighted(lex, vec, alpha), "dbsf": lambda: dbsf(lex, vec)}[fusion]()
    if rerank is not None:
        fused = fused.join(vectors.withColumnRenamed(vec_id, "id"), "id", "left").select("id", F.coalesce(rerank, F.col("score")).alias("score"))
    return top(fused, k)


def mean_of_embedding(vec_col: str = "embedding") -> Column:
    """The re-ranker that stands in where no model is given."""
    return F.aggregate(F.col(vec_col), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(vec_col)


def update_weight(alpha: float, rewards: Sequence[float], step: float = 0.05, lo: float = 0.05, hi: float = 0.95) -> float:
    """The fusion weight after feedback: each reward moves it, inside [lo, hi]."""
    for r in rewards:
        alpha = min(hi, max(lo, alpha + step * r))
    return alpha


def lsh_knn(vectors: DataFrame, query: Sequence[float], k: int, candidates: int = 10, tables: int = 8, bucket: float = 2.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate neighbours by random-projection buckets, re-ranked exactly by distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=42).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense(query), candidates * k)
    return top(near.select("id", METRICS["l2"](F.col("v"), literal(query)).alias("dist")), k, "dist", descending=False)


def _means(x, k: int, rounds: int = 12):
    """k centroids of the rows of a small matrix (Lloyd's rounds; the first are spread by distance, without chance)."""
    import numpy as np

    at, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < min(k, len(x)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    c = x[at].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x, c):
    return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def product_quantize(vectors: DataFrame, subspaces: int = 8, centroids: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = 10_000):
    """Codes (id, codes) and codebooks of a product quantiser.

    Codebooks are fitted on at most ``fit_rows`` rows (the first by a hash of the id); every row gets its codes, batch by batch.
    """
    import numpy as np
    from pyspark.sql.types import ArrayType, IntegerType

    sample = np.array([r[0] for r in vectors.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows).select(F.col(vec_col).cast("array<double>")).collect()])
    width = -(-sample.shape[1] // subspaces)
    books = [_means(sample[:, s : s + width], centroids) for s in range(0, sample.shape[1], width)]

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.empty((0, width * len(books)))
        return pd.Series(list(np.stack([_nearest(x[:, s * width : (s + 1) * width], b) for s, b in enumerate(books)], axis=1).astype("int32")))

    return vectors.select(F.col(id_col).alias("id"), encode(F.col(vec_col).cast("array<double>")).alias("codes")), [b.tolist() for b in books]


def pq_knn(vectors: DataFrame, codes: DataFrame, books, query: Sequence[float], k: int, ef: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Asymmetric distances from lookup tables pick max(4k, ef) candidates; exact distances rank them."""
    width = -(-len(query) // len(books))
    total = F.lit(0.0)
    for s, book in enumerate(books):
        q = query[s * width : (s + 1) * width]
        distances = F.lit([float(sum((a - b) ** 2 for a, b in zip(c, q, strict=False))) for c in book])
        total = total + F.get(distances, F.get("codes", s))
    near = codes.select("id", total.alias("adc")).orderBy("adc", "id").limit(max(4 * k, ef))
    return top(vectors.withColumnRenamed(id_col, "id").join(F.broadcast(near), "id").select("id", METRICS["l2"](F.col(vec_col), literal(query)).alias("dist")), k, "dist", descending=False)
