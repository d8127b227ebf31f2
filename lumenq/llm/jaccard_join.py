"""Exact Jaccard self-join on word shingles by a partitioned universe.

Sets are the hashed five-word shingles of a text. Two sets r and s of Jaccard similarity 0.8 or more differ in
at most (|r| + |s|) / 9 elements. Sizes fall into bands; each band cuts the universe of hashes into ``m``
segments, so that a set falls into up to ``m`` subsets. By the pigeonhole principle, if s spends thresholds
t_i (0: the subsets are equal, 1: they differ in one element) on some of its segments with
sum(t_i + 1) > (|r| + |s|) / 9, then r meets the threshold in one of them.

* Index: each set gives the subsets of all its segments in its own band; in bands of small sets their
  one-deletion neighbours too.
* Probe: each set, as the larger of a pair, probes its own band and, where sizes allow, the one below. Its
  allocation is by cost: it takes the segments that are rarest in a bounded sample (rows of the sample only
  choose where to look, never what is found), equal ones first, and pays for one-deletion neighbours only
  where equality can't reach the sum. Segments that many texts share (a licence, a boilerplate passage) are
  thus left out wherever a text has enough others.
* Sets for which no allocation reaches the sum are joined by their elements (``_by_elements``): two sets with
  80 % in common share one of the first fifth of their elements in any order, so only these meet.
* Candidates: buckets of equal subsets with a prober. Up to ``DIRECT`` sets a bucket gives all its pairs.
  A larger bucket gives a star from its first set; buckets that stars connect share a hub, and what is left
  to find is links between different components of a hub's sets (``_across``): every set is held as its
  difference from the hub, of which two similar sets must share a stated part, so that they meet under one of
  the rarest elements of their differences. No pair that could join two components is left out, and groups
  of near copies never give all their pairs.
* Verification compares whole sets.

Equal sets are one node from the start: nodes are 63-bit hashes of sets, and a second hash tells if two different
sets share a node. Such sets (about five in 10^10) move to nodes made from their second hash, and if that is taken
to a third, until no node has two sets; so the number of documents is not bounded by the hash. There is no cap on
partners, candidates or bucket size.

Null, empty and blank texts have no set and stay alone; fewer than five words are one shingle; repeated rows
share a component; rows without a doc_id have one of their own kind (null) unless a copy or near copy has an id;
very long texts are sets like others; an empty table gives none; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, stage, table
from .graph import components

SHINGLE, SAMPLE, HOT_FROM, HOT_MOST, DIRECT, SMALL = 5, 20_000, 8, 200_000, 8, 30
#: Sets that may have to leave their first node (a broadcast of at most 4 MB); more would mean that the hash is broken.
MOST_MOVED = 100_000
#: Involved documents are broadcast by id up to this many rows (16 MB), else joined by shuffle.
BROADCAST_IDS = 1_000_000

#: Bytes of a text that are hashed at once.
PART = 1 << 21

_U = np.uint64
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_SIGN, _ID = -(1 << 63), (1 << 63) - 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1024)
            self.up = np.concatenate((np.ones(1, _U), np.full(m - 1, _B, _U))).cumprod(dtype=_U)
            self.down = np.concatenate((np.ones(1, _U), np.full(m - 1, _INVERSE, _U))).cumprod(dtype=_U)
        return self.up[:n], self.down[:n]


class _Hasher(_Powers):
    """Hashes of all words of a text at once: each byte has a number of its own, and words are polynomials of these."""

    def __init__(self, seed: int):
        super().__init__()
        self.bytes = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
        self.blank = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))

    def words(self, data: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(data):  # very long texts in parts, for memory; parts end at a blank
            m = _BLANK.search(data, at + PART) if at + PART < len(data) else None
            end = m.start() if m else len(data)
            out.append(self._part(np.frombuffer(data, np.uint8, end - at, at)))
            at = end
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, _U)

    def _part(self, b: np.ndarray) -> np.ndarray:
        word = np.zeros(len(b) + 2, bool)
        word[1:-1] = ~self.blank[b]
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, end = edges[::2], edges[1::2]
        up, down = self.get(len(b) + 1)
        sums = np.zeros(len(b) + 1, _U)
        np.cumsum(self.bytes[b] * up[:-1], out=sums[1:])
        return _mix((sums[end] - sums[first]) * down[first] + (end - first).astype(_U))


def shingles(text: str | None, known: _Hasher) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    h = known.words((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only, and just the six ASCII spaces
    n = len(h)
    if not n:
        return np.empty(0, _U)
    if n < SHINGLE:
        x = np.zeros(1, _U)
        for k in range(n):
            x = _mix(x + h[k] + _ODD[k : k + 1] * _U(n))
        return x
    x = h[: n - SHINGLE + 1] * _ODD[0]
    for k in range(1, SHINGLE):
        x = x + h[k : n - SHINGLE + 1 + k] * _ODD[k]
    return np.unique(_mix(x))


@lru_cache(maxsize=None)
def band(size: int) -> tuple[int, int, int]:
    """Number, lowest and highest size of a size's band: 1, 2, 3-4, 5-7, 8-12 and so on, half as much again each."""
    k, lo = 0, 1
    while True:
        hi = lo * 3 // 2
        if size <= hi:
            return k, lo, hi
        k, lo = k + 1, hi + 1


def segments(hi: int) -> int:
    return -(-hi * 35 // 100) + 2


def _subsets(h: np.ndarray, number: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a sorted set's segments in a band, and first and end of each. Segments are ranges of the hash, so they are in order."""
    seg = ((h >> _U(32)) * _U(segments(hi))) >> _U(32)
    first = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
    end = np.append(first[1:], len(h))
    total = np.add.reduceat(_mix(h + _U(0x9E3779B97F4A7C15)), first)
    return _key(total, seg[first], number), first, end


def _key(total, seg, number: int):
    return _mix(total + seg * _U(0xC2B2AE3D27D4EB4F) + _U(number * 0x165667B19E3779F9 & _MASK))


def _deletions(h: np.ndarray, first: np.ndarray, end: np.ndarray, number: int, hi: int) -> list[np.ndarray]:
    """For each segment the keys with one element left out; a segment of one has none."""
    seg = ((h >> _U(32)) * _U(segments(hi))) >> _U(32)
    each = _mix(h + _U(0x9E3779B97F4A7C15))
    return [_key(each[a:b].sum(dtype=_U) - each[a:b], seg[a : a + 1], number) if b - a > 1 else np.empty(0, _U) for a, b in zip(first, end, strict=True)]


def allocate(size: np.ndarray, cost: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Segments probed with threshold 0 and those with 1, so that sum(t + 1) >= need; None if that can't be.

    Equality first, cheapest (rarest, then largest) segments first; then neighbours of the smallest subsets that have any.
    """
    order = np.lexsort((-size, cost))[:need]
    short = need - len(order)
    if short <= 0:
        return order, order[:0]
    able = order[size[order] > 1]
    if len(able) < short:
        return None
    return order, able[np.argsort(size[able], kind="stable")[:short]]


def keys_of(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys and probe flags of a set; whether its allocations all reach their sums."""
    n = len(h)
    number, lo, hi = band(n)
    keys, probes, whole = [], [], True
    for below in (False, True):
        if below:
            if n < 2 or lo == 1:
                break
            number, _, hi = band(lo - 1)
            if n * 4 > hi * 5:
                break
        own, first, end = _subsets(h, number, hi)
        need = (n + (hi if below else n)) // 9 + 1
        at = np.minimum(np.searchsorted(hot[0], own), max(len(hot[0]) - 1, 0))
        cost = np.where(hot[0][at] == own, hot[1][at], 0) if len(hot[0]) else np.zeros(len(own), np.int64)
        got = allocate(end - first, cost, need)
        probe = np.zeros(len(own), bool)
        near: tuple = ()
        small = hi <= SMALL
        if got is None or len(got[1]) and not small:
            whole, got = False, None
        else:
            probe[got[0]] = True
            near = got[1]
        if below:
            own = own[probe]
            probe = probe[probe]
        keys.append(own)
        probes.append(probe)
        if small:
            deleted = _deletions(h, first, end, number, hi)
            if not below:
                keys.append(np.concatenate(deleted))
                flag = np.zeros(len(keys[-1]), bool)
                if len(near):
                    flag = np.concatenate([np.full(len(d), i in set(near.tolist())) for i, d in enumerate(deleted)])
                probes.append(flag)
            elif len(near):
                keys.append(np.concatenate([deleted[i] for i in near]))
                probes.append(np.ones(len(keys[-1]), bool))
    return np.concatenate(keys), np.concatenate(probes), whole


#: The key under which sets go that no allocation serves.
_UNMET = -(1 << 63) + 12345
_NO_HOT = (np.empty(0, _U), np.empty(0, np.int64))


def node_of(h: np.ndarray, seed: int, moved: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Node (not negative: the sign is for the probe flag) and check of a set; it leaves nodes that several sets had."""
    a = int(_mix(np.array([_mix(h + _U(seed)).sum(dtype=_U) + _U(len(h))], _U))[0]) >> 1
    b = int(_mix(h ^ _U(0xA0761D6478BD642F)).sum(dtype=_U))
    step = 0
    while a in moved:
        step += 1
        a = int(_mix(np.array([b, step], _U)).sum(dtype=_U)) >> 1
    return a, b - (1 << 63)


def _nodes(documents: DataFrame, seed: int, moved: frozenset[int] = frozenset()) -> DataFrame:
    """doc_id, n_shingles, node, check."""

    def run(batches):
        known = _Hasher(seed)
        for batch in batches:
            n, node, check = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, known)
                n.append(len(h))
                a, b = node_of(h, seed, moved) if len(h) else (None, None)
                node.append(a)
                check.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64())], names=["doc_id", "n_shingles", "node", "check"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, check long")


def _rows(documents: DataFrame, seed: int, hot, moved: frozenset[int] = frozenset()) -> DataFrame:
    """key, node (negative, by its sign bit, where it probes). A task gives equal sets once."""

    def run(batches):
        known, seen = _Hasher(seed), set()
        common = hot.value if hot else _NO_HOT
        for batch in batches:
            keys, nodes, n = [], [], 0
            for text in batch.column(0).to_pylist():
                h = shingles(text, known)
                if not len(h):
                    continue
                node = node_of(h, seed, moved)[0]
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                k, probe, whole = keys_of(h, common)
                keys.append(k.view(np.int64))
                nodes.append(np.where(probe, node + _SIGN, node))
                n += len(k)
                if not whole:
                    keys.append(np.array([_UNMET], np.int64))
                    nodes.append(np.array([node], np.int64))
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                    keys, nodes, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return documents.select("text").mapInArrow(run, "key long, node long")


def _hot_keys(documents: DataFrame, n: int, seed: int):
    """Keys with HOT_FROM sets or more in a sample of about SAMPLE documents, the HOT_MOST most frequent: a broadcast of bounded size."""
    part = documents if n <= SAMPLE else documents.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)) < SAMPLE)
    counted = _rows(part, seed, None).distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "key").limit(HOT_MOST)
    got = counted.toArrow()
    keys = got.column("key").to_numpy().view(_U)
    order = np.argsort(keys)
    return documents.sparkSession.sparkContext.broadcast((keys[order], got.column("n").to_numpy()[order]))


def _buckets(rows: DataFrame) -> DataFrame:
    """a, b, key: candidate pairs (key null), and the members of large buckets (a: set, b: the bucket's first set).

    Rows come sorted by key and node, probers first, so a bucket that nobody probes shows at once. A bucket is
    a run; only its first set and, until it turns out to be large, its first DIRECT sets are held.
    """

    def run(batches):
        key = first = last = None
        held: list[int] = []
        count = 0
        a, b, c = [], [], []

        def put(x, y, z):
            a.append(x)
            b.append(y)
            c.append(z)

        def close():
            """The pairs of a bucket that stayed small."""
            if count <= DIRECT:
                for i, x in enumerate(held):
                    for y in held[:i]:
                        if x < 0 or y < 0:
                            put(y & _ID, x & _ID, None)

        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Most keys stand alone: only runs, and the batch's edges, are looked at one by one.
            look = np.zeros(len(k), bool)
            look[1:] = k[1:] == k[:-1]
            look[:-1] |= look[1:].copy()
            look[:1] = look[-1:] = True
            at = np.flatnonzero(look)
            for x, node in zip(k[at].tolist(), v[at].tolist(), strict=True):
                if x == _UNMET:
                    put(node, 0, _UNMET)
                    continue
                if x != key:
                    close()
                    key, held, count, last, first = x, [], 0, None, node
                if first >= 0 or node & _ID == last:
                    continue
                last = node & _ID
                count += 1
                if count <= DIRECT:
                    held.append(node)
                    continue
                for y in [*held, node]:
                    put(y & _ID, first & _ID, key)
                    if y != first:
                        put(first & _ID, y & _ID, None)
                held = []
            if a:
                yield _triples(a, b, c)
                a, b, c = [], [], []
        close()
        if a:
            yield _triples(a, b, c)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, key long")


def _triples(a, b, c):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["a", "b", "key"])


def _with_sets(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """a, b, x, y: pairs of nodes with their sets (sorted hashes, as bytes)."""
    wanted = stage(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "jaccard-wanted")
    ids = stage(nodes.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("first")).select(F.col("first"), F.col("node").alias("of")), "jaccard-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches):
        known = _Hasher(seed)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, known).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "set"])

    held = documents.join(ids, F.col("doc_id") == F.col("first")).select(F.col("of").alias("node"), "text").mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])
    left = held.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = held.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each element of x whether y has it; both sorted and not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _verified(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """Of pairs (a, b) those whose sets have Jaccard 0.8 or more: a, b, shared, na, nb."""

    def compare(batches):
        for batch in batches:
            keep, shared, na, nb = [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = int((_common(x, y) if len(x) < len(y) else _common(y, x)).sum())
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
                shared.append(both)
                na.append(len(x))
                nb.append(len(y))
            got = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], names=["a", "b", "shared", "na", "nb"])
            yield got.filter(pa.array(keep, pa.bool_()))

    out = stage(_with_sets(pairs, documents, nodes, seed).mapInArrow(compare, "a long, b long, shared long, na long, nb long"), "jaccard-links")
    release(documents.sparkSession)
    return out


def _across(stars: DataFrame, links: DataFrame, documents: DataFrame, nodes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links of sets to their hubs, and candidate pairs in different components of a hub's sets.

    A hub h is the smallest node of what stars (a, b) connect. D(r) is the difference of r and h, removed
    elements told from added ones. |r ^ s| = |D(r) ^ D(s)|, so with k = (|r| + |s|) / 9 a link needs
    |D(r) & D(s)| >= (|D(r)| + |D(s)| - k) / 2. Two sets that aren't both in h's component have one, r, that isn't
    linked with h, so |D(r)| > (|r| + |h|) / 9 and the bound is above 0 (and above half of |D(s)| or nearly so). With
    differences sorted by how rare their elements are under the hub, the first shared element comes so early
    in both that the bound can still be met: pairs meet under such elements only.
    """
    hubs = components(stars).select("label", "node").where("label <> node")

    def differences(batches):
        for batch in batches:
            near, diffs, nh, nr = [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                gone, new = x[~_common(x, y)], y[~_common(y, x)]
                both = len(x) - len(gone)
                near.append(100 * both >= 80 * (len(x) + len(y) - both))
                diffs.append(np.concatenate((new, ~gone)).view(np.int64))
                nh.append(len(x))
                nr.append(len(y))
            ends = np.cumsum([0, *map(len, diffs)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.bool_()), pa.array(nh, pa.int64()), pa.array(nr, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(diffs) if diffs else np.empty(0, np.int64)))],
                names=["hub", "r", "near", "nh", "n", "d"],
            )

    told = _with_sets(hubs.select(F.col("label").alias("a"), F.col("node").alias("b")), documents, nodes, seed).mapInArrow(differences, "hub long, r long, near boolean, nh long, n long, d array<long>")
    told = stage(told, "jaccard-differences")
    labels = components(links)
    told = stage(told.join(labels, F.col("r") == F.col("node"), "left").withColumn("label", F.coalesce("label", "r")).drop("node"), "jaccard-told")
    one = told.select("hub", "r", F.explode("d").alias("e"))
    rare = one.groupBy("hub", "e").agg(F.count("*").alias("f"))
    # An element that only one set has can't be shared: it keeps its place in the order, but needs no row.
    shared = stage(rare.where("f > 1"), "jaccard-shared")
    order = one.join(shared, ["hub", "e"]).groupBy("hub", "r").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("o"))
    rows = told.join(order, ["hub", "r"]).withColumn("nd", F.size("d")).withColumn("lone", F.size("d") - F.size("o")).drop("d")
    rows = rows.select("hub", "r", "near", "nh", "n", "nd", "label", "lone", F.posexplode("o").alias("p", "fe")).select("hub", "r", "near", "nh", "n", "nd", "label", F.col("fe.e").alias("e"), (F.col("lone") + F.col("p")).alias("at"))
    # Twice the bound times 9 is 9 (|D(r)| + |D(s)|) - |r| - |s|; the place of a shared element leaves at least the bound.
    rows = stage(rows.where("18 * at <= 18 * nd - if(near, 9 * nd + nh - n, least(9 * nd + nh - n, 9 * nd - n - nh))"), "jaccard-rows")
    r = rows.where("not near").select("hub", "e", F.col("r").alias("x"), F.col("n").alias("nx"), F.col("nd").alias("dx"), F.col("at").alias("ax"), F.col("label").alias("lx"))
    s = rows.select("hub", "e", F.col("r").alias("y"), F.col("n").alias("ny"), F.col("nd").alias("dy"), F.col("at").alias("ay"), F.col("label").alias("ly"), "near")
    met = r.join(s, ["hub", "e"]).where("x <> y and lx <> ly and (near or x < y) and 5 * least(nx, ny) >= 4 * greatest(nx, ny) and 18 * ax <= 18 * dx - 9 * (dx + dy) + nx + ny and 18 * ay <= 18 * dy - 9 * (dx + dy) + nx + ny")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    to_hub = told.where("near").select(F.col("hub").alias("a"), F.col("r").alias("b"), F.lit(None).cast("long").alias("shared"), F.col("nh").alias("na"), F.col("n").alias("nb"))
    return to_hub, pairs


def _by_elements(documents: DataFrame, rare: DataFrame, seed: int, moved: frozenset[int] = frozenset()) -> DataFrame:
    """Pairs of sets that couldn't be allocated with all sets that share an early element and fit in size.

    Similar sets r and s share at least 0.8 of the larger one's elements, so not all of these can lie behind the first
    n - ceil(0.8 n) + 1 elements of either (in the order of the hash).
    """

    def elements(batches):
        known = _Hasher(seed)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = shingles(text, known)
                if len(h):
                    early = h[: len(h) - -(-4 * len(h) // 5) + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(early.view(np.int64)), pa.array(np.full(len(early), node_of(h, seed, moved)[0])), pa.array(np.full(len(early), len(h)))], names=["e", "node", "n"])

    everything = documents.select("text").mapInArrow(elements, "e long, node long, n long")
    few = everything.join(rare, "node", "left_semi").distinct().select("e", F.col("node").alias("a"), F.col("n").alias("na"))
    pairs = everything.distinct().join(few, "e").where("node <> a and 5 * least(n, na) >= 4 * greatest(n, na)")
    return pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def join(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, n_shingles, node) and the verified links between different sets (a, b, shared, na, nb).

    Links leave out pairs of sets that other links connect already, where a bucket is larger than DIRECT.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    seed, moved = 1, frozenset()
    while True:
        nodes = stage(_nodes(documents, seed, moved), "jaccard-nodes")
        clash = nodes.where("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("n_shingles").alias("n"), F.max("n_shingles").alias("m")).where("lo <> hi or n <> m")
        taken = frozenset(r["node"] for r in clash.select("node").limit(MOST_MOVED + 1).collect())
        if not taken:
            break
        moved |= taken
        if len(moved) > MOST_MOVED:
            raise RuntimeError("too many sets share their hashes")
    n = nodes.count()
    hot = _hot_keys(documents, n, seed)
    found = stage(_buckets(_rows(documents, seed, hot, moved)), "jaccard-buckets")
    release(spark)
    pairs = found.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    unmet = found.where(F.col("key") == _UNMET).select(F.col("a").alias("node")).distinct()
    if unmet.limit(1).count():
        pairs = pairs.union(_by_elements(documents, unmet, seed, moved)).distinct()
    pairs = stage(_fit(pairs, nodes), "jaccard-pairs")
    links = _verified(pairs, documents, nodes, seed)
    stars = found.where(F.col("key") != _UNMET).select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")
    if stars.limit(1).count():
        stars = stage(stars.distinct(), "jaccard-stars")
        to_hub, more = _across(stars, links, documents, nodes, seed)
        links = links.union(to_hub)
        more = stage(more.join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
        if more.limit(1).count():
            links = links.union(_verified(more, documents, nodes, seed))
    return nodes, links


def _fit(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    sizes = nodes.where("node is not null").groupBy("node").agg(F.min("n_shingles").alias("n"))
    return pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b")


def group(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    nodes, links = join(documents)
    labels = components(links)
    firsts = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    firsts = stage(firsts.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "jaccard-firsts")
    ids = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    told = stage(firsts.join(ids, "label").select("node", "component_id"), "jaccard-ids")
    alone = nodes.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return nodes.where("node is not null").join(told, "node").select("doc_id", "n_shingles", "component_id").union(alone)


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest doc_id stays, once.

    Rows without a doc_id can't stand for a group and stay as they are.
    """
    kept = stage(group(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct(), "kept")
    first = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    return first.union(docs.where("doc_id IS NULL"))


def op8_universe_partition(spark, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
