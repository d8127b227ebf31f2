"""Exact substring deduplication by prefix-partitioned suffix trees.

A repeat is a run of ``length`` (50) words that also starts in a document with a smaller doc_id; every word of
it goes.

1. Suffixes that could lie below a deep node. Each window of 50 words has the leftmost smallest of its 8-gram
   hashes as its anchor; equal windows have equal anchors at equal places. Spark counts anchors (combinable minimum
   and maximum of doc_id, and occurrences) and sets the bits of those in two documents or more in a bitmap of fixed
   size. Windows whose anchor's bit is not set have no equal elsewhere; false bits (all of them, once the
   corpus has far more repeated anchors than bits) only cost rows.
2. Pieces. Consecutive windows with one anchor share a suffix of the text: the windows that start up to k words before
   position x all hold the suffix's prefix of 50 - k words. A piece is such a suffix with its words to the left and
   right, as far as its windows reach, and its group is that prefix. Prefixes have variable length: with
   k = 42 they are the anchor's 8 words; anchors that occur more often than ``HEAVY`` (exact counts) are cut
   into windows with k = 21, 10 or 0, so that prefixes have 29, 40 or 50 words. So a group never has more pieces
   than its level allows (32 x HEAVY; at 50 words a group is one piece) and fits in memory. A task sends the words
   of equal pieces once, so a passage that a third of all documents hold is a handful of rows.
3. Subtrees. A group's suffixes are sorted word by word, and so are its reversed left contexts; the common prefix
   lengths of neighbours give the nodes of both trees. A window that starts d words left of x is a node of depth
   50 - d in the one and of depth d in the other; such deep nodes hold its leaves, and the smallest doc_id below is
   kept. Words are compared themselves, not hashed; hashes decide only where a piece is handled, but for two:
   equal pieces, and equal texts, are told by 128 bits of BLAKE2.
4. Each piece's runs of windows with their smallest document meet all its occurrences (an adaptive
   join, which splits the occurrences of a frequent piece over tasks); ranges with a smaller document are gathered by doc_id and joined to the whole texts.

A text that is the same as that of a smaller doc_id goes as a whole (if it has 50 words); each task
sends the pieces of equal texts once.

Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged. Null texts have none; shorter texts than 50 words lose nothing;
rows without a doc_id lose nothing and take nothing; repeated rows are the same document and treated alike (a doc_id
stands for one text); very long texts are cut into pieces like others; an empty table gives none; other
columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, stage, table
from .jaccard_join import _Hasher, _mix, _Powers

LENGTH, GRAM = 50, 8
#: Occurrences from which an anchor's windows are cut into 2 pieces; from 8 and 32 times as many into 4 and 43.
HEAVY = 2_000
#: At most so many anchors are told to the tasks as frequent (9 MB): HEAVY is raised to all occurrences / MOST_HEAVY if need be.
MOST_HEAVY = 1_000_000
#: By level, the distances between a window's start and its anchor that share a piece.
LEVELS = (((0, 42),), ((0, 21), (22, 42)), ((0, 10), (11, 21), (22, 32), (33, 42)), tuple((d, d) for d in range(43)))
#: Pieces whose trees are built at once (whole groups; a larger group stands alone).
CHUNK = 10_000
#: Bits of the anchors' bitmap (16 MB).
BITS = 1 << 27

_U = np.uint64


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def split(text: str | None) -> list[bytes]:
    return _bytes(text).split()


class _Text:
    """Hashes of all stretches of a text."""

    def __init__(self, h: np.ndarray, powers: _Powers):
        up, self.down = powers.get(len(h) + 1)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * up[:-1], dtype=_U)))

    def of(self, n: int) -> np.ndarray:
        """By start, for stretches of n words."""
        k = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:k]) * self.down[:k] + _U(n))

    def at(self, x: np.ndarray, n: int) -> np.ndarray:
        """Of the stretches of n words that start at x."""
        return _mix((self.sums[x + n] - self.sums[x]) * self.down[x] + _U(n))


def anchor_places(grams: np.ndarray) -> np.ndarray:
    """Where the leftmost smallest gram of each window stands, by the window's start (sliding minimum by doubling)."""
    at = np.arange(len(grams))
    want, have = LENGTH - GRAM + 1, 1
    while have < want:
        step = min(have, want - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        have += step
    return at


def anchors(grams: np.ndarray) -> np.ndarray:
    """The smallest gram of each window."""
    return grams[anchor_places(grams)]


def digest(found: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(found), digest_size=16).digest(), "big")


class _Once:
    """Texts that a task has had, with their smallest doc_id; a doc_id that isn't smaller need not be sent."""

    def __init__(self):
        self.seen: dict = {}

    def new(self, text: int, doc) -> bool:
        had = self.seen.get(text)
        if had is not None and had <= doc:
            return False
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[text] = doc
        return True


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, the two halves of its text's digest, and the text's anchors (one for each place)."""

    def run(batches):
        known, once = _Hasher(7), _Once()
        for batch in batches:
            docs, hi, lo, found = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = split(text)
                if len(ws) < LENGTH or doc is None:
                    continue
                d = digest(ws)
                docs.append(doc)
                hi.append((d >> 64) - (1 << 63))
                lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                got = np.empty(0, np.int64)
                if once.new(d, doc):
                    grams = _Text(known.words(_bytes(text)), known).of(GRAM)
                    got = grams[np.unique(anchor_places(grams))].view(np.int64)
                found.append(got)
            if docs:
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], names=["doc_id", "hi", "lo", "anchors"])

    return documents.mapInArrow(run, "doc_id long, hi long, lo long, anchors array<long>")


def _bitmap(repeated: DataFrame):
    """A broadcast bitmap of BITS bits: is the anchor in two documents or more?"""
    bit = F.col("anchor").bitwiseAND(F.lit(BITS - 1)) + 1  # these functions count from 1
    parts = repeated.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).toArrow()
    bits = np.zeros(BITS // 8, np.uint8)
    size = 4096
    for k, b in zip(parts.column("k").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        bits[(k - 1) * size : k * size] = np.frombuffer(b, np.uint8)
    return repeated.sparkSession.sparkContext.broadcast(bits)


def _frequent(counts: DataFrame, total: int):
    """A broadcast of the frequent anchors, in order, and their levels; at most MOST_HEAVY of them."""
    heavy = max(HEAVY, -(-total // MOST_HEAVY))
    got = counts.where(F.col("n") > heavy).toArrow()
    anchor, n = got.column("anchor").to_numpy().view(_U), got.column("n").to_numpy()
    order = np.argsort(anchor)
    level = 1 + (n > 8 * heavy).astype(np.int8) + (n > 32 * heavy)
    return counts.sparkSession.sparkContext.broadcast((anchor[order], level[order]))


def cut(h: _Text, bits: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a text, as arrays: group, first window, last window, place of the suffix."""
    grams = h.of(GRAM)
    at = anchor_places(grams)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    low = grams[at[first]] & _U(BITS - 1)
    maybe = ((bits[(low >> _U(3)).astype(np.int64)] >> (low & _U(7)).astype(np.uint8)) & 1).astype(bool)
    first, last = first[maybe], last[maybe]
    a = at[first]
    level = np.zeros(len(a), np.int8)
    if len(frequent[0]) and len(a):
        k = np.minimum(np.searchsorted(frequent[0], grams[a]), len(frequent[0]) - 1)
        level = np.where(frequent[0][k] == grams[a], frequent[1][k], level)
    for lv in np.unique(level).tolist():
        mine = level == lv
        f, z, place = first[mine], last[mine], a[mine]
        for lo, hi in LEVELS[lv]:
            p, q = np.maximum(f, place - hi), np.minimum(z, place - lo)
            some = p <= q
            x = place[some] - lo
            if len(x):
                yield _mix(h.at(x, LENGTH - (hi - lo)) + _U(lv * 64 + lo)), p[some], q[some], x


def _pieces(documents: DataFrame, bitmap, frequent) -> DataFrame:
    """group, hi, lo (digest), doc_id, start, n (windows), off (of the suffix), words (null where the task has sent them)."""

    def run(batches):
        known, once, sent = _Hasher(7), _Once(), _Once()
        bits, often = bitmap.value, frequent.value
        rows: list[tuple] = []
        digests: list[bytes] = []

        def flush():
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            group, doc, start, n, off, words = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
            rows.clear()
            digests.clear()
            return pa.RecordBatch.from_arrays([group, pa.array(two[:, 0]), pa.array(two[:, 1]), doc, start, n, off, words], names=["group", "hi", "lo", "doc_id", "start", "n", "off", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = split(text)
                if len(ws) < LENGTH or doc is None or not once.new(digest(ws), doc):
                    continue
                for groups, ps, qs, xs in cut(_Text(known.words(_bytes(text)), known), bits, often):
                    for g, p, q, x in zip(groups.view(np.int64).tolist(), ps.tolist(), qs.tolist(), xs.tolist(), strict=True):
                        piece = b" ".join(ws[p : q + LENGTH])
                        d = hashlib.blake2b(piece, digest_size=16).digest()
                        digests.append(d)
                        rows.append((g, doc, p, q - p + 1, x - p, piece if sent.new(d, doc) else None))
                        if len(rows) >= 10_000:
                            yield flush()
        if rows:
            yield flush()

    return documents.mapInArrow(run, "group long, hi long, lo long, doc_id long, start int, n int, off int, words binary")


def _nodes(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words within groups, and the common prefix length of each with the one before (-1: another group)."""
    width = codes.shape[1]
    wide = codes.astype(np.int64) + 1
    pairs = [(wide[:, k] << 32) | (wide[:, k + 1] if k + 1 < width else 0) for k in range(0, width, 2)]
    order = np.lexsort([*pairs[::-1], group])
    ordered, g = codes[order], group[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate(([-1], np.where(g[1:] == g[:-1], common, -1)))


def smallest(group: np.ndarray, doc: np.ndarray, n: np.ndarray, off: np.ndarray, words: pa.Array) -> np.ndarray:
    """For each piece and each of its windows (43 columns) the smallest doc_id of an equal window in its group."""
    depth = LENGTH - GRAM
    out = np.repeat(doc[:, None], depth + 1, axis=1)
    size = np.bincount(group)
    some = np.flatnonzero(size[group] > 1)
    if not len(some):
        return out
    group, doc, n, off, words = group[some], doc[some], n[some], off[some], words.take(pa.array(some))
    codes = pc.split_pattern(words, " ").flatten().dictionary_encode().indices.to_numpy()
    end = np.cumsum(n.astype(np.int64) + LENGTH - 1)
    begin = end - (n + LENGTH - 1)
    at = begin + off
    right = at[:, None] + np.arange(LENGTH)
    right = np.where(right < end[:, None], codes[np.minimum(right, len(codes) - 1)], -1)
    left = at[:, None] - 1 - np.arange(depth)
    left = np.where(left >= begin[:, None], codes[np.maximum(left, 0)], -1)
    (order_r, lcp_r), (order_l, lcp_l) = _nodes(right, group), _nodes(left, group)
    node_r, node_l = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
    for d in range(depth + 1):
        has = np.flatnonzero((off >= d) & (n + LENGTH - 1 - off >= LENGTH - d))
        if not len(has):
            continue
        node_r[order_r] = np.cumsum(lcp_r < LENGTH - d)
        node_l[order_l] = np.cumsum(lcp_l < d)
        key = node_r[has] * (len(some) + 1) + node_l[has]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.minimum.reduceat(doc[has][order], heads)
        out[some[has[order]], off[has[order]] - d] = np.repeat(least, np.diff(np.append(heads, len(key))))
    return out


def _subtrees(pieces: DataFrame) -> DataFrame:
    """hi, lo, n, at, first: of each piece the runs of its windows (by their first) with the smallest document that has them."""

    def build(table: pa.Table) -> pa.RecordBatch:
        group, hi, lo = (table.column(c).to_numpy() for c in ("group", "hi", "lo"))
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        table = table.filter(pa.array(new)).combine_chunks()  # the first of equal pieces has the smallest doc_id
        group, n = table.column("group").to_numpy(), table.column("n").to_numpy()
        ids = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
        first = smallest(ids, table.column("doc_id").to_numpy(), n, table.column("off").to_numpy(), table.column("words").chunk(0))
        change = np.ones(first.shape, bool)
        change[:, 1:] = first[:, 1:] != first[:, :-1]
        row, at = np.nonzero(change & (np.arange(first.shape[1]) < n[:, None]))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(first[row, at]))]
        return pa.RecordBatch.from_arrays([*(table.column(c).chunk(0) for c in ("hi", "lo", "n")), *lists], names=["hi", "lo", "n", "at", "first"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            group = table.column("group").to_numpy()
            whole = int(np.argmax(group == group[-1]))  # all before it are whole groups: rows come by group
            if whole:
                yield build(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            rows -= whole
        if rows:
            yield build(pa.Table.from_batches(held))

    told = pieces.where("words IS NOT NULL").select("group", "hi", "lo", "doc_id", "n", "off", "words")
    return told.repartition("group").sortWithinPartitions("group", "hi", "lo", "doc_id").mapInArrow(run, "hi long, lo long, n int, at array<int>, first array<long>")


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, ranges (s, e: first and last start of windows that go), whole (the text is that of a smaller doc_id); only for documents that lose words."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = stage(_texts(docs), "substring-texts")
    copies = texts.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("hi", "lo", "first")
    copies = stage(texts.select("doc_id", "hi", "lo").join(stage(copies, "substring-copies"), ["hi", "lo"]).where("doc_id > first").select("doc_id").distinct(), "substring-whole")
    counts = texts.select("doc_id", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    counts = stage(counts.where("lo <> hi").select("anchor", "n"), "substring-anchors")
    total = texts.agg(F.sum(F.size("anchors"))).first()[0] or 0
    bitmap, frequent = _bitmap(counts), _frequent(counts, total)
    pieces = stage(_pieces(docs, bitmap, frequent), "substring-pieces")
    places = pieces.select("hi", "lo", "doc_id", "start")
    ranges = F.expr("filter(transform(at, (a, i) -> struct(start + a AS s, start + coalesce(get(at, i + 1), n) - 1 AS e, get(first, i) AS f)), x -> x.f < doc_id)")
    met = places.join(_subtrees(pieces), ["hi", "lo"]).select("doc_id", F.transform(ranges, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"))).alias("r"))
    by_doc = met.where(F.size("r") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    found = stage(by_doc.join(copies.withColumn("whole", F.lit(True)), "doc_id", "full"), "substring-removed")
    release(spark)
    return found


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space) for each row."""
    gone = removed(documents).select(F.col("doc_id").alias("gone_id"), F.transform("ranges", lambda r: r["s"]).alias("s"), F.transform("ranges", lambda r: r["e"]).alias("e"), F.coalesce("whole", F.lit(False)).alias("whole"))

    def run(batches):
        for batch in batches:
            n, m, out = [], [], []
            for text, starts, ends, whole in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                ws = split(text)
                n.append(len(ws))
                gone_words = 0
                if whole:
                    ws, gone_words = [], len(ws)
                elif starts:
                    edge = np.zeros(len(ws) + 1, np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.asarray(ends) + LENGTH, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone_words = len(ws) - int(keep.sum())
                    ws = [w for w, k in zip(ws, keep.tolist(), strict=True) if k]
                m.append(gone_words)
                out.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    joined = documents.select("doc_id", "text").join(gone, F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "s", "e", F.coalesce("whole", F.lit(False)).alias("whole"))
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


def op5_suffix_trees(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
