"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming lookup,
exact weighted-shingle similarity.

For an item of L words, a document's windows of L words are fingerprinted: bit k of a 64-bit SimHash
is the sign of the sum of bit k over the window's shingles, each as often as it occurs.  The sums
of neighbouring windows are differences of one running sum.  Only windows that share a shingle with an item
of that length are fingerprinted; any other has similarity 0 with all of them.  The fingerprints of
the items are indexed by ``BLOCKS`` bytes: of two fingerprints within ``RADIUS`` bits, some byte
differs in at most RADIUS // BLOCKS bits, so the lookup finds every item within the radius.
Candidates are verified by the weighted Jaccard similarity of their 5-word shingles.  A document shorter
than an item, but long enough to be as similar, is one window as a whole.  Two texts
at the least similarity of 0.75 differ in about 11 of 64 bits, with a deviation of 3; the radius is 23.

The items go to the tasks in blocks of bounded text size, one at a time; a larger benchmark means more
passes over the documents, never a larger broadcast.

Defined cases: null and empty texts have no windows and are kept; items without words are
ignored, items without an id count, each for itself;
items or documents of fewer than five words have their whole word sequence as one shingle; of windows
with equal similarity the first is reported; repeated rows are judged alike; an empty benchmark keeps
everything.  Extra columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.words import documents_words, shingles, whole_row
from sievework.session import materialise

WIDTH, BLOCKS, RADIUS = 5, 8, 23
BLOCK_CHARS = 8_000_000
_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)]) <= RADIUS // BLOCKS


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per shingle and bit."""
    return ((hashes[:, None] >> _BITS & np.uint64(1)).astype(np.int32) << 1) - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def as_bytes(prints: np.ndarray) -> np.ndarray:
    return prints.astype("<u8").view(np.uint8).reshape(len(prints), BLOCKS)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    keys, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(where[: len(a)], minlength=len(keys))
    y = np.bincount(where[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class _Length:
    """The items of one length in words."""

    def __init__(self, n_words: int, ids: list[int], sets: list[np.ndarray]):
        self.n_words, self.ids, self.sets = n_words, ids, sets
        self.n_shingles = len(sets[0])
        self.prints = pack(np.array([votes(s).sum(axis=0) for s in sets]))
        blocks = as_bytes(self.prints)
        self.near = [_NEAR[:, blocks[:, k]] for k in range(BLOCKS)]  # byte value x item

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius."""
        found = np.zeros((len(prints), len(self.ids)), dtype=bool)
        for k, values in enumerate(as_bytes(prints).T):
            found |= self.near[k][values]
        w, i = np.nonzero(found)
        within = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[within], i[within]


class Index:
    """Items by length, and which lengths a shingle of any item occurs in."""

    def __init__(self, items: list[tuple[int, str]]):
        by_length: dict[int, tuple[list, list]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        for (item, _), (words, _, _) in zip(items, documents_words(texts, True), strict=True):
            if len(words):
                ids, sets = by_length.setdefault(len(words), ([], []))
                ids.append(item)
                sets.append(shingles(words, WIDTH))
        self.lengths = [_Length(n, *found) for n, found in sorted(by_length.items())]
        pairs = [
            (s, k) for k, x in enumerate(self.lengths) if x.n_words >= WIDTH for own in x.sets for s in own
        ]
        hashes = np.array([s for s, _ in pairs], dtype=np.uint64)
        groups = np.array([k for _, k in pairs], dtype=np.int64)
        order = np.lexsort((groups, hashes))
        self.hashes, self.groups = hashes[order], groups[order]

    def matches(self, words: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """Best window per item: (item, first word, words, similarity)."""
        best: dict[int, tuple[float, int, int]] = {}
        spots: dict[int, list] = {}
        if len(words) >= WIDTH and len(self.hashes):
            own = shingles(words, WIDTH)
            left = np.searchsorted(self.hashes, own)
            hits = np.flatnonzero(self.hashes[np.minimum(left, len(self.hashes) - 1)] == own)
            for at in hits:
                k = left[at]
                while k < len(self.hashes) and self.hashes[k] == own[at]:
                    spots.setdefault(int(self.groups[k]), []).append(at)
                    k += 1
        for group, x in enumerate(self.lengths):
            if x.n_words > len(words):  # the document may be the item without some of its words
                if not spots or len(own) < least * x.n_shingles:
                    break
                if group in spots:
                    self._whole(x, own, len(words), least, best)
                continue
            if x.n_words < WIDTH:
                windows = shingles(words, x.n_words)
                for item, own_set in zip(x.ids, x.sets, strict=True):
                    same = np.flatnonzero(windows == own_set[0])
                    if len(same):
                        best[item] = (1.0, int(same[0]), x.n_words)
            elif group in spots:
                self._search(x, own, np.unique(spots[group]), least, best)
        return [(item, at, n, sim) for item, (sim, at, n) in sorted(best.items())]

    @staticmethod
    def _whole(x: _Length, own: np.ndarray, n_words: int, least: float, best: dict) -> None:
        _, items = x.lookup(pack(votes(own).sum(axis=0)[None]))
        for i in items.tolist():
            sim = weighted_jaccard(own, x.sets[i])
            if sim >= least and sim > best.get(x.ids[i], (0.0,))[0]:
                best[x.ids[i]] = (sim, 0, n_words)

    @staticmethod
    def _search(x: _Length, own: np.ndarray, hits: np.ndarray, least: float, best: dict) -> None:
        m, last = x.n_shingles, len(own) - x.n_shingles
        lo, hi = np.maximum(hits - m + 1, 0), np.minimum(hits, last)
        cut = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1] + 1]))
        for a, b in zip(cut, [*cut[1:], len(hits)], strict=True):
            first, end = int(lo[a]), int(hi[b - 1])
            if first > end:
                continue
            for part in range(first, end + 1, 4096):  # bounded memory in a long run of hits
                stop = min(end, part + 4095)
                sums = np.zeros((stop - part + m + 1, 64), dtype=np.int32)
                np.cumsum(votes(own[part : stop + m]), axis=0, out=sums[1:])
                windows, items = x.lookup(pack(sums[m:] - sums[:-m]))
                for w, i in zip(windows.tolist(), items.tolist(), strict=True):
                    sim = weighted_jaccard(own[part + w : part + w + m], x.sets[i])
                    if sim >= least and sim > best.get(x.ids[i], (0.0,))[0]:
                        best[x.ids[i]] = (sim, part + w, x.n_words)


_NO_ITEM = -(1 << 62)  # items without an id count down from here


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items and the number of blocks they go in."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, -(-chars // BLOCK_CHARS)


def _index(items: DataFrame, k: int, n: int) -> Index:
    part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    rows = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
    return Index([(_NO_ITEM - nth if item is None else item, text) for nth, (item, text) in enumerate(rows)])


_HITS = "array<struct<item_id:bigint,first_word:bigint,n_words:bigint,similarity:double>>"
_HIT_NAMES = ("item_id", "first_word", "n_words", "similarity")


def _searched(rows: DataFrame, index: Broadcast, least: float, out: str) -> DataFrame:
    """``rows`` with the hits of one index in ``out``."""

    def search(batches):
        kind = None
        for batch in batches:
            found = []
            for words, _, _ in documents_words(batch["text"], True):
                hits = index.value.matches(words, least)
                hits = [(None if hit[0] <= _NO_ITEM else hit[0], *hit[1:]) for hit in hits]
                found.append([dict(zip(_HIT_NAMES, hit, strict=True)) for hit in hits])
            at = batch.schema.get_field_index(out)
            kind = batch.schema.field(at)
            yield batch.set_column(at, kind, pa.array(found, kind.type))

    rows = rows.withColumn(out, F.array().cast(_HITS))
    return rows.mapInArrow(search, T.StructType(rows.schema.fields))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, out: str = "leaks") -> DataFrame:
    """``docs`` with ``leaks``: per benchmark item that a window of the text repeats, the best window."""
    items, n = _items(benchmark)
    context = docs.sparkSession.sparkContext
    if n == 0:
        return docs.withColumn(out, F.array().cast(_HITS))
    if n == 1:
        return _searched(docs, context.broadcast(_index(items, 0, 1)), least, out)
    # One block at a time: its hits are written, few and narrow, before the next one is sent.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"), "text")
    parts = []
    for k in range(n):
        shared = context.broadcast(_index(items, k, n))
        hits = _searched(texts, shared, least, "hits").filter(F.size("hits") > 0)
        hits = hits.select("id", "print", "hits").dropDuplicates(["id", "print"])
        parts.append(materialise(hits, f"leaks{k}"))
        shared.unpersist()
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("id", "print").agg(
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits")
    )
    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"))
    on = F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.print") == F.col("f.print"))
    joined = rows.alias("d").join(every.alias("f"), on, "left")
    return joined.select(
        *[F.col(f"d.doc.`{c}`") for c in docs.columns if c != out],
        F.coalesce("f.hits", F.array().cast(_HITS)).alias(out),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """The documents without a leak, with their columns."""
    out = "leaks"
    while out in docs.columns:
        out += "_"
    found = leaks(docs, benchmark, least, out).filter(F.size(out) == 0)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
