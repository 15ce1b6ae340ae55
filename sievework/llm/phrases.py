"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  Words are removed that a window covers whose words also
start somewhere in a document with a smaller ``doc_id``.

1. *Anchors.*  Every window has an anchor, its 5-gram of smallest hash: equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so a document has one anchor per five words.  Anchors found
   in one document only cannot hold a recurring window; a shuffle of (anchor, document) finds them.
   A document whose whole word sequence a smaller document has is removed as a whole: a row with the
   sequence's hash finds it in the same shuffle, and it takes no part in what follows.
2. *Segments.*  Runs of windows around one recurring anchor go, as words, to the shard of that anchor.  Of
   anchors in more than ``HOT`` documents, windows go one by one, by their own hash; a
   window that the task has already seen in a smaller document is settled there and does not travel.
3. *Automata.*  Of equal segments only the first enters its shard, the others are settled by it.  A
   shard confirms which of its windows recur in different documents, compiles these phrases
   into an Aho-Corasick automaton over words (each word is one symbol), and streams its segments
   through it: every occurrence behind the first document is a range to remove.  Shards are read as
   sorted streams and closed at ``SHARD_CHARS``; no group is gathered beyond that and one key.
4. *Ranges* return to their documents by ``doc_id``.  Texts travel compressed.

Defined cases: null text has no words; documents shorter than a window keep everything; a null
``doc_id`` is the smallest; windows that recur only within rows of one ``doc_id`` stay; repeated rows
are cut alike; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.words import BLOCK, documents_words, mix, shingles
from sievework.session import materialise

WINDOW, ANCHOR = 13, 5
CELLS = 1 << 18
SALT_ROWS = 200_000
HOT = 1000
SHARD_CHARS = 1 << 19
SEEN_WINDOWS = 50_000
_NO_ID = -(1 << 63)


def anchors(words: np.ndarray) -> np.ndarray:
    """Anchor of each window: the smallest hash among its 5-grams."""
    if len(words) < WINDOW:
        return words[:0]
    grams = shingles(words, ANCHOR)
    span, low = WINDOW - ANCHOR + 1, grams
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(grams) - span + 1], low[span - width :]) if span > width else low


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for words, _, _ in documents_words(batch["text"], False):
            counts[np.unique(_cell(anchors(words)))] += 1
    cells = np.flatnonzero(counts)
    yield pa.record_batch({"cell": cells, "n": counts[cells]})


def _cell(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(CELLS - 1)).astype(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each document (``mark`` 0), and its whole sequence (``mark`` not 0).

    Of copies within the task, the larger document is known to be one: it writes a pair of rows of
    its own instead of anchors, so that a large group of copies is not dealt to one task.
    """
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        ids = batch["id"].to_pylist()
        keys, marks, owners = [], [], []
        for doc, (words, _, _) in zip(ids, documents_words(batch["text"], False), strict=True):
            if len(words) < WINDOW:
                continue
            mark, whole = _mark(words), _whole(words)
            first = seen.setdefault((int(whole[0]), mark), doc)
            if first < doc:
                alone = mix(whole ^ np.uint64(doc & (1 << 63) - 1))
                keys.append(np.repeat(alone, 2))
                marks.append(np.array([mark, mark]))
                owners.append(np.array([first, doc]))
                continue
            found = np.unique(anchors(words))
            keys.append(np.append(found, whole))
            marks.append(np.append(np.zeros(len(found), dtype=np.int64), mark))
            owners.append(np.full(len(found) + 1, doc))
        if keys:
            yield pa.record_batch(
                {
                    "anchor": np.concatenate(keys).view(np.int64),
                    "mark": np.concatenate(marks).astype(np.int64),
                    "id": np.concatenate(owners).astype(np.int64),
                }
            )


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress((t.as_py() or "").encode()) for t in batch["text"]]
        yield pa.record_batch([batch["id"], pa.array(packed, pa.binary())], names=["id", "packed"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return (unpacker.decompress(p.as_py()) for p in column)


def _opened(column: pa.Array) -> Iterator[tuple[bytes, tuple]]:
    """Texts and their words, unpacked a block at a time."""

    def block(texts: list[bytes]) -> Iterator[tuple[bytes, tuple]]:
        strings = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        return zip(texts, documents_words(strings, False), strict=True)

    held, size = [], 0
    for text in _unpacked(column):
        held.append(text)
        size += len(text)
        if size > BLOCK:
            yield from block(held)
            held, size = [], 0
    yield from block(held)


def _text_key(words: np.ndarray) -> int:
    """Tells rows of one ``doc_id`` apart."""
    mixed = mix(words + np.arange(len(words), dtype=np.uint64)).sum(dtype=np.uint64)
    return int(mixed & np.uint64(0x7FFFFFFF))


def _whole(words: np.ndarray) -> np.ndarray:
    """Hash of the sequence, as an array of one."""
    placed = words * np.uint64(0xD1342543DE82EF95) + np.arange(1, len(words) + 1, dtype=np.uint64)
    return mix(mix(placed).sum(dtype=np.uint64, keepdims=True))


def _mark(words: np.ndarray) -> int:
    """Number of words and key of the text: a second hash of a whole sequence, never 0."""
    return len(words) << 31 | _text_key(words)


_SEGMENT = pa.schema(
    [("key", pa.int64()), ("id", pa.int64()), ("tid", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.string())]
)
_SEGMENT_SQL = "key long, id long, tid int, start long, stop long, words string"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate windows of each document, in order of ``id``; without words: a settled range."""
    seen: dict[bytes, int] = {}
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        fields = zip(
            batch["id"].to_pylist(), batch["anchors"], batch["hot"], batch["copies"].to_pylist(),
            _opened(batch["packed"]), strict=True,
        )
        for doc, known, hot, copies, (text, (words, starts, ends)) in fields:
            own = anchors(words)
            if not len(own):
                continue
            if copies and _mark(words) in copies:
                rows.append((doc, doc, _text_key(words), 0, len(words), None))
                continue
            if not len(known.values):
                continue
            known = np.sort(known.values.to_numpy(zero_copy_only=False).view(np.uint64))
            found = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            if not found.any():
                continue
            hot = hot.values.to_numpy(zero_copy_only=False).view(np.uint64)
            tid, plain = _text_key(words), b" ".join(text.split())
            lengths = ends - starts
            begins = np.cumsum(lengths + 1) - lengths - 1
            single = found & np.isin(own, hot)
            if single.any():
                keys = shingles(words, WINDOW).view(np.int64)
                for k in np.flatnonzero(single).tolist():
                    piece = plain[begins[k] : begins[k + WINDOW - 1] + lengths[k + WINDOW - 1]]
                    first = seen.get(piece)
                    if first is None and len(seen) < SEEN_WINDOWS:
                        seen[piece] = doc
                    if first is not None and first < doc:
                        rows.append((doc, doc, tid, k, k + WINDOW, None))
                    else:
                        rows.append((int(keys[k]), doc, tid, k, k + WINDOW, piece.decode()))
                    held += len(piece)
            several = found & ~single
            edge = several.copy()
            edge[1:] &= ~several[:-1] | (own[1:] != own[:-1])
            for k in np.flatnonzero(edge).tolist():
                stop = k + 1
                while stop < len(own) and several[stop] and own[stop] == own[k]:
                    stop += 1
                last = stop + WINDOW - 2
                piece = plain[begins[k] : begins[last] + lengths[last]]
                rows.append((int(own[k].view(np.int64)), doc, tid, k, last + 1, piece.decode()))
                held += len(piece)
            if held > 1 << 20 or len(rows) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENT.types, strict=True)], schema=_SEGMENT)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENT.types, strict=True)], schema=_SEGMENT)


class _Shard:
    """Segments of some anchors, in order of (key, id); one word is one character."""

    def __init__(self):
        self.symbols: dict[str, str] = {}
        self.rows: list[tuple[int, int, int, str]] = []
        self.chars = 0

    def add(self, doc: int, tid: int, start: int, words: str) -> None:
        symbols = self.symbols
        line = []
        for w in words.split(" "):
            s = symbols.get(w)
            if s is None:
                code = len(symbols) + 1
                s = symbols[w] = chr(code if code < 0xD800 else code + 0x800)
            line.append(s)
        self.rows.append((doc, tid, start, "".join(line)))
        self.chars += len(words)

    def confirmed(self) -> dict[str, int]:
        """Phrases that start in different documents, with the first of these."""
        first: dict[str, int] = {}
        recurring: dict[str, int] = {}
        for doc, _, _, line in self.rows:
            for k in range(len(line) - WINDOW + 1):
                phrase = line[k : k + WINDOW]
                owner = first.setdefault(phrase, doc)
                if owner != doc:
                    recurring[phrase] = owner
        return recurring

    def ranges(self) -> Iterator[tuple[int, int, int, int]]:
        phrases = self.confirmed()
        if not phrases:
            return
        automaton = ahocorasick.Automaton()
        for phrase, owner in phrases.items():
            automaton.add_word(phrase, owner)
        automaton.make_automaton()
        for doc, tid, start, line in self.rows:
            begin = end = -1
            for last, owner in automaton.iter(line):
                if owner < doc:
                    if begin >= 0 and last - WINDOW + 1 > end:
                        yield doc, tid, start + begin, start + end
                        begin = -1
                    begin = last - WINDOW + 1 if begin < 0 else begin
                    end = last + 1
            if begin >= 0:
                yield doc, tid, start + begin, start + end


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("tid", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
    shard, current, out = _Shard(), None, []
    first: dict[str, int] = {}  # segments of the current key

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        fields = (batch[c].to_pylist() for c in ("key", "id", "tid", "start", "stop", "words"))
        for key, doc, tid, start, stop, words in zip(*fields, strict=True):
            if words is None:
                out.append((doc, tid, start, stop))
                continue
            if key != current:
                first = {}
                if shard.chars > SHARD_CHARS:
                    out.extend(shard.ranges())
                    shard = _Shard()
            current = key
            if first.setdefault(words, doc) != doc:
                out.append((doc, tid, start, stop))
            else:
                shard.add(doc, tid, start, words)
        if len(out) > 1 << 15:
            yield batch_of(out)
            out = []
    out.extend(shard.ranges())
    if out:
        yield batch_of(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows, held = [], 0
        for doc, ranges, text in zip(batch["id"].to_pylist(), batch["ranges"], _unpacked(batch["packed"]), strict=True):
            words = text.split()
            n_removed = 0
            if ranges.is_valid and len(ranges.values):
                column = pa.array([text], pa.large_binary()).cast(pa.large_string())
                tid = _text_key(next(iter(documents_words(column, False)))[0])
                own, start, stop = (ranges.values.field(c).to_numpy() for c in ("tid", "start", "stop"))
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, start[own == tid], 1)
                np.add.at(steps, stop[own == tid], -1)
                gone = (np.cumsum(steps[:-1]) > 0).tolist()
                n_removed = sum(gone)
                words_kept = [w for w, g in zip(words, gone, strict=True) if not g]
            else:
                words_kept = words
            kept = b" ".join(words_kept)
            rows.append((None if doc == _NO_ID else doc, len(words), n_removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
            held += len(kept)
            if held > 1 << 22:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def _recurring(texts: DataFrame) -> DataFrame:
    """Per document, its anchors that occur in other documents too: ``id, anchors, hot``."""
    counted = texts.mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    # How many documents an anchor can have is known before its rows are dealt out.
    many = counted.to_pandas().query("n > @SALT_ROWS").assign(salts=lambda x: -(-x["n"] // SALT_ROWS))
    rows = texts.mapInArrow(_anchor_rows, "anchor long, mark long, id long")
    salts = F.lit(1)
    if len(many):  # at most CELLS rows
        table = texts.sparkSession.createDataFrame(many[["cell", "salts"]], "cell long, salts long")
        rows = rows.withColumn("cell", F.col("anchor").bitwiseAND(CELLS - 1)).join(F.broadcast(table), "cell", "left").drop("cell")
        salts = F.coalesce("salts", F.lit(1))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    one = Window.partitionBy("anchor", "mark", "salt")
    rows = rows.withColumns(
        {"low": F.min("id").over(one), "high": F.max("id").over(one), "n": F.count("*").over(one)}
    )
    part = F.col("mark") == 0
    hot = part & ((salts > 1) | (F.col("n") > HOT))
    # A salted anchor counts as recurring: a superset is enough, windows are confirmed later.
    return (
        rows.filter((F.col("low") != F.col("high")) | (part & (salts > 1)))
        .groupBy("id")
        .agg(
            F.collect_list(F.when(part, F.col("anchor"))).alias("anchors"),
            F.collect_list(F.when(hot, F.col("anchor"))).alias("hot"),
            F.collect_list(F.when(~part & (F.col("id") > F.col("low")), F.col("mark"))).alias("copies"),
        )
    )


def removed_ranges(docs: DataFrame) -> DataFrame:
    """Ranges of words to remove: ``id, tid, start, stop``, per segment, overlapping where segments do."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text")
    packed = texts.mapInArrow(_squeeze, "id long, packed binary")
    candidates = packed.join(_recurring(texts), "id").select("id", "packed", "anchors", "hot", "copies")
    segments = candidates.sortWithinPartitions("id").mapInArrow(_segments, _SEGMENT_SQL)
    return (
        segments.repartition("key")
        .sortWithinPartitions("key", "id", "start")
        .mapInArrow(_ranges, "id long, tid int, start long, stop long")
    )


def cut_phrases(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, kept``, the kept words joined by one space."""
    ranges = materialise(removed_ranges(docs), "phrase-ranges")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text")
    per_doc = ranges.groupBy("id").agg(F.collect_list(F.struct("tid", "start", "stop")).alias("ranges"))
    packed = texts.mapInArrow(_squeeze, "id long, packed binary")
    return packed.join(per_doc, "id", "left").select("id", "packed", "ranges").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
