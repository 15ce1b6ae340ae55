"""Exact dedup by composable polynomial fingerprints, confirmed chunk by chunk.

A text's fingerprint is the value of its bytes (A-Z lower-cased) as a polynomial modulo two primes.
Chunks of ``CHUNK`` bytes are hashed side by side; two neighbours combine by shifting the left one by
the length of the right one, so a text of any length costs array passes over its chunks.  Rows of
equal fingerprint and length are then compared with the row that would stay, one chunk at a time
in a join on (keeper, chunk number); no task sees a whole group or a whole long text.  Rows that
differ in any chunk start a new round among themselves.

Defined cases: null text equals empty text; of rows with equal texts the largest ``doc_id`` stays (a
null id counts as smallest), and of repeated rows of that id one stays; an empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.words import buffers
from sievework.session import materialise

CHUNK = 1 << 16
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 16_777_619)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def powers(base: int, prime: int, n: int = CHUNK) -> np.ndarray:
    found = np.ones(n + 1, dtype=np.uint64)
    done = 1
    while done <= n:
        top = pow(base, done, prime)
        part = found[: min(done, n + 1 - done)]
        found[done : done + len(part)] = part * np.uint64(top) % np.uint64(prime)
        done *= 2
    return found


_POWERS = [powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per prime, the hash of every byte range of at most ``CHUNK`` bytes; ranges adjoin."""
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in PRIMES]
    place = np.repeat(ends - 1, ends - starts) - np.arange(starts[0], ends[-1])
    values = data[starts[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    return [
        np.add.reduceat(values * table[place], starts - starts[0]) % np.uint64(prime)
        for table, prime in zip(_POWERS, PRIMES, strict=True)
    ]


def combine(left: int, right: int, right_bytes: int, which: int) -> int:
    """Hash of two neighbouring parts, from their hashes and the right one's length."""
    return (left * pow(BASES[which], right_bytes, PRIMES[which]) + right) % PRIMES[which]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 62-bit fingerprint per text of the buffer."""
    lengths = np.diff(offsets)
    counts = (lengths + CHUNK - 1) // CHUNK
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + nth * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[owner + 1])
    result = np.zeros((2, len(lengths)), dtype=np.uint64)
    begin = 0
    while begin < len(starts):
        stop = max(begin + 1, int(np.searchsorted(starts, starts[begin] + (1 << 21))))
        for which, hashes in enumerate(chunk_hashes(data, starts[begin:stop], ends[begin:stop])):
            single = counts[owner[begin:stop]] == 1
            result[which][owner[begin:stop][single]] = hashes[single]
            for k in np.flatnonzero(~single):
                row = owner[begin + k]
                size = int(ends[begin + k] - starts[begin + k])
                result[which][row] = combine(int(result[which][row]), int(hashes[k]), size, which)
        begin = stop
    return (result[0] << np.uint64(31) | result[1]).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch["text"])
        data = _FOLD[data]
        prints = fingerprints(data, offsets)
        digests = [
            hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ]
        yield pa.record_batch(
            [batch["id"], pa.array(digests), pa.array(np.diff(offsets)), pa.array(prints)],
            names=["id", "text_sha256", "n_bytes", "print"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "text_sha256", "no", "chunk"]
    kind = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("no", pa.int64()), ("chunk", pa.binary())])
    for batch in batches:
        data, offsets = buffers(batch["text"])
        data, ids = _FOLD[data], batch["id"].to_pylist()
        out: list[list] = [[], [], [], []]
        held = 0
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            digest = hashlib.sha256(data[a:b]).hexdigest()
            for no, at in enumerate(range(a, b, CHUNK)):
                piece = data[at : min(b, at + CHUNK)].tobytes()
                for column, value in zip(out, (ids[row], digest, no, piece), strict=True):
                    column.append(value)
                held += len(piece)
                if held > 1 << 23:
                    yield pa.record_batch(dict(zip(names, out, strict=True)), schema=kind)
                    out, held = [[], [], [], []], 0
        yield pa.record_batch(dict(zip(names, out, strict=True)), schema=kind)


_NO_ID = -(1 << 63)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text"
    )
    hashed = materialise(
        texts.mapInArrow(_rows, "id long, text_sha256 string, n_bytes long, print long")
        .groupBy("id", "text_sha256", "n_bytes", "print")
        .agg(F.count("*").alias("copies")),
        "exact-prints",
    )
    settled = []
    open_rows = hashed
    for turn in itertools.count():
        keys = ["n_bytes", "print"]
        groups = open_rows.groupBy(*keys).agg(
            F.max(F.struct("id", "text_sha256")).alias("keeper"), F.count("*").alias("n")
        )
        grouped = materialise(open_rows.join(groups, keys), f"exact-groups{turn}")
        rivals = grouped.filter((F.col("n") > 1) & (F.col("n_bytes") > 0))
        pieces = texts.join(rivals.select("id").distinct(), "id", "left_semi").mapInArrow(
            _chunks, "id long, text_sha256 string, no long, chunk binary"
        )
        held = materialise(
            rivals.select("id", "text_sha256", "keeper")
            .join(pieces.dropDuplicates(["id", "text_sha256", "no"]) if turn else pieces, ["id", "text_sha256"])
            .select("id", "text_sha256", "keeper", "no", "chunk"),
            f"exact-chunks{turn}",
        )
        is_keeper = (F.col("id") == F.col("keeper.id")) & (F.col("text_sha256") == F.col("keeper.text_sha256"))
        of_keeper = (
            held.filter(is_keeper)
            .select("keeper", "no", F.col("chunk").alias("expected"))
            .dropDuplicates(["keeper", "no"])
        )
        differing = (
            held.filter(~is_keeper)
            .join(of_keeper, ["keeper", "no"], "left")
            .filter(~F.col("chunk").eqNullSafe(F.col("expected")))
            .select("id", "text_sha256")
            .distinct()
        )
        differing = materialise(differing, f"exact-differing{turn}")
        settled.append(grouped.join(differing, ["id", "text_sha256"], "left_anti"))
        if differing.isEmpty():
            break
        open_rows = hashed.join(differing, ["id", "text_sha256"], "left_semi")
    kept = settled[0]
    for part in settled[1:]:
        kept = kept.unionByName(part)
    sizes = kept.groupBy("keeper").agg(F.sum("copies").alias("group_size"))
    one_each = kept.join(sizes, "keeper").select(
        "id", "text_sha256", "keeper", "group_size",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"),
    )
    real = lambda c: F.when(c != F.lit(_NO_ID), c)
    return one_each.select(
        real(F.col("id")).alias("doc_id"),
        real(F.col("keeper.id")).alias("keep_id"),
        "group_size",
        ((F.col("id") == F.col("keeper.id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )
