"""Words, hashes and shingles of whole texts, vectorised over Arrow string buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.  Word hashes are differences of one running polynomial over the bytes, so a
million bytes cost a handful of array passes.  Long texts are cut between words into blocks of
``BLOCK`` bytes: memory follows the block, and of a document only its word hashes are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(
    1, _MASK, 256, dtype=np.uint64, endpoint=True
)
_FOLDED = _RANDOM.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _RANDOM[ord("a") : ord("z") + 1]


def word_count(text: Column) -> Column:
    """Number of words as a native expression; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that helper columns beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer word comes."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base & _MASK))
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def text_slices(batch: pa.RecordBatch, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of ``text``, or of one row."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        begun = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, begun + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _block(data: np.ndarray, cuts: np.ndarray, table: np.ndarray):
    """Hashes, starts and ends of the words of one block; ``cuts`` are where documents begin."""
    word = ~_SEPARATOR[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.upto(len(data))
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=running[1:])
    hashes = (running[ends] - running[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def documents_words(
    column: pa.Array, fold: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row: word hashes, and the words' byte ranges within the row's text."""
    table = _FOLDED if fold else _RANDOM
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        begin = offsets[row]
        stop = max(row + 1, int(np.searchsorted(offsets, begin + BLOCK, side="right")) - 1)
        stop = min(stop, n)
        if offsets[stop] - begin <= BLOCK:
            cuts = offsets[row : stop + 1] - begin
            hashes, starts, ends = _block(data[begin : offsets[stop]], cuts, table)
            bounds = np.searchsorted(starts, cuts)
            for k in range(stop - row):
                a, b = bounds[k], bounds[k + 1]
                yield hashes[a:b], starts[a:b] - cuts[k], ends[a:b] - cuts[k]
        else:
            yield _long_text(data[begin : offsets[stop]], table)
        row = stop


def _long_text(data: np.ndarray, table: np.ndarray):
    parts, at, none = [], 0, np.zeros(0, dtype=np.int64)
    while at < len(data):
        end, step = min(at + BLOCK, len(data)), BLOCK
        while end < len(data):
            gaps = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            step *= 2
            end = min(at + step, len(data))
        hashes, starts, ends = _block(data[at:end], none, table)
        parts.append((hashes, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash per window of ``width`` words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    found = np.full(n, np.uint64(width))
    for k in range(width):
        found = found * _STEP + words[k : k + n]
    return mix(found)
