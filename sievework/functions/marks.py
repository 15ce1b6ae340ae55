"""Which patterns a text may hold, told for a whole Arrow batch by linear-time searches.

A mark is a bit that is set wherever its pattern matches, and seldom elsewhere: literals that every match contains, or
the shape of its figures.  One automaton looks for all literals of a group at once, so texts are read a few times
instead of once per literal.  The regexes that decide are only tried where their mark is set.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sievework.functions import lexicon as lx
from sievework.functions import regexes as rx
from sievework.functions.text import SPACES, STABLE

SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DIGIT = r"\p{Nd}"


def _word(literal: str) -> str:
    """A lower-case literal in any case; the dotted and dotless i count as i, as in ``regexes.fold_case``."""
    return "".join("[iıİ]" if c == "i" else re.escape(c) for c in literal)


def group(words: list[str]) -> str:
    """Any of these lower-case literals, in any case."""
    return "(?i)(?:" + "|".join(map(_word, words)) + ")"


_SHAPES = {
    "email": [r"[A-Za-z0-9._%+\-]@[A-Za-z0-9.\-]"],
    "nz_bank_account": [rf"{DIGIT}{{2}}-{DIGIT}{{4}}-{DIGIT}{{7}}-{DIGIT}{{2}}"],
    "nz_ird": [rf"{DIGIT}{{2}}[{SPACE}\-]{DIGIT}{{3}}[{SPACE}\-]{DIGIT}{{3}}"],
    "nz_passport": [rf"[A-Z]{{2}}{DIGIT}{{6}}"],
    "nz_drivers_licence": [rf"[A-Z]{{2}}{DIGIT}{{6}}"],
    "phone_nz": [rf"(?:\+64|0)[{SPACE}\-]?[2-9]{DIGIT}[{SPACE}\-]?{DIGIT}{{3}}[{SPACE}\-]?{DIGIT}{{4}}"],
    "phone_generic": [rf"{DIGIT}[{DIGIT}{SPACE}\-().]{{8}}"],
    "street_address": [rf"{DIGIT}[{SPACE}]+[A-Za-zıİſK]"],
    "visa_status": [rf"{DIGIT}{{4}}"],
    "dob": [DIGIT],
}
LONG_RUN = "long_run"
FAMILY_TESTS = {pid: [group(g) for g in rx.INJECTION_ANCHORS[pid]] for pid, _ in lx.INJECTION_FAMILIES}
TEXT_TESTS = {
    **{kind: _SHAPES.get(kind, []) + [group(g) for g in rx.PII_ANCHORS.get(kind, []) if kind not in ("email", "nz_bank_account")]
       for kind, _, _ in lx.PII_TYPES},
    **{body: [group([anchor])] for body, anchor in zip(lx.BUZZ_PHRASES, rx.BUZZ_ANCHORS)},
    LONG_RUN: ["[A-Za-z0-9+/_-]{20}"],
}
_PADDED = dict.fromkeys(lx.BUZZ_PHRASES, group(sorted(set(rx.BUZZ_ANCHORS))))
# Most types need a figure, which is looked for once.
_FIGURES = {kind: DIGIT for kind, shapes in _SHAPES.items() if DIGIT in shapes[0] and shapes[0] != DIGIT}
FEW = {**_PADDED, **_FIGURES}


def _re2(char_class: str) -> str:
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", char_class)


_INVISIBLE = _re2(lx.INVISIBLE_CLASS)
_UNSTABLE = f"[^{_re2(STABLE)}]"
_LOOKALIKE = "[" + "".join(lx.LOOKALIKES) + "]"
_FOLD = str.maketrans(lx.LOOKALIKES)


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False), bool)


def _found_in(texts: pa.Array, rows: np.ndarray, pattern: str) -> np.ndarray:
    """``_found``, where it can only be in these rows."""
    out = np.zeros(len(texts), bool)
    out[rows] = _found(texts.take(pa.array(rows)), pattern)
    return out


def _bits(texts: pa.Array, tests: dict[str, list[str]], any_of: dict[str, str] = FEW) -> np.ndarray:
    """A long per text, with bit ``k`` set where all patterns of the ``k``-th test are found.

    ``any_of``: for some tests, a pattern that few texts hold and that is found wherever theirs are.
    """
    known: dict[str, np.ndarray] = {}
    held: dict[str, pa.Array] = {}  # texts that hold a pattern of any_of
    out = np.zeros(len(texts), np.int64)
    for k, (name, patterns) in enumerate(tests.items()):
        anchor, left = (any_of[name], patterns) if name in any_of else (patterns[0], patterns[1:])
        if anchor not in known:
            known[anchor] = np.flatnonzero(_found(texts, anchor))
            if name in any_of:
                held[anchor] = texts.take(pa.array(known[anchor]))
        rows = known[anchor]
        some = held.get(anchor)
        for pattern in left:
            if len(rows):
                kept = _found(texts.take(pa.array(rows)) if some is None else some, pattern)
                rows, some = rows[kept], None
        out[rows] |= 1 << k
    return out


def seen(tests: dict[str, list[str]], any_of: dict[str, str] | None = None):
    """A function of a text column that gives ``marks`` by these tests, all set for null, and ``n_words`` of the text.

    ``any_of``: for tests that few texts pass, a pattern found wherever theirs are, to be tried once for all of them.
    """
    fields = [T.StructField("marks", T.LongType()), T.StructField("n_words", T.IntegerType())]

    @arrow_udf(T.StructType(fields))
    def look(texts: pa.Array) -> pa.Array:
        marks = np.where(np.asarray(texts.is_null()), -1, _bits(texts, tests, any_of or {}))
        return pa.StructArray.from_arrays([pa.array(marks), word_counts(texts)], ["marks", "n_words"])

    return look


_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[*range(9, 14), *range(28, 33)]] = True
_WIDE_SPACES = [c.encode() for c in SPACES if c > "\x7f"]
_WIDE_LEADS = np.zeros(256, bool)
_WIDE_LEADS[[wide[0] for wide in _WIDE_SPACES]] = True


def word_counts(texts: pa.Array) -> pa.Array:
    """Runs of anything but white space in each text; null for null."""
    if not len(texts):
        return pa.array([], pa.int32())
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    places = places - places[0]
    space = _SEPARATORS[held]
    if len(held) and held.max() > 127:
        leads = np.flatnonzero(_WIDE_LEADS[held])
        for wide in _WIDE_SPACES if len(leads) else []:
            at = leads[leads <= len(held) - len(wide)]
            for k, byte in enumerate(wide):
                at = at[held[at + k] == byte]
            for k in range(len(wide)):
                space[at + k] = True
    starts = ~space
    starts[1:] &= space[:-1]
    firsts = places[:-1][places[:-1] < places[1:]]
    starts[firsts] = ~space[firsts]
    counts = np.diff(np.searchsorted(np.flatnonzero(starts), places))
    return pa.array(counts.astype(np.int32), mask=np.asarray(texts.is_null()))


def _replaced(texts: pa.Array, rows: np.ndarray, values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts with new values in these rows, and these values alone, null elsewhere."""
    place = np.full(len(texts), -1)
    place[rows] = np.arange(len(rows))
    alone = values.cast(texts.type).take(pa.array(place, mask=place < 0))
    return pc.if_else(pa.array(place >= 0), alone, texts), alone


_SEEN = T.StructType(
    [T.StructField("stripped", T.StringType()), T.StructField("normalised", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("marks", "norm_marks", "families")]
    + [T.StructField("n_words", T.IntegerType())]
)


@arrow_udf(_SEEN)
def _examined(texts: pa.Array) -> pa.Array:
    plain = pc.equal(pc.binary_length(texts), pc.utf8_length(texts))
    wide = np.flatnonzero(~np.asarray(pc.fill_null(plain, True).to_numpy(zero_copy_only=False), bool))
    rows = np.flatnonzero(_found_in(texts, wide, _INVISIBLE))
    texts, stripped = _replaced(texts, rows, pc.replace_substring_regex(texts.take(pa.array(rows)), _INVISIBLE, ""))
    marks = _bits(texts, TEXT_TESTS)
    families = _bits(texts, FAMILY_TESTS)
    unstable = _found_in(texts, wide, _UNSTABLE)
    rows = np.flatnonzero(unstable | _found_in(texts, wide, _LOOKALIKE))
    kept = texts.take(pa.array(rows)).to_pylist()
    folded = [(unicodedata.normalize("NFKC", t) if u else t).translate(_FOLD) for t, u in zip(kept, unstable[rows])]
    changed = pa.array(folded, pa.string())
    families[rows] = _bits(changed, FAMILY_TESTS)
    norm_marks = marks.copy()
    norm_marks[rows] = _bits(changed, TEXT_TESTS)
    columns = [stripped, _replaced(texts, rows, changed)[1], *map(pa.array, (marks, norm_marks, families)), word_counts(texts)]
    return pa.StructArray.from_arrays(columns, _SEEN.names)


def examined(text: Column) -> Column:
    """``stripped`` (without invisible characters; null where that is the text itself), ``normalised`` of that (NFKC,
    lookalikes folded; null likewise), ``marks`` and ``n_words`` of the stripped text, ``norm_marks`` and ``families``,
    marks of the normalised text."""
    return _examined(text)


def marked(marks: str, tests: dict[str, list[str]], name: str) -> str:
    """SQL test of a mark."""
    return f"({marks} & {1 << list(tests).index(name)}L) <> 0L"
