"""Match spans with offsets, built from split and extract (no Python per row).

The expressions are written as SQL text over column names: they nest deeply, and
one call to the JVM replaces hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.regexes import literal

BLOCK = 256
SPAN_TYPE = "array<struct<start:int,end:int,match:string>>"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sums(part: str) -> str:
    return (
        f"aggregate({part}, cast(array() AS array<int>), "
        "(acc, x) -> concat(acc, array(x + coalesce(get(acc, size(acc) - 1), 0))))"
    )


def running_totals_sql(lengths: str) -> str:
    """Inclusive prefix sums of an int array.

    Long arrays are summed in blocks of fixed size that are then shifted, so the
    cost grows as n * block rather than n squared in documents with many matches.
    """
    blocks = f"transform(sequence(1, size(xs), {BLOCK}), s -> {_sums(f'slice(xs, s, {BLOCK})')})"
    ends = _sums("transform(bs, b -> get(b, size(b) - 1))")
    shifted = (
        f"flatten(zip_with(bs, slice(concat(array(0), {ends}), 1, size(bs)), "
        "(b, o) -> transform(b, y -> y + o)))"
    )
    both = (
        f"CASE WHEN size(xs) <= {BLOCK} THEN {_sums('xs')} "
        f"ELSE {let(blocks, 'bs', shifted)} END"
    )
    return let(lengths, "xs", both)


def spans_sql(text: str, regex: str) -> str:
    """Every non-overlapping match, left to right; for texts known to hold a match.

    Offsets are code points from 0; ``end`` is exclusive.
    """
    lengths = (
        f"zip_with(slice(split({text}, {literal(regex)}, -1), 1, size(found)), found, "
        "(g, m) -> length(g) + length(m))"
    )
    placed = (
        f"zip_with({running_totals_sql(lengths)}, found, "
        "(e, m) -> named_struct('start', e - length(m), 'end', e, 'match', m))"
    )
    return let(f"regexp_extract_all({text}, {literal(regex)}, 0)", "found", placed)


MARK = "\u200b"


def marked_spans_sql(text: str, regex: str) -> str:
    """``spans_sql`` in one pass of the regex, for texts without invisible characters, which ``MARK`` is one of.

    Matches are put between marks, and the text is cut at these: every second piece is a match.
    """
    mark = literal(MARK)
    pieces = f"split(regexp_replace({text}, {literal(regex)}, {literal(MARK + '$0' + MARK)}), {mark}, -1)"
    ends = running_totals_sql("transform(ps, p -> length(p))")
    placed = (
        "transform(sequence(1, cast(size(ps) div 2 AS int)), i -> named_struct("
        "'start', get(es, 2 * i - 2), 'end', get(es, 2 * i - 1), 'match', get(ps, 2 * i - 1)))"
    )
    return let(
        pieces, "ps", f"CASE WHEN size(ps) > 1 THEN {let(ends, 'es', placed)} ELSE cast(array() AS {SPAN_TYPE}) END"
    )


def find_spans(text: str, regex: str) -> Column:
    """``spans_sql`` for any text; empty where nothing matches."""
    return F.expr(
        f"CASE WHEN {text} RLIKE {literal(regex)} THEN {spans_sql(text, regex)} "
        f"ELSE cast(array() AS {SPAN_TYPE}) END"
    )


def touched_lines_sql(text: str, regex: str, mark: str = "\u200b") -> str:
    """array<boolean>, one per line: does a match touch the line?

    Every line of every match is tagged with ``mark``, a character the caller
    guarantees to be absent from ``text``.
    """
    m, tag = literal(mark), literal("\n" + mark)
    # Every second piece is a match, as in marked_spans_sql.
    pieces = f"split(regexp_replace({text}, {literal(regex)}, {literal(mark + '$0' + mark)}), {m}, -1)"
    tagged = f"transform({pieces}, (p, i) -> CASE WHEN i % 2 = 1 THEN concat({m}, replace(p, '\\n', {tag})) ELSE p END)"
    rebuilt = f"array_join({tagged}, '')"
    return f"transform(split({rebuilt}, '\\n', -1), l -> contains(l, {m}))"


def snippet_sql(text: str, start: str, end: str, reach: int = 30) -> str:
    left = f"greatest({start} - {reach}, 0)"
    piece = f"substring({text}, {left} + 1, {end} + {reach} - {left})"
    return f"concat('...', replace({piece}, '\\n', ' '), '...')"


FEW_PAIRS = 256


def _before_sql(kept: str, points: str, tie: str) -> str:
    """Per point, in order: how many of ``kept`` stand before it; ``tie`` says which side goes first."""
    first, second = ("0", "1") if tie == "kept" else ("1", "0")
    merged = (
        f"array_sort(concat(transform({kept}, p -> named_struct('at', p, 'side', {first}, 'point', false)), "
        f"transform({points}, p -> named_struct('at', p, 'side', {second}, 'point', true))))"
    )
    placed = f"transform({merged}, (x, i) -> named_struct('i', i, 'point', x.point))"
    return f"transform(filter({placed}, x -> x.point), (x, j) -> x.i - j)"


def suppress_overlaps_sql(groups: list[str], kept_type: str) -> str:
    """Fold span arrays in priority order.

    A span is dropped when its start or its end falls inside a span kept from an
    earlier group.  Spans of one group are in order and never overlap, so whole groups are
    filtered at once.  A few are compared with each other; of many, starts and ends are merged with those
    of the kept spans in one sort: a point is inside a span where more have begun than ended.
    """
    clash = (
        "exists(kept, k -> (k.start <= s.start AND s.start < k.`end`) "
        "OR (k.start < s.`end` AND s.`end` <= k.`end`))"
    )
    swept = "filter(grp, (s, j) -> get(sb, j) <= get(se, j) AND get(eb, j) <= get(ee, j))"
    for name, kept, points, tie in (
        ("ee", "kept.`end`", "grp.`end`", "point"),
        ("eb", "kept.start", "grp.`end`", "point"),
        ("se", "kept.`end`", "grp.start", "kept"),
        ("sb", "kept.start", "grp.start", "kept"),
    ):
        swept = let(_before_sql(kept, points, tie), name, swept)
    return (
        f"aggregate(array({', '.join(groups)}), cast(array() AS {kept_type}), "
        f"(kept, grp) -> concat(kept, CASE WHEN cast(size(kept) AS bigint) * size(grp) <= {FEW_PAIRS} "
        f"THEN filter(grp, s -> NOT {clash}) ELSE {swept} END))"
    )
