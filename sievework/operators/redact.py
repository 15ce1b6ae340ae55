"""Safe copies: hidden instructions removed line by line, personal data tagged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import regexes as rx
from sievework.functions import text as tx
from sievework.functions.marks import TEXT_TESTS, marked
from sievework.functions.spans import touched_lines_sql
from sievework.operators.fence import fence

_MARK = lx.REMOVED_LINE


def remove_injected_lines(text: str, families: str) -> Column:
    """array<string>: lines, with every line touched by a match replaced by the marker.

    Matches are found in the whole text, so an instruction broken over lines goes
    as a whole.  ``text`` must be normalised (no zero-width characters); ``families``
    are the families known to occur in it.
    """
    lines = f"split({text}, '\\n', -1)"
    flags = f"transform({lines}, l -> false)"
    for family, regex in rx.INJECTIONS:
        touched = (
            f"CASE WHEN array_contains({families}, '{family}') "
            f"THEN {touched_lines_sql(text, regex)} END"
        )
        # A family that does not occur yields null, which zip_with would spread.
        flags = f"zip_with({flags}, coalesce({touched}, array()), (x, y) -> x OR coalesce(y, false))"
    return F.expr(
        f"zip_with({lines}, {flags}, (l, hit) -> CASE WHEN hit THEN {rx.literal(_MARK)} ELSE l END)"
    )


def collapse_markers(lines: Column) -> Column:
    return F.filter(
        lines,
        lambda line, i: ~((line == _MARK) & (i > 0) & (F.get(lines, i - 1) == _MARK)),
    )


def sweep_lines(lines: Column) -> Column:
    return F.transform(
        lines, lambda line: F.when(line.rlike(rx.ANY_INJECTION), _MARK).otherwise(line)
    )


def annotate_pii(text: Column, kinds: Column | None = None) -> Column:
    """Tag personal data type by type, then trim.

    ``kinds``: the types known to occur in ``text``; others are not searched for.  A
    visa match may end inside a word and so set free a later type, so once one
    occurs the later types are always searched for.
    """
    names = [kind for kind, _ in rx.PII]
    after_visa = names[names.index("visa_status") + 1 :]

    if kinds is None:
        steps = reduce(lambda acc, p: F.regexp_replace(acc, p[1], f"[PII:{p[0].upper()}]"), rx.PII, text)
        return tx.trim_space(steps)
    return tx.trim_space(
        F.aggregate(
            F.filter(F.array(*[F.lit(n) for n in names]), lambda n: _wanted(n, kinds, after_visa)),
            text,
            lambda acc, n: _tag_one(acc, n),
        )
    )


def _wanted(name: Column, kinds: Column, after_visa: list[str]) -> Column:
    freed = name.isin(after_visa) & F.array_contains(kinds, "visa_status")
    return F.array_contains(kinds, name) | freed


def _tag_one(text: Column, name: Column) -> Column:
    out = F
    for kind, regex in rx.PII:
        out = out.when(name == kind, F.regexp_replace(text, regex, f"[PII:{kind.upper()}]"))
    return out.otherwise(text)


def add_safe_copy(normalised_docs: DataFrame, out: str = "safe_copy_text") -> DataFrame:
    """Add the redacted copy to the output of ``detect.normalise``.

    The line work is staged in its own column and only done for documents that
    hold an instruction.
    """
    copied = (
        normalised_docs.withColumn(
            "_lines",
            F.when(
                F.size("families") > 0, remove_injected_lines("normalised", "families")
            ),
        )
        .withColumn("_lines", F.when(F.col("_lines").isNotNull(), collapse_markers(F.col("_lines"))))
        .withColumn("_left", F.array_join("_lines", "\n"))
        .withColumn("_left_low", rx.fold_case(F.col("_left")))
        # A family that matches in a line matches in the text, so only a text where one does needs the sweep.
        .withColumn(
            "_clean",
            F.when(rx.holds_any("_left", "_left_low", "families"), F.array_join(sweep_lines(F.col("_lines")), "\n")).otherwise(
                F.coalesce("_left", "normalised")
            ),
        )
        .withColumn(
            "_low",
            F.when(F.col("_clean") == F.col("stripped"), F.col("lowered"))
            .when(F.col("_clean") == F.col("_left"), F.col("_left_low"))
            .otherwise(rx.fold_case(F.col("_clean"))),
        )
        # Between the markers, whose brackets no type matches, stand whole lines of the normalised text, so its marks hold.
        .withColumn("_kinds", rx.pii_present("_clean", "_low", "", lambda kind: marked("norm_marks", TEXT_TESTS, kind)))
        .withColumn(
            out,
            F.when(F.size("_kinds") > 0, annotate_pii(F.col("_clean"), F.col("_kinds"))).otherwise(
                tx.trim_space(F.col("_clean"))
            ),
        )
        .drop("_lines", "_left", "_left_low", "_clean", "_low", "_kinds")
    )
    return fence(copied, [out])
