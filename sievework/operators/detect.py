"""Hidden instructions, personal data, padded prose, and the risk they add up to.

All of it is narrow: one pass over each document, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import marks as mk
from sievework.functions import regexes as rx
from sievework.functions import text as tx
from sievework.functions.spans import marked_spans_sql, snippet_sql, spans_sql, suppress_overlaps_sql
from sievework.operators.fence import fence

INJECTION_TYPE = "array<struct<pattern_id:string,matched_text:string,context:string>>"
PII_SPAN_TYPE = "array<struct<pii_type:string,start:int,end:int,matched_text:string>>"
PII_TYPE = "array<struct<pii_type:string,matched_text:string>>"


_NO_INJECTIONS = f"cast(array() AS {INJECTION_TYPE})"
_NO_PII = f"cast(array() AS {PII_SPAN_TYPE})"


def _family_sql(text: str, family: str, spans=spans_sql) -> str:
    regex = dict(rx.INJECTIONS)[family]
    return (
        f"transform({spans(text, regex)}, f -> named_struct('pattern_id', '{family}', "
        f"'matched_text', f.match, 'context', {snippet_sql(text, 'f.start', 'f.`end`')}))"
    )


def family_findings(text: str, family: str) -> Column:
    """Findings of one family in a column of already normalised text."""
    regex = rx.literal(dict(rx.INJECTIONS)[family])
    return F.expr(
        f"CASE WHEN {text} RLIKE {regex} THEN {_family_sql(text, family)} "
        f"ELSE {_NO_INJECTIONS} END"
    )


def injections_in(text: str, families: str) -> Column:
    """All families, in family order.  Families are not de-duplicated against each other.

    ``text``: column without invisible characters.

    ``families``: column of families known to occur, see ``regexes.families_present``.
    """
    parts = [
        f"CASE WHEN array_contains({families}, '{family}') THEN {_family_sql(text, family, marked_spans_sql)} "
        f"ELSE {_NO_INJECTIONS} END"
        for family, _ in rx.INJECTIONS
    ]
    return F.expr(
        f"CASE WHEN size({families}) > 0 THEN concat({', '.join(parts)}) "
        f"ELSE {_NO_INJECTIONS} END"
    )


def base64_injections(decoded: str, normalised: str) -> Column:
    """Findings inside decoded strings; ``normalised[i]`` is the folded ``decoded[i]``."""
    parts = [
        f"transform(regexp_extract_all(norm, {rx.literal(regex)}, 0), m -> named_struct("
        f"'pattern_id', '{family}', 'matched_text', concat('[base64] ', m), "
        "'context', concat('Decoded from base64: ', plain)))"
        for family, regex in rx.INJECTIONS
    ]
    inside = (
        f"CASE WHEN norm RLIKE {rx.literal(rx.ANY_INJECTION)} THEN concat({', '.join(parts)}) "
        f"ELSE {_NO_INJECTIONS} END"
    )
    return F.expr(
        f"CASE WHEN size({decoded}) > 0 "
        f"THEN flatten(zip_with({decoded}, {normalised}, (plain, norm) -> {inside})) "
        f"ELSE {_NO_INJECTIONS} END"
    )


def _typed_sql(text: str, kind: str, spans=spans_sql) -> str:
    return (
        f"transform({spans(text, dict(rx.PII)[kind])}, f -> named_struct('pii_type', '{kind}', "
        "'start', f.start, 'end', f.`end`, 'matched_text', f.match))"
    )


def typed_spans(text: str, kinds: str) -> Column:
    """Matches of every personal-data type, before the priority rule."""
    return F.expr(f"concat({', '.join(_typed_groups(text, kinds))})")


def _typed_groups(text: str, kinds: str, spans=spans_sql) -> list[str]:
    return [
        f"CASE WHEN array_contains({kinds}, '{kind}') THEN {_typed_sql(text, kind, spans)} "
        f"ELSE {_NO_PII} END"
        for kind, _ in rx.PII
    ]


def pii_spans(text: str, kinds: str, spans=spans_sql) -> Column:
    """Personal data with offsets, after the priority rule.

    ``spans``: ``marked_spans_sql`` where ``text`` holds no invisible characters.
    ``kinds``: column of types known to occur, see ``regexes.pii_present``.
    """
    kept = suppress_overlaps_sql(_typed_groups(text, kinds, spans), PII_SPAN_TYPE)
    return F.expr(f"CASE WHEN size({kinds}) > 0 THEN {kept} ELSE {_NO_PII} END")


def without_offsets(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["pii_type"].alias("pii_type"), s["matched_text"].alias("matched_text")
        ),
    )


def first_pii(findings: Column, kind: str) -> Column:
    return F.get(F.filter(findings, lambda f: f["pii_type"] == kind), F.lit(0))["matched_text"]


def buzz_score(text: str, lowered: str, words: Column, marked=None) -> Column:
    """Distinct padded phrases over ten, capped at 1; short texts score 0."""
    hits = rx.buzz_hits(text, lowered, marked)
    return F.when(words > 50, F.least(F.lit(1.0), hits / F.lit(10.0))).otherwise(F.lit(0.0))


def ai_label(score: Column) -> Column:
    return (
        F.when(score >= 0.6, "LIKELY").when(score >= 0.3, "POSSIBLE").otherwise("UNLIKELY")
    )


def risk_score(injections: Column, pii: Column, score: Column) -> Column:
    n_inj = F.size(injections)
    n_sensitive = F.size(F.filter(pii, lambda f: f["pii_type"].isin(lx.SENSITIVE_PII)))
    n_other = F.size(pii) - n_sensitive
    from_inj = F.when(n_inj > 0, 60 + F.least(F.lit(20), n_inj * 5)).otherwise(0)
    from_pii = F.least(F.lit(40), n_sensitive * 8 + n_other * 2)
    from_ai = F.when(score >= 0.6, 10).when(score >= 0.3, 5).otherwise(0)
    return F.least(F.lit(100), from_inj + from_pii + from_ai)


def risk_level(injections: Column, score: Column) -> Column:
    return (
        F.when((F.size(injections) > 0) | (score >= 70), "RED")
        .when(score >= 30, "ORANGE")
        .otherwise("GREEN")
    )


def scan_summary(injections: Column, pii: Column, label: Column) -> Column:
    n_inj, n_pii = F.size(injections), F.size(pii)
    parts = F.array_compact(
        F.array(
            F.when(
                n_inj > 0,
                F.concat(
                    n_inj.cast("string"),
                    F.lit(
                        " hidden instruction(s) found — do not paste this CV into an AI tool."
                    ),
                ),
            ),
            F.when(
                n_pii > 0,
                F.concat(n_pii.cast("string"), F.lit(" personal data item(s) flagged.")),
            ),
            F.when(
                label != "UNLIKELY",
                F.concat(F.lit("Text "), F.lower(label), F.lit(" written by AI.")),
            ),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(
        "No issues detected. CV appears safe for AI workflow use."
    )


def rank_findings(injections: Column) -> Column:
    """Longest match first; equal lengths keep their order."""
    numbered = F.transform(
        injections,
        lambda f, i: F.struct(
            (-F.length(f["matched_text"])).alias("neg_len"), i.alias("ord"), f.alias("f")
        ),
    )
    return F.transform(F.array_sort(numbered), lambda x: x["f"])


def finding_counts(scans: DataFrame) -> DataFrame:
    n_inj, n_pii = F.size("prompt_injection_findings"), F.size("pii_findings")
    return scans.withColumns(
        {
            "injection_count": n_inj,
            "pii_count": n_pii,
            "all_clear": (F.col("risk_level") == "GREEN")
            & (n_inj == 0)
            & (n_pii == 0)
            & (F.col("ai_text_likelihood") == "UNLIKELY"),
        }
    )


# ------------------------------------------------------------------ DataFrame level


def normalise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the forms of the text that detection reads, each in its own column.

    ``stripped`` (invisible characters removed), ``normalised`` (NFKC, lookalikes
    folded), ``decoded``/``decoded_norm`` (base64 runs), ``lowered``, ``families``: the
    hidden-instruction families present in ``normalised``, ``marks`` and ``norm_marks``: what ``stripped`` and
    ``normalised`` may hold, and ``n_words`` of ``stripped``.
    """
    forms = (
        docs.withColumn("_seen", mk.examined(F.col(text)))
        .withColumns(
            {
                "stripped": F.coalesce("_seen.stripped", text),
                "_other": F.col("_seen.normalised"),
                "_families": F.col("_seen.families"),
                **{name: F.col(f"_seen.{name}") for name in ("marks", "norm_marks", "n_words")},
            }
        )
        .drop("_seen")
        .withColumn(
            "decoded",
            tx.decode_base64_tokens(F.col("stripped"), F.expr(mk.marked("marks", mk.TEXT_TESTS, mk.LONG_RUN))),
        )
        .withColumn("decoded_norm", tx.nfkc_each(F.col("decoded")))
        .withColumns(
            {
                "normalised": F.coalesce("_other", "stripped"),
                "decoded_norm": F.transform("decoded_norm", tx.fold_lookalikes),
                "lowered": rx.fold_case(F.col("stripped")),
            }
        )
        .withColumn(
            "_norm_lowered",
            F.when(F.col("_other").isNull(), F.col("lowered")).otherwise(rx.fold_case(F.col("normalised"))),
        )
        .withColumn(
            "families",
            rx.families_present("normalised", "_norm_lowered", lambda f: mk.marked("_families", mk.FAMILY_TESTS, f)),
        )
        .drop("_norm_lowered", "_families", "_other")
    )
    return fence(forms, WORK_COLUMNS)


def text_marked(name: str) -> str:
    """SQL: the stripped text may hold this type or phrase."""
    return mk.marked("marks", mk.TEXT_TESTS, name)


def detect(normalised_docs: DataFrame) -> DataFrame:
    """Add findings and scores to the output of :func:`normalise`."""
    scored = (
        normalised_docs.withColumn("_kinds", rx.pii_present("stripped", "lowered", "", text_marked))
        .withColumns(
            {
                "prompt_injection_findings": F.concat(
                    injections_in("normalised", "families"),
                    base64_injections("decoded", "decoded_norm"),
                ),
                "pii_findings": without_offsets(pii_spans("stripped", "_kinds", marked_spans_sql)),
                "ai_text_score": buzz_score("stripped", "lowered", F.col("n_words"), text_marked),
            }
        )
        .withColumns(
            {
                "ai_text_likelihood": ai_label(F.col("ai_text_score")),
                "risk_score": risk_score(
                    F.col("prompt_injection_findings"),
                    F.col("pii_findings"),
                    F.col("ai_text_score"),
                ),
            }
        )
        .withColumns(
            {
                "risk_level": risk_level(
                    F.col("prompt_injection_findings"), F.col("risk_score")
                ),
                "summary": scan_summary(
                    F.col("prompt_injection_findings"),
                    F.col("pii_findings"),
                    F.col("ai_text_likelihood"),
                ),
            }
        )
    )
    return fence(scored.drop("_kinds"), RISK_COLUMNS)


RISK_COLUMNS = [
    "prompt_injection_findings", "pii_findings", "ai_text_score", "ai_text_likelihood",
    "risk_score", "risk_level", "summary",
]
WORK_COLUMNS = [
    "stripped", "normalised", "decoded", "decoded_norm", "lowered", "families", "n_words", "marks", "norm_marks",
]


def scan_risk(docs: DataFrame, text: str = "text") -> DataFrame:
    """Findings, score, level and summary per document, without redaction or analysis."""
    return detect(normalise(docs, text)).drop(*WORK_COLUMNS)
