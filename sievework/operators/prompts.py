"""Prompt tables for offline model jobs, and the tables read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import text as tx

LEVELS = [label for label, _ in lx.EDUCATION_LEVELS] + [lx.NO_EDUCATION]


def signals(scans: DataFrame, out: str = "signals") -> DataFrame:
    """Add the JSON of risk, AI and match signals; keys in alphabetical order."""
    record = F.struct(
        F.col("ai_text_likelihood").alias("ai_text_likelihood"),
        F.size("prompt_injection_findings").alias("injection_count"),
        F.col("match_analysis").alias("match"),
        F.col("risk_level").alias("risk_level"),
        F.col("risk_score").alias("risk_score"),
    )
    return scans.withColumn(out, F.to_json(record, {"ignoreNullFields": "false"}))


def _block(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), tx.escape_markup(body), F.lit(f"\n</{tag}>"))


def build_prompts(
    scans: DataFrame,
    kind: str,
    opening: str,
    closing: str,
    ask: str | None = None,
    out: str = "prompt",
) -> DataFrame:
    """Delimited, escaped data blocks between an opening and a closing line.

    ``kind``: ``facts`` (CV only), ``assessment`` (signals, CV, role) or ``followup``
    (signals, CV, question); ``ask`` names the role or question column.
    """
    if kind == "facts":
        blocks = [_block("cv", F.col("text"))]
    else:
        blocks = [
            _block("signals", F.col("signals")),
            _block("cv", F.col("safe_copy_text")),
        ]
        if kind == "followup":
            blocks.append(_block("question", F.col(ask)))
        else:
            role = F.nullif(F.col(ask), F.lit("")) if ask else F.lit(None).cast("string")
            blocks.append(_block("role", F.coalesce(role, F.lit("(none provided)"))))
    return scans.withColumn(
        out, F.concat_ws("\n\n", F.lit(opening), *blocks, F.lit(closing))
    )


def validate_model_facts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Read ``education_level`` and ``years_experience``; rows that fail any rule go.

    The whole response must be JSON, or else its first brace block.
    """
    cleaned = tx.strip_think(F.col(raw))
    block = F.regexp_extract(F.col("_clean"), r"\{[^{}]*\}", 0)
    kind = F.schema_of_variant(F.expr("try_variant_get(_v, '$.years_experience', 'variant')"))
    number = F.expr("try_variant_get(_v, '$.years_experience', 'double')")
    level_kind = F.schema_of_variant(
        F.expr("try_variant_get(_v, '$.education_level', 'variant')")
    )
    staged = (
        responses.withColumn("_clean", cleaned)
        .withColumn("_v", F.coalesce(F.try_parse_json("_clean"), F.try_parse_json(block)))
        .withColumns(
            {
                "education_level": F.when(
                    level_kind == "STRING",
                    F.expr("try_variant_get(_v, '$.education_level', 'string')"),
                ),
                "_kind": F.coalesce(kind, F.lit("VOID")),
                "_n": number,
            }
        )
    )
    numeric = F.col("_kind").rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$") & F.col("_n").between(0, 50)
    return (
        staged.filter(F.col("education_level").isin(LEVELS) & ((F.col("_kind") == "VOID") | numeric))
        .withColumn("years_experience", F.when(numeric, F.col("_n").cast("int")))
        .drop("_clean", "_v", "_kind", "_n", raw)
    )


REPORT_SCHEMA = (
    "framework string, headline string, "
    "dimensions array<struct<name:string,text:string,bullets:array<string>>>, "
    "overall_recommendation string, overall_score string, next_steps array<string>"
)


def parse_assessments(
    responses: DataFrame, raw: str = "raw", default_framework: str = "Candidate assessment"
) -> DataFrame:
    """Typed assessment columns with defaults; think blocks removed from every string."""

    def clean(c: Column, default: str = "") -> Column:
        return tx.strip_think(F.coalesce(c, F.lit(default)))

    def clean_all(c: Column) -> Column:
        return F.transform(
            F.coalesce(c, F.array().cast("array<string>")), lambda item: clean(item)
        )

    p = F.col("_p")
    empty = F.array().cast("array<struct<name:string,text:string,bullets:array<string>>>")
    return (
        responses.withColumn("_p", F.from_json(raw, REPORT_SCHEMA))
        .withColumns(
            {
                "framework": clean(p["framework"], default_framework),
                "headline": clean(p["headline"]),
                "dimensions": F.transform(
                    F.coalesce(p["dimensions"], empty),
                    lambda d: F.struct(
                        clean(d["name"]).alias("name"),
                        clean(d["text"]).alias("text"),
                        clean_all(d["bullets"]).alias("bullets"),
                    ),
                ),
                "overall_recommendation": clean(p["overall_recommendation"]),
                "overall_score": F.coalesce(
                    p["overall_score"].try_cast("double").cast("int"), F.lit(0)
                ),
                "next_steps": clean_all(p["next_steps"]),
            }
        )
        .drop("_p", raw)
    )
