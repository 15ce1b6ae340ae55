"""Candidate and job imports: clean, reject, de-duplicate.

Input order (``row_no``, unique) is part of the contract: the first of equal rows wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import text as tx
from sievework.operators.scope import CELL
from sievework.operators.skew import first_per_key, flag_members

def _cleaned(
    rows: DataFrame, aliases: dict[str, list[str]], widths: dict[str, int] | None
) -> dict[str, Column]:
    """Whole cells; a caller with fixed column widths passes them by target column."""

    def pick(target: str, names: list[str]) -> Column:
        present = [F.col(n) for n in names if n in rows.columns]
        if not present:
            return F.lit(None).cast("string")
        return tx.clean_cell(tx.first_alias(*present), (widths or {}).get(target))

    return {target: pick(target, names) for target, names in aliases.items()}


def clean_candidates(
    rows: DataFrame, keep: list[str], widths: dict[str, int] | None = None
) -> DataFrame:
    cleaned = _cleaned(rows, lx.CANDIDATE_ALIASES, widths)
    return rows.select(*keep, *[c.alias(n) for n, c in cleaned.items()])


def clean_jobs(rows: DataFrame, keep: list[str], widths: dict[str, int] | None = None) -> DataFrame:
    present = [F.col(n) for n in lx.SKILL_ALIASES if n in rows.columns]
    raw = F.coalesce(tx.first_alias(*present), F.lit("")) if present else F.lit("")
    return rows.select(
        *keep,
        *[c.alias(n) for n, c in _cleaned(rows, lx.JOB_ALIASES, widths).items()],
        tx.split_skills(raw).alias("required_skills"),
    )


def _disposition(
    cleaned: DataFrame, keys: list[str], existing: DataFrame, usable: Column, keyed: Column
) -> DataFrame:
    """created / skipped / invalid per row.

    A row is a duplicate if its keys exist among what its principal may see (rows of its user, or
    of its organisation), or earlier in the same principal's import.

    The winner of each key is its lowest ``row_no``; rows meet the winners again
    through ``row_no``, which is unique, so a key shared by very many rows is no
    hot spot.
    """
    firsts = first_per_key(cleaned.filter(usable & keyed), [*CELL, *keys], "row_no")
    for owner in CELL:
        firsts = firsts.join(existing.select(owner, *keys).distinct(), [owner, *keys], "left_anti")
    flagged = flag_members(cleaned, firsts, "row_no", "_first")
    return flagged.withColumn(
        "disposition",
        F.when(~usable, "invalid")
        .when(F.col("_first") | ~keyed, "created")
        .otherwise("skipped"),
    ).drop("_first")


def plan_candidates(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows``: user_id, org_id, row_no and string cells; ``existing``: candidates with email."""
    cleaned = clean_candidates(rows, [*CELL, "row_no"]).withColumn("_key", F.lower("email"))
    have = existing.filter(F.coalesce(F.col("email"), F.lit("")) != "").select(
        *CELL, F.lower("email").alias("_key")
    )
    plan = _disposition(
        cleaned, ["_key"], have, F.col("full_name").isNotNull(), F.col("_key").isNotNull()
    )
    return plan.drop("_key")


def plan_jobs(rows: DataFrame, existing: DataFrame) -> DataFrame:
    cleaned = clean_jobs(rows, [*CELL, "row_no"]).withColumns(
        {
            "_title": F.lower("title"),
            "_client": F.lower(F.coalesce("client_name", F.lit(""))),
        }
    )
    have = existing.select(
        *CELL,
        F.lower("title").alias("_title"),
        F.lower(F.coalesce("client_name", F.lit(""))).alias("_client"),
    )
    plan = _disposition(
        cleaned, ["_title", "_client"], have, F.col("title").isNotNull(), F.lit(True)
    )
    return plan.drop("_title", "_client")


def import_counts(plan: DataFrame, *keys: str) -> DataFrame:
    return plan.groupBy(*keys).agg(
        *[F.count_if(F.col("disposition") == d).alias(d) for d in ("created", "skipped", "invalid")]
    )
