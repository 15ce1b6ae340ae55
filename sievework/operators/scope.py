"""Tenant scope: a principal (user, organisation) sees its own rows and those of its organisation.

Rows are never multiplied by principals: they are first reduced per (user, organisation) cell, to
sums or to the best ``k``, and principals meet the few cells they may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.skew import rank_top

CELL = ["user_id", "org_id"]
PRINCIPAL = ["p_user", "p_org"]


def visible_to(rows: DataFrame, principals: DataFrame, user: str, org: str) -> DataFrame:
    """Rows each principal may see: its own, or those of its organisation.

    An OR join would be a nested loop; the two cases are disjoint equi-joins.
    ``principals`` carries ``p_user, p_org`` and any further columns.
    """
    own = principals.join(rows, F.col("p_user") == F.col(user))
    shared = principals.join(rows, F.col("p_org") == F.col(org)).filter(
        ~F.col(user).eqNullSafe(F.col("p_user"))
    )
    return own.unionByName(shared)


def summed_for(cells: DataFrame, principals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of all measures of the visible cells; zero for principals that see none.

    ``cells``: ``user_id, org_id``, ``keys`` and measures; ``principals``: ``p_user, p_org`` and, if
    there are ``keys``, every key a principal must have a row for.
    """
    keys = keys or []
    measures = [c for c in cells.columns if c not in (*CELL, *keys)]
    who = principals.select(*PRINCIPAL).distinct()
    seen = visible_to(cells, who, *CELL).select(*PRINCIPAL, *keys, *measures)
    zero = principals.select(*PRINCIPAL, *keys, *[F.lit(0).cast("long").alias(m) for m in measures])
    return (
        seen.unionByName(zero)
        .groupBy(*PRINCIPAL, *keys)
        .agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    )


def top_for(
    rows: DataFrame, principals: DataFrame, order: list[Column], k: int, keys: list[str] | None = None
) -> DataFrame:
    """The best ``k`` visible rows per principal (and ``keys``), with their ``rank``."""
    keys = keys or []
    best = rank_top(rows, [*CELL, *keys], order, k).drop("rank")
    seen = visible_to(best, principals.select(*PRINCIPAL).distinct(), *CELL)
    return rank_top(seen, [*PRINCIPAL, *keys], order, k)
