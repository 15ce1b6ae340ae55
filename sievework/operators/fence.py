"""Keep dear columns from being copied into filters and joins.

The optimizer moves a filter on a computed column below the projection that
computes it, and copies the whole expression on the way.  For columns built from
dozens of regexes that doubles the work at each level.  A generator over a
one-element array yields the same rows and is not looked through, so what is
behind it is evaluated once per row, in the same stage, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, columns: list[str]) -> DataFrame:
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))
