"""Counts kept up to date: cells change by what rows leave and what rows come.

A change to a table is a pair of row sets: the rows as they were (``before``; none for new rows) and as they are
(``after``; none for deleted ones).  Counting both and subtracting gives the change of every cell concerned,
so the table itself is never counted again.  Cells live in a ``BucketTable``: a batch rewrites the buckets
of its cells, and a repeated batch ends in the same counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import materialise
from sievework.sources.buckets import BucketTable


def cell_key(keys: list[str]) -> Column:
    """One text for the values of ``keys``, nulls included."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def changed_cells(
    before: DataFrame, after: DataFrame, count: Callable[[DataFrame], DataFrame], keys: list[str]
) -> DataFrame:
    """``keys`` and the change of every measure of ``count``; cells whose counts stay are left out.

    ``count`` turns rows into ``keys`` and sums over them.
    """
    now, was = count(after), count(before)
    measures = [c for c in now.columns if c not in keys]
    minus = was.select(*keys, *[(-F.col(m)).alias(m) for m in measures])
    summed = now.unionByName(minus).groupBy(*keys).agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    return summed.filter(" OR ".join(f"`{m}` <> 0" for m in measures))


class Cells:
    """Stored counts by ``keys``; ``types`` gives the SQL type of every key."""

    def __init__(self, spark: SparkSession, path: str, types: dict[str, str], measures: list[str], buckets: int = 64):
        self.spark, self.path, self.types, self.measures, self.buckets = spark, path, types, measures, buckets

    def _table(self, before: int | None = None) -> BucketTable:
        columns = {"cell": "string", **self.types, **dict.fromkeys(self.measures, "long")}
        schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        return BucketTable(self.spark, self.path, schema, ["cell"], None, self.buckets, before)

    def apply(self, version: int, changes: DataFrame) -> list[int]:
        """Add ``changes`` (see ``changed_cells``) as ``version``; cells that come to nothing go.
        Returns the buckets written."""
        keys = list(self.types)
        table = self._table(before=version)
        table.vacuum()
        news = materialise(changes.withColumn("cell", cell_key(keys)), "cell-changes")
        every = table.lookup(news).unionByName(news, allowMissingColumns=True).fillna(0, self.measures)
        summed = every.groupBy("cell", *keys).agg(*[F.sum(m).cast("long").alias(m) for m in self.measures])
        alive = " OR ".join(f"`{m}` <> 0" for m in self.measures)
        summed = materialise(summed, "cell-sums")
        return table.merge(version, summed.filter(alive), summed.filter(f"NOT ({alive})"))

    def read(self) -> DataFrame:
        return self._table().read().drop("cell")
