"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the smallest node it is linked with.

    A large star ties a node's larger neighbours to its smallest one, a small star its smaller ones;
    together they halve the depth of the forest every turn.  Both are a minimum per node
    (combined before the shuffle) and a join, so a hub with many links is never gathered.
    """
    edges = materialise(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        label,
    )
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select("v", "m")
        large = materialise(large.toDF("u", "v").filter("u <> v").distinct(), label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m"))
        new = materialise(small.filter("u <> v").distinct(), label)
        unchanged = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if unchanged:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
