"""Order-dependent rules over keys of any size, without one task per key.

A key may hold a third of all rows, so a plain window over the key is not an
option.  The rows of a key are cut into chunks of bounded size; each chunk is
reduced to one row, the small chunk table is scanned in order, and the result is
carried back into the chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max_before(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, chunk: Column
) -> DataFrame:
    """Largest ``value`` among the key's earlier rows; null for the first.

    ``chunk`` must not decrease with ``order`` and bounds the rows one task sees.
    ``order`` must be unique within a key.  Null keys form a key of their own; rows whose chunk is
    null come first, in a chunk of their own.
    """
    marked = df.withColumns({"_chunk": chunk, "_value": value})
    by_chunk = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        marked.groupBy(*keys, "_chunk")
        .agg(F.max("_value").alias("_top"))
        .withColumn("_carry", F.max("_top").over(by_chunk))
        .drop("_top")
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = marked.withColumn("_local", F.max("_value").over(inside))
    right = carried.select(
        *[F.col(k).alias(f"_r{i}") for i, k in enumerate([*keys, "_chunk"])], "_carry"
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate([*keys, "_chunk"])],
    )
    return (
        local.join(right, on)
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_chunk", "_value", "_local", "_carry", *[f"_r{i}" for i in range(len(keys) + 1)])
    )


_FOLDS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, None)}


def running_before(
    df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], chunk: int
) -> DataFrame:
    """Add running aggregates over the key's rows of smaller ``order``; rows of equal order do not see each other.

    ``values``: output name to (``max``, ``min`` or ``sum``, column); null where nothing came before.  ``order``
    is a long without nulls.  A key's rows are cut into stretches of ``chunk`` order numbers: one task never
    holds more of a key than that, however hot it is.
    """
    inputs = {f"_in_{out}": value for out, (_, value) in values.items()}
    marked = df.withColumns({**inputs, "_chunk": F.expr(f"floor({order} / {chunk}BD)").cast("long")})
    fold = lambda out, name: _FOLDS[values[out][0]][0](name)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*keys, "_chunk").agg(*[fold(out, f"_in_{out}").alias(f"_of_{out}") for out in values])
        .withColumns({f"_carry_{out}": fold(out, f"_of_{out}").over(by_chunk) for out in values})
        .select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate([*keys, "_chunk"])], *[f"_carry_{out}" for out in values])
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    local = marked.withColumns({f"_local_{out}": fold(out, f"_in_{out}").over(inside) for out in values})
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate([*keys, "_chunk"])],
    )
    joined = local.join(carried, on)

    def both(out: str) -> Column:
        parts = [F.col(f"_carry_{out}"), F.col(f"_local_{out}")]
        if values[out][0] == "sum":
            return F.coalesce(parts[0] + parts[1], *parts)
        return _FOLDS[values[out][0]][1](*parts)

    return joined.select(*df.columns, *[both(out).alias(out) for out in values])


def first_per_key(df: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The lowest ``order`` of each key: partial aggregation first, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def flag_members(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """Boolean column: is the row's unique ``key`` among ``members``?

    Joining on a unique row key keeps the shuffle even, whatever the grouping keys were.
    """
    marked = members.select(key).withColumn(out, F.lit(True))
    return df.join(marked, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def rank_top(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank"):
    """First ``k`` rows per key.

    The rank filter lets Spark keep only ``k`` rows per key on each map side
    before the shuffle, so a hot key moves ``k`` rows per task.
    """
    by_rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(by_rank)).filter(F.col(out) <= k)


CELLS = 1 << 12
HOT_ROWS = 100_000


def split_join(
    hot: DataFrame, other: DataFrame, keys: list[str], spread: str, hot_rows: int = HOT_ROWS, cells: int = CELLS
) -> DataFrame:
    """Inner join whose ``hot`` side may hold a large part of its rows under one key.

    Keys are counted in ``cells`` hash cells, a table of fixed size.  The rows of a cell beyond ``hot_rows`` are dealt
    out by a hash of ``spread``, a column that tells them apart, and the few rows of ``other`` in that cell are
    repeated for every part.  Null keys meet nothing.
    """
    real = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int")
    hot, other = hot.filter(real).withColumn("_cell", cell), other.filter(real).withColumn("_cell", cell)
    counted = hot.groupBy("_cell").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).collect()
    if not counted:
        return hot.drop("_cell").join(other.drop("_cell"), keys)
    parts = hot.sparkSession.createDataFrame(
        [(r["_cell"], -(-r["n"] // hot_rows)) for r in counted], "_cell int, _parts long"
    )

    def dealt(df: DataFrame) -> DataFrame:
        # At most one row per cell.
        return df.join(F.broadcast(parts), "_cell", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    one = dealt(hot).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts")))
    each = dealt(other).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return one.drop("_cell", "_parts").join(each.drop("_cell", "_parts"), [*keys, "_part"]).drop("_part")


BLOCK_ROWS = 1024


def in_blocks(df: DataFrame, keys: list[str], row: Column, order: str, out: str) -> DataFrame:
    """The rows of a key as arrays of about ``BLOCK_ROWS`` values of ``row``: ``keys``, ``_block`` (a number within the key), ``out``.

    Rows are dealt to blocks by a hash of ``order``; where that repeats, by the number of the copy as well, so no
    value makes a block longer.  Null keys form keys of their own.
    """
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_blocks"))
    n = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_blocks")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    copy = F.row_number().over(Window.partitionBy(*keys, order).orderBy(F.lit(0)))
    dealt = df.withColumn("_copy", copy).join(n, on).withColumn(
        "_block", F.pmod(F.xxhash64(order, "_copy"), F.col("_blocks"))
    )
    return dealt.groupBy(*keys, "_block").agg(F.collect_list(row).alias(out))


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """By hash into the session's full number of partitions, for rows that are few and give many: those would be merged.

    By a hash of the keys, as a repartition by columns that the rows are already shuffled by is left out.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def cell_by_cell(df: DataFrame) -> DataFrame:
    """The same rows; keeps what forms many rows of one apart from what forms many of these again.

    Compiled into one loop, both would hold all rows of a cell in memory before the first is passed on.  A ``coalesce`` into
    as many partitions as ``evenly`` makes merges none, and is not compiled with its neighbours.
    """
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
