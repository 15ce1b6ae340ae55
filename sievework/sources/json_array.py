"""One JSON array of objects, read by many tasks.

Spark's text reader cuts a file into splits at any size; with ``}`` as line separator, every record ends where an
object may end.  Whether it does depends on the strings and brackets before it, so there are two passes:

1. every split tells, for both cases of beginning outside or inside a string, in which case it ends and by how much
   the depth changes; these few numbers per split are composed in order of the file;
2. every split, now knowing its state, returns the objects that it holds whole, and its first and last pieces;
   the pieces of objects that cross splits are put together by file and place.

Both passes read the same splits, so nothing is held between them but two numbers per split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPE = re.compile(r"\\.", re.S)
_OPEN, _CLOSE = re.compile(r"[\[{]"), re.compile(r"[\]}]")


def _net(parts: list[str]) -> int:
    return sum(len(_OPEN.findall(p)) - len(_CLOSE.findall(p)) for p in parts)


def measure(record: str) -> tuple[int, int, int]:
    """Parity of quotes, and the change of depth if the record begins outside or inside a string."""
    parts = _ESCAPE.sub("", record).split('"')
    return (len(parts) - 1) % 2, _net(parts[::2]), _net(parts[1::2])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for value, file, start in zip(batch["value"], batch["file"], batch["start"], strict=True):
            yield (file, start), value + "}"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[tuple[str, int], list[int]] = {}
    for split, record in _records(batches):
        # State and depth so far, had the split begun outside or inside a string.
        now = found.setdefault(split, [0, 0, 1, 0])
        odd, outside, inside = measure(record)
        for case in (0, 2):
            now[case + 1] += inside if now[case] else outside
            now[case] ^= odd
    rows = [(*split, *now) for split, now in found.items()]
    yield pd.DataFrame(rows, columns=["file", "start", "end_out", "by_out", "end_in", "by_in"])


def _objects(batches: Iterator[pd.DataFrame], states: dict[tuple[str, int], tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """``file, start, part, ends, text``: part 0 is a whole object, 1 the first pieces of a split, 2 its last."""
    split, held, rows, size = None, [], [], 0
    quoted = depth = 0
    first = False  # are the pieces held those of an object begun before the split?

    def told(part: int, ends: bool) -> tuple:
        return (*split, part, ends, "".join(held))

    for key, record in _records(batches):
        if key != split:
            if split and held:
                rows.append(told(1 if first else 2, False))
            split, held = key, []
            quoted, depth = states[key]
            first = quoted == 1 or depth > 1
        held.append(record)
        odd, outside, inside = measure(record)
        depth += inside if quoted else outside
        quoted ^= odd
        if depth == 1 and not quoted:
            rows.append(told(1 if first else 0, True))
            size += len(rows[-1][4])
            held, first = [], False
        if size > 1 << 23:
            yield pd.DataFrame(rows, columns=["file", "start", "part", "ends", "text"])
            rows, size = [], 0
    if split and held:
        rows.append(told(1 if first else 2, False))
    yield pd.DataFrame(rows, columns=["file", "start", "part", "ends", "text"])


def read_json_array(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A row per object of the arrays under ``path``, with ``fields`` as strings; absent ones are null.

    Files that are empty, or hold an empty array, give no rows.  What stands between objects is ignored.
    """
    records = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    summary = "file string, start long, end_out int, by_out long, end_in int, by_in long"
    states, last, quoted, depth = {}, None, 0, 0
    for r in sorted(records.mapInPandas(_summaries, summary).collect(), key=lambda r: (r.file, r.start)):
        if r.file != last:
            last, quoted, depth = r.file, 0, 0
        states[r.file, r.start] = (quoted, depth)
        depth += r.by_in if quoted else r.by_out
        quoted = r.end_in if quoted else r.end_out
    pieces = records.mapInPandas(
        lambda b: _objects(b, states), "file string, start long, part int, ends boolean, text string"
    )
    whole = pieces.filter("part = 0").select("text")
    # Two pieces per split at most, in order of the file; an object is what lies between two ends.
    order = Window.partitionBy("file").orderBy("start", "part")
    crossing = (
        pieces.filter("part > 0")
        .withColumn("no", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("file", "no")
        .agg(F.sort_array(F.collect_list(F.struct("start", "part", "text"))).alias("parts"), F.max("ends").alias("ends"))
        .filter("ends")
        .select(F.array_join("parts.text", "").alias("text"))
    )
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    bare = F.regexp_replace("text", r"^[^{]*", "")
    return whole.unionByName(crossing).select(F.from_json(bare, schema).alias("row")).select("row.*")
