"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source is wanted ``target / source_size`` times.  The whole part is taken as
it is; the fractional parts are rounded in pairs: of two documents, probability mass (weighted by
words) moves from one to the other, at random and fair in expectation, until one of them is
integral.  So a source's words stay what they are, and only one fractional document is left
over per block.  Blocks hold about ``block`` documents, longest first, so that what is left over
tends to be short; the left-overs meet again in blocks of the next level, a reduction tree of
log(n) levels over each source.  The one document left at the root is rounded to the nearer side:
a source misses its target by at most half of that document.

Defined cases: null text counts as no words; a source without words has target 0; documents
without words are taken with 0 words; null sources form one source, ordered last; equal rows are
rounded as separate documents; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.words import whole_row, word_count
from sievework.session import materialise

_DONE = "array<struct<doc_id:bigint,size:bigint,copies:bigint>>"
_HELD = "struct<size:bigint,doc_id:bigint,base:bigint,p:double>"
_EDGE = 1e-9


def source_targets(
    sized: DataFrame, weights: Sequence[float], share: float, cap: float
) -> DataFrame:
    """Words wanted of each source: ``(source, source_size, n, target)``.

    Weights repeat over the sources in code point order, null last.  No target exceeds ``cap``
    times its source; what is cut off goes to the others by weight.  Sorted by how soon they
    reach their cap, sources up to some rank are capped and all others share the rest, so one
    pass over the table of sources finds the level.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    by_cap = whole.orderBy("_full_at", "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.col("_rank") - 1) % len(weights) + 1).cast("int"),
    )
    levels = (
        sources.withColumn("_rank", F.row_number().over(ordered))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * float(cap))
        .withColumn("_full_at", F.col("_cap") / F.col("_weight"))
        .withColumn(
            "_level",
            (
                F.sum("source_size").over(whole) * float(share)
                - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
            )
            / F.sum("_weight").over(onward),
        )
        .withColumn("_open", F.col("_full_at") > F.col("_level"))
    )
    first_open = F.min(F.when(F.col("_open"), F.struct("_full_at", "_rank", "_level"))).over(whole)
    target = F.least("_cap", F.coalesce(first_open["_level"] * F.col("_weight"), F.col("_cap")))
    return levels.withColumn("target", target).select("source", "source_size", "n", "target")


def _draw(seed: int, level: int, doc_id: Column) -> Column:
    """Uniform in [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), doc_id), 11) / F.lit(2.0**53)


def _settle(seed: int, level: int):
    """Fold one document into the block's state: what is decided, and the one still fractional."""

    def done(item: Column, copies: Column) -> Column:
        return F.array(
            F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), copies.alias("copies"))
        )

    def with_p(item: Column, p: Column) -> Column:
        return F.struct(
            item["size"].alias("size"), item["doc_id"].alias("doc_id"), item["base"].alias("base"), p.alias("p")
        )

    def step(state: Column, item: Column) -> Column:
        held = state["held"]
        a, b = held["p"] * held["size"], item["p"] * item["size"]
        room_a, room_b = held["size"] - a, item["size"] - b
        to_item, to_held = F.least(a, room_b), F.least(b, room_a)
        forward = _draw(seed, level, item["doc_id"]) < to_held / (to_item + to_held)
        mass_a = F.when(forward, a - to_item).otherwise(a + to_held)
        mass_b = F.when(forward, b + to_item).otherwise(b - to_held)
        pa, pb = mass_a / held["size"], mass_b / item["size"]
        a_whole = (pa <= _EDGE) | (pa >= 1 - _EDGE)
        b_whole = (pb <= _EDGE) | (pb >= 1 - _EDGE)
        decided = F.concat(
            F.when(a_whole, done(held, held["base"] + F.round(pa).cast("long"))).otherwise(
                F.array().cast(_DONE)
            ),
            F.when(b_whole, done(item, item["base"] + F.round(pb).cast("long"))).otherwise(
                F.array().cast(_DONE)
            ),
        )
        left = F.when(~a_whole, with_p(held, pa)).when(~b_whole, with_p(item, pb))
        return F.when(
            held.isNull(), F.struct(state["done"].alias("done"), item.alias("held"))
        ).otherwise(
            F.struct(F.concat(state["done"], decided).alias("done"), left.alias("held"))
        )

    return step


def copies(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 128,
    seed: int = 17,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``."""
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")
        ),
        "mix-sizes",
    )
    sources = materialise(source_targets(sized, weights, share, cap), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    wanted = (
        sized.alias("d")
        .join(sources.alias("s"), same)
        .select("d.source", "d.doc_id", "d.size", "s.n", rate.alias("rate"))
        .withColumn("base", F.floor(F.col("rate") + _EDGE))
        .withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    )
    whole = (F.col("p") <= _EDGE) | (F.col("size") == 0)
    decided = [
        wanted.filter(whole).select("source", "doc_id", "size", F.col("base").alias("copies"))
    ]
    open_items = wanted.filter(~whole).select("source", "doc_id", "size", "base", "p", "n")
    most = sources.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), block)))
    for level in range(levels + 1):
        blocks = F.ceil(F.col("n") / block)
        item = F.struct("size", "doc_id", "base", "p")
        state = F.aggregate(
            F.sort_array("items", asc=False),
            F.struct(F.array().cast(_DONE).alias("done"), F.lit(None).cast(_HELD).alias("held")),
            _settle(seed, level),
        )
        level_out = materialise(
            open_items.groupBy(
                "source",
                blocks.alias("n"),
                F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id"), blocks).alias("block"),
            )
            .agg(F.collect_list(item).alias("items"))
            .select("source", "n", state.alias("state")),
            f"mix-level{level}",
        )
        decided.append(
            level_out.select("source", F.explode("state.done").alias("x")).select(
                "source", "x.doc_id", "x.size", "x.copies"
            )
        )
        open_items = level_out.filter("state.held is not null").select(
            "source", "state.held.doc_id", "state.held.size", "state.held.base", "state.held.p", "n"
        )
    last = F.col("base") + F.round("p").cast("long")
    decided.append(open_items.select("source", "doc_id", "size", last.alias("copies")))
    rounded = decided[0]
    for part in decided[1:]:
        rounded = rounded.unionByName(part)
    return (
        rounded.alias("d")
        .join(sources.alias("s"), same)
        .select(
            "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "d.copies",
            (F.col("d.copies") * F.col("d.size")).alias("taken"),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their columns and ``copies``; others are left out.

    Repeated rows of one ``doc_id`` are told apart by size and position.
    """
    same_id = Window.partitionBy("_id", "_size").orderBy("_size")
    plan = copies(docs, **options).select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    )
    plan = plan.withColumn("_nth", F.row_number().over(same_id))
    rows = docs.select(
        whole_row(docs).alias("doc"),
        F.col("doc_id").cast("long").alias("_id"),
        word_count(F.col("text")).alias("_size"),
    ).withColumn("_nth", F.row_number().over(same_id))
    on = (
        F.col("d._id").eqNullSafe(F.col("p._id"))
        & (F.col("d._size") == F.col("p._size"))
        & (F.col("d._nth") == F.col("p._nth"))
    )
    taken = rows.alias("d").join(plan.alias("p"), on).filter(F.col("p._copies") > 0)
    kept = [c for c in docs.columns if c != "copies"]
    return taken.select(*[F.col(f"d.doc.`{c}`") for c in kept], F.col("p._copies").alias("copies"))
