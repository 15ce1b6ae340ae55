"""Source divergence audit: how far the term distributions of a language's sources are from each other.

1. *Partial counts.*  Inside ``mapInArrow`` a block of texts goes through Arrow kernels only: ``ascii_lower``,
   ``split_pattern_regex``, ``dictionary_encode`` and two hash group-bys, first by (document, term), then by
   (language, source, term).  A task's rows are therefore already combined before the shuffle, so a hot
   source or a very common term is a few rows per block.
2. *Merged counts.*  Spark adds the blocks up; a language keeps the terms that occur in ``MIN_DOCS`` of its
   documents or more.
3. *Columnar shards.*  The kept terms of a language are dealt to shards of about ``SHARD_TERMS``, its sources to
   blocks of about ``BLOCK_SOURCES``; a task holds one shard of two blocks as a dense matrix of fixed size
   and returns one sum per pair of sources.  Spark adds the shards up.

Probabilities are integers: ``p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, computed in decimals, so
no count overflows and no sum depends on the order of its terms.

Defined cases: null text, language and source count as empty strings; a group without terms has
every count 0; a language without kept terms has pairs of value 0 and no terms; a language of one
source has no pairs; repeated rows count as often as they occur; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.words import text_slices
from sievework.session import materialise

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
SHARD_TERMS, BLOCK_SOURCES = 4096, 256


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_slices(batch):
            groups = pa.table({"lang": block["lang"], "source": block["source"]})
            found = groups.append_column("row", pa.array(np.arange(len(block)), pa.int64()))
            found = found.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
            code = np.zeros(len(block), dtype=np.int32)
            rows = found["row_list"].combine_chunks()
            code[rows.flatten().to_numpy()] = rows.value_parent_indices().to_numpy()

            pieces = pc.split_pattern_regex(pc.ascii_lower(block["text"]), pattern=BETWEEN)
            terms, row = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
            real = pc.not_equal(terms, "")
            terms, row = terms.filter(real).dictionary_encode(), row.filter(real)
            by_document = (
                pa.table({"row": row, "term": terms.indices})
                .group_by(["row", "term"], use_threads=False)
                .aggregate([([], "count_all")])
            )
            by_group = (
                pa.table(
                    {
                        "group": pa.array(code[by_document["row"].to_numpy()]),
                        "term": by_document["term"],
                        "n": by_document["count_all"],
                    }
                )
                .group_by(["group", "term"], use_threads=False)
                .aggregate([("n", "sum"), ("n", "count")])
                .combine_chunks()
            )
            # Every group reports once without a term, so those without any are known as well.
            own = len(found)
            group = pa.concat_arrays([*by_group["group"].chunks, pa.array(np.arange(own), pa.int32())])
            term = by_group["term"].combine_chunks()
            zero = pa.array(np.zeros(own, dtype=np.int64))
            yield pa.record_batch(
                {
                    "lang": found["lang"].combine_chunks().take(group),
                    "source": found["source"].combine_chunks().take(group),
                    "term": pa.concat_arrays([terms.dictionary.take(term), pa.nulls(own, pa.string())]),
                    "n": pa.concat_arrays([*by_group["n_sum"].chunks, zero]),
                    "d": pa.concat_arrays([*by_group["n_count"].chunks, zero]),
                }
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents; one row with a null ``term`` per group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(_partial_counts, "lang string, source string, term string, n long, d long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _probability(count: str, total: str, kept: str) -> str:
    wide = "cast({} as decimal(20, 0))"
    over = f"({wide.format(SCALE)} * ({wide.format(count)} + {SMOOTH}))"
    return f"1 + ({over} div ({wide.format(total)} + {SMOOTH} * {wide.format(kept)}))"


def _shard_sums(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
    """``lang, one, two, part`` of one shard and two blocks of sources: the sum of ``|p - q|`` over the terms
    that occur there, less what they would add if no source had them."""
    cells = cells.combine_chunks()
    sources = cells["source"].combine_chunks().dictionary_encode()
    at = sources.indices.to_numpy()
    named = cells["term"].combine_chunks().dictionary_encode()
    seen = np.flatnonzero(named.is_valid().to_numpy(zero_copy_only=False))
    base, block = np.zeros(len(sources.dictionary), dtype=np.int64), np.zeros(len(sources.dictionary), dtype=np.int64)
    base[at] = cells["base"].to_numpy()
    block[at] = cells["block"].to_numpy()
    p = np.repeat(base[:, None], len(named.dictionary), axis=1)
    p[at[seen], named.indices.take(pa.array(seen)).to_numpy()] = cells["p"].take(pa.array(seen)).to_numpy()
    one, two = key[2].as_py(), key[3].as_py()
    parts = []
    right = np.flatnonzero(block == two)
    for k in np.flatnonzero(block == one):
        others = right[right > k] if one == two else right
        if len(others):
            apart = np.abs(p[others] - p[k]).sum(axis=1) - np.abs(base[others] - base[k]) * p.shape[1]
            parts.append((np.full(len(others), k), others, apart))
    if not parts:
        k, others, apart = (np.zeros(0, dtype=np.int64),) * 3
    else:
        k, others, apart = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(k), pa.string()),
            "one": sources.dictionary.take(pa.array(k)),
            "two": sources.dictionary.take(pa.array(others)),
            "part": pa.array(apart, pa.int64()),
        }
    )


class Audit:
    """Written tables of one corpus: ``groups`` (``lang, source, total, kept, base``) and ``cells`` (``lang, source,
    term, n, p, q``), the kept terms that occur in a group."""

    def __init__(self, docs: DataFrame):
        counts = materialise(term_counts(docs), "divergence-counts")
        terms = (
            counts.filter("term is not null").groupBy("lang", "term")
            .agg(F.sum("n").alias("n_lang"), F.sum("d").alias("d")).filter(F.col("d") >= MIN_DOCS).drop("d")
        )
        self.terms = materialise(terms, "divergence-terms")
        found = materialise(
            counts.filter("term is not null").drop("d").join(self.terms, ["lang", "term"]), "divergence-cells"
        )
        sizes = self.terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.filter("term is null").select("lang", "source")
        groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = groups.fillna(0, ["total", "kept", "total_lang"])
        base = F.expr(f"CASE WHEN kept = 0 THEN 0L ELSE {_probability('0', 'total', 'kept')} END")
        self.groups = materialise(groups.withColumn("base", base), "divergence-groups")
        self.cells = found.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "base",
            F.expr(_probability("n", "total", "kept")).alias("p"),
            F.expr(_probability("n_lang", "total_lang", "kept")).alias("q"),
        )

    def pairs(self) -> DataFrame:
        """``lang, source, other, value``: both directions of every pair of a language's sources."""
        per_lang = self.groups.groupBy("lang").agg(
            F.greatest(F.ceil(F.max("kept") / SHARD_TERMS), F.lit(1)).cast("int").alias("shards"),
            F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"),
        )
        block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
        cells = self.cells.join(per_lang, "lang").select(
            "lang", "source", "term", "p", "base", "blocks", block,
            F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"),
        )
        # One row per source and shard without a term: the source takes part even where it has none of them.
        markers = self.groups.join(per_lang, "lang").select(
            "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "base",
            "blocks", block, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        )
        dealt = cells.unionByName(markers).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select(
            "lang", "shard", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"),
            "source", "term", "p", "base", "block",
        )
        sums = (
            dealt.groupBy("lang", "shard", "one", "two")
            .applyInArrow(_shard_sums, "lang string, one string, two string, part long")
            # A shard names a pair in the order in which it met the sources.
            .groupBy("lang", F.least("one", "two").alias("source"), F.greatest("one", "two").alias("other"))
            .agg(F.sum("part").alias("part"))
        )
        sums = materialise(sums, "divergence-pairs")
        ends = self.groups.select("lang", "source", "base", "kept")
        both = (
            sums.join(ends, ["lang", "source"])
            .join(ends.drop("kept").toDF("lang", "other", "base_other"), ["lang", "other"])
            .select("lang", "source", "other", (F.col("part") + F.abs(F.col("base") - F.col("base_other")) * F.col("kept")).alias("value"))
        )
        return both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: per (language, source) every other source by its distance (part
    ``pair``), and the ``TOP_TERMS`` terms it has most above the language (part ``term``)."""
    found = Audit(docs)
    pairs = found.pairs().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = found.cells.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value")
    )
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(first))
    top = terms.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= TOP_TERMS)
    return ranked.unionByName(top)
