"""Line dedup by a fixed-depth template tree (DataFrame functions only).

A line goes down the tree by its number of words, then by its first ``depth`` words one by one; a
word with a digit is a variable field and takes the branch ``<*>``.  The leaf is the line's
template: the fields it passed, and a variable field for every word behind them.  A template that
occurs in at least ``min_docs`` documents is boilerplate: its lines go from every document but the
one with the smallest ``doc_id``, so that one copy of the text stays in the corpus.

Only a template's hash, the row's key and the line number travel between tasks; texts are joined
once, with the flags of their own lines.

Defined cases: null text has no lines and stays null; lines with fewer than ``min_words`` words
are never dropped; a null ``doc_id`` counts as no document and keeps its lines; repeated rows of one
``doc_id`` count as one document; an empty table gives an empty result.  Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.words import WORD, whole_row
from sievework.session import materialise

DEPTH = 6
MIN_DOCS = 5
MIN_WORDS = 3


def template(line: Column, depth: int = DEPTH) -> Column:
    """The leaf of a line: its number of words, and a hash of the fields on the way."""
    fields = F.slice(F.split(F.ltrim(F.translate(line, "\t\x0b\f\r", "    ")), " +", depth + 1), 1, depth)
    masked = F.transform(fields, lambda w: F.when(w.rlike("[0-9]"), F.lit("<*>")).otherwise(w))
    return F.struct(
        F.regexp_count(line, F.lit(WORD)).cast("int").alias("n_words"), F.xxhash64(masked).alias("path")
    )


def drop_recurring(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_lines`` and ``n_removed``."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").withColumn(
        "_text", F.xxhash64("text")
    )
    lines = materialise(
        keyed.select("_id", "_text", F.posexplode(F.split("text", "\n")).alias("no", "line")).select(
            "_id", "_text", "no", template(F.col("line"), depth).alias("leaf")
        ),
        "line-leaves",
    )
    # Written first: the join below then meets a plain table, and Spark can split a hot template.
    recurring = materialise(
        lines.filter((F.col("leaf.n_words") >= min_words) & F.col("_id").isNotNull())
        .select("leaf", "_id")
        .distinct()
        .groupBy("leaf")
        .agg(F.count("*").alias("n_docs"), F.min("_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs),
        "line-recurring",
    )
    flags = (
        lines.join(recurring, "leaf", "left")
        .withColumn("drop", F.coalesce(F.col("_id") > F.col("keeper"), F.lit(False)))
        .groupBy("_id", "_text")
        .agg(
            F.max("drop").alias("any_drop"),
            F.sort_array(F.collect_set(F.struct("no", "drop"))).alias("flags"),
        )
        .filter("any_drop")
        .select(F.col("_id"), F.col("_text"), F.col("flags.drop").alias("_drop"))
    )
    text = F.col("d.doc.text")
    split = F.split(text, "\n")
    kept = F.when(F.col("f._drop").isNull(), text).otherwise(
        F.array_join(F.filter(split, lambda _, i: ~F.get(F.col("f._drop"), i)), "\n")
    )
    removed = F.when(F.col("f._drop").isNull(), 0).otherwise(F.size(F.filter("f._drop", lambda x: x)))
    rows = docs.select(
        whole_row(docs).alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text")
    )
    on = (F.col("d._id") == F.col("f._id")) & (F.col("d._text") == F.col("f._text"))
    joined = rows.alias("d").join(flags.alias("f"), on, "left")
    return joined.select(
        *[kept.alias(c) if c == "text" else F.col(f"d.doc.`{c}`") for c in columns],
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
    )
