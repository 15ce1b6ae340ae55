"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model of text statistics gives each document's evidence.  Every host's mean evidence is
shrunk toward the corpus mean, every path's toward its host's, with strengths estimated from how much
sites really differ (method of moments); a site with few documents stays near its parent.  A document's
posterior odds are its own odds times the odds its path moves the corpus mean by.

The model is fitted on about ``MAX_LABELLED`` labelled documents at most, a share of all by hash of
their id; statistics, site sums and decisions cover all documents.  Site sums are partial aggregates, so a host with a third
of all documents is one small row per task.

Defined cases: texts without words (null, empty) have posterior 0 and are rejected; without labels of
both classes every other document has posterior 1 and is kept; null hosts and paths are sites of their own;
repeated rows are judged alike; an empty table gives an empty result.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.words import buffers, documents_words
from sievework.session import materialise

MAX_LABELLED = 20_000
SLOTS = 1 << 30  # hash slots; a share of them is the sample
FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs",
    "upper", "digits", "symbols", "pipes", "marks", "line_length",
)


def _classes() -> np.ndarray:
    table = np.zeros((256, 6), dtype=bool)
    for k, members in enumerate(
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=<>{}[]\\_+/", b"|", b"!?", b"\n")
    ):
        table[list(members), k] = True
    return table


_CLASSES = _classes()
_CODES = np.where(_CLASSES.any(axis=1), _CLASSES.argmax(axis=1), 6).astype(np.uint8)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; zeros where there are no words."""
    data, offsets = buffers(column)
    rows = np.zeros((len(offsets) - 1, len(FEATURES)))
    for k, (words, starts, ends) in enumerate(documents_words(column, True)):
        if not len(words):
            continue
        part = np.bincount(_CODES[data[offsets[k] : offsets[k + 1]]], minlength=7)
        length, n = part.sum(), len(words)
        counts = np.unique(words, return_counts=True)[1]
        pairs = len(np.unique(words[1:] * np.uint64(31) + words[:-1])) / (n - 1) if n > 1 else 1.0
        spread = np.log1p(n)
        rows[k] = (
            spread, (ends - starts).sum() / n, len(counts) / n**0.9, counts.max() / n, pairs,
            part[0] / length, part[1] / length, part[2] / length, part[3] / n, part[4] / n,
            np.log1p(length / (part[5] + 1)),
        )
    return rows


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps, on standardised features; intercept last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / scale
    return np.append(own, w[-1] - own @ mean)


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.FixedSizeListArray.from_arrays(statistics(batch["text"]).ravel(), len(FEATURES))
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["host"], batch["path"], rows.cast(kind)],
            names=["doc_id", "host", "path", "x"],
        )


def _evidence(weights: list[float] | None) -> Column:
    """Probability of good quality from the statistics column ``x``."""
    words = F.element_at("x", 1) > 0
    if weights is None:
        return F.when(words, 1.0).otherwise(0.0)
    score = sum((F.element_at("x", k + 1) * F.lit(w) for k, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    score = F.least(F.greatest(score, F.lit(-15.0)), F.lit(15.0))
    return F.when(words, 1 / (1 + F.exp(-score))).otherwise(0.0)


class Model:
    """Weights, and the table of sites: ``host, path, shift`` (log odds against the corpus mean)."""

    def __init__(self, weights: list[float] | None, sites: DataFrame):
        self.weights, self.sites = weights, sites


def _strength(sums: DataFrame, parent: Column) -> float:
    """Documents a parent's mean counts for: large where sites hardly differ from their parents."""
    gap = F.col("s") / F.col("n") - parent
    row = sums.agg(
        F.sum(F.col("n")).alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
    ).first()
    if not row["n"] or row["k"] < 2 or row["n"] <= row["k"]:
        return 1e3
    noise = row["within"] / (row["n"] - row["k"])
    real = max(row["between"] - row["k"] * noise, 0.0) / row["n"]
    return float(min(max(noise / real if real > 0 else 1e6, 1.0), 1e6))


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def measured(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Text statistics of all documents: ``doc_id, host, path, x``; texts are read once."""
    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"), "text",
    )
    return materialise(
        columns.mapInArrow(_with_statistics, "doc_id long, host string, path string, x array<double>"),
        "quality-statistics",
    )


def train(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit the document model on a bounded sample, and the sites on all documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).filter(
        "y is not null and doc_id is not null"
    )
    usable = materialise(
        rows.filter(F.element_at("x", 1) > 0)
        .join(known, "doc_id")
        .select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")),
        "quality-labelled",
    )
    share = min(1.0, max_labelled / max(1, usable.count()))
    sample = sorted(usable.filter(F.col("slot") < int(share * SLOTS)).collect())
    y = np.array([float(r["y"] > 0) for r in sample])
    weights = None
    if len(y) and 0 < y.sum() < len(y):
        weights = fit(np.array([r["x"] for r in sample]), y).tolist()
    p = _evidence(weights)
    sums = materialise(
        rows.filter(F.element_at("x", 1) > 0)
        .groupBy("host", "path")
        .agg(F.sum(p).alias("s"), F.sum(p * p).alias("ss"), F.count("*").alias("n")),
        "quality-sites",
    )
    total = sums.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = F.lit(1.0 if total is None else total)
    hosts = sums.groupBy("host").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    k = _strength(hosts, mean)
    hosts = hosts.withColumn("host_mean", (F.col("s") + k * mean) / (F.col("n") + k))
    paths = sums.alias("p").join(
        hosts.select(F.col("host").alias("_host"), "host_mean"), F.col("host").eqNullSafe(F.col("_host"))
    )
    k = _strength(paths, F.col("host_mean"))
    shift = _log_odds((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)) - _log_odds(mean)
    return Model(weights, materialise(paths.select("host", "path", shift.alias("shift")), "quality-shifts"))


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``host, path, x``) and ``evidence``, ``posterior`` and ``kept``."""
    sites = model.sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "shift")
    at = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    odds = _log_odds(F.col("evidence")) + F.coalesce(F.col("shift"), F.lit(0.0))
    posterior = F.when(F.col("evidence") > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)
    return (
        rows.withColumn("evidence", _evidence(model.weights))
        .join(sites, at, "left")
        .withColumn("posterior", posterior)
        .withColumn("kept", F.col("posterior") >= 0.5)
        .drop("_host", "_path", "shift")
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that the classifier accepts, with their columns; no text is shuffled."""
    model = train(measured(docs, host, path), labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    schema = T.StructType(
        [T.StructField("doc", docs.schema), T.StructField("host", T.StringType()),
         T.StructField("path", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
    )

    def add(batches):
        for batch in batches:
            text = batch["doc"].field("text")
            x = pa.FixedSizeListArray.from_arrays(statistics(text).ravel(), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], batch["host"], batch["path"], x.cast(pa.list_(pa.float64()))],
                names=["doc", "host", "path", "x"],
            )

    rows = docs.select(
        row.alias("doc"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")
    ).mapInArrow(add, schema)
    return judged(rows, model).filter("kept").select("doc.*")
