"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one space for everything between them.  Character 4-grams of all
learning rows are counted per language in the tasks and summed by a shuffle; continuation counts of the
lower orders are numbers of distinct left neighbours in that table, and discounts, context totals and
probabilities are computed from all of it by aggregates and joins.  A text gets the language of lowest
cross-entropy per character.

The model is a table of summands.  A character's log probability is that of an unknown character, plus the
logarithm of the weight that each context before it leaves to the lower order, plus, for each n-gram that
ends at it, what having seen that n-gram adds.  So any part of the table gives its part of a text's
sum: the table goes to the tasks in blocks of bounded size, per kind one sorted array of n-grams (16 bits a
character) with a column per language.  A larger model means more passes over the texts, never a
larger broadcast, and no n-gram is left out.

Rejection is calibrated on the learning rows: a text whose cross-entropy lies more than ``REJECT_AT`` standard
deviations above the mean of learning texts of that language and about that length is marked
``rejected``; its nearest language is reported all the same.

Defined cases: null texts and texts without a letter are ``und`` with score 0, also when there is nothing to
learn from; equal cross-entropies go to the first language in code point order; a null ``doc_id``
is not held out; repeated rows count as often as they occur; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

ORDER, MAX_GRAMS, PIECE = 4, 1 << 21, 1 << 20  # MAX_GRAMS: rows of one block of the model
CELLS = 8  # numbers in a block, per row allowed: n-grams times languages
REJECT_AT = 4.0
SHARPNESS = 0.1  # log likelihoods of neighbouring characters are far from independent


@functools.cache
def _letters() -> np.ndarray:
    """Code point to 16-bit symbol: lower-case letters, and 32 for everything else."""
    table = np.full(0x110000, 32, dtype=np.uint16)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low[0]) & 0xFFFF or 1
    return table


def symbols(text: str | None) -> np.ndarray:
    """Letters and single spaces of a text, with one space at either end; empty without letters."""
    if not text:
        return np.zeros(0, dtype=np.uint16)
    found = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    letter = found != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if not letter.any():
        return found[:0]
    found = found[keep]
    if found[0] != 32:
        found = np.concatenate([np.array([32], dtype=np.uint16), found])
    return found if found[-1] == 32 else np.append(found, np.uint16(32))


def grams(found: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """4-grams that end at each position; two more spaces stand before the text's first one."""
    end = len(found) if end is None else end
    padded = np.concatenate([np.full(max(0, ORDER - 1 - begin), 32, dtype=np.uint16), found[max(0, begin - ORDER + 1) : end]])
    n = end - begin
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER):
        packed = packed << np.uint64(16) | padded[k : k + n].astype(np.uint64)
    return packed


def _pieces(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows, their numbers of grams, and the grams, about ``PIECE`` at a time."""
    rows, parts, held = [], [], 0
    for row, value in enumerate(column):
        found = symbols(value.as_py())
        for at in range(0, len(found), PIECE):
            part = grams(found, at, min(at + PIECE, len(found)))
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield rows, np.array([len(p) for p in parts]), np.concatenate(parts)
                rows, parts, held = [], [], 0
    if rows:
        yield rows, np.array([len(p) for p in parts]), np.concatenate(parts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out(lang: str, parts: list) -> pa.RecordBatch:
        keys, n = _merge(parts)
        return pa.record_batch(
            {"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys.astype(np.int64), "n": n}
        )

    for batch in batches:
        langs = batch["lang"].to_pylist()
        for rows, sizes, found in _pieces(batch["text"]):
            own = np.repeat(np.array([langs[r] for r in rows], dtype=object), sizes)
            for lang in sorted({langs[r] for r in rows}):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(found[own == lang], return_counts=True))
                if len(parts) > 16:
                    merged = _merge(parts)
                    held[lang] = [merged]
                    if len(merged[0]) > 1 << 20:
                        yield out(lang, held.pop(lang))
    for lang, parts in sorted(held.items()):
        yield out(lang, parts)


class KneserNey:
    """Log probabilities of all languages, per order in sorted arrays of n-grams and of contexts: the
    definition in memory, which tests compare the table of summands with."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        width = len(self.langs)
        levels = {k: [] for k in range(1, ORDER + 1)}
        for lang in self.langs:
            keys, n = counts[lang]
            order = np.argsort(keys)
            keys, n = keys[order].astype(np.uint64), n[order]
            levels[ORDER].append((keys, n))
            for k in range(ORDER - 1, 0, -1):
                keys, n = np.unique(keys & np.uint64((1 << 16 * k) - 1), return_counts=True)
                levels[k].append((keys, n))
        alphabet = len(np.unique(np.concatenate([k for k, _ in levels[1]]))) + 1
        self.grams: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        lower = np.full((1, width), 1.0 / alphabet)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([x for x, _ in levels[k]]))
            contexts = np.unique(keys >> np.uint64(16))
            at = np.searchsorted(contexts, keys >> np.uint64(16))
            own, weight = np.zeros((len(keys), width)), np.ones((len(contexts), width))
            for j, (grams_j, n) in enumerate(levels[k]):
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
                where = np.searchsorted(contexts, grams_j >> np.uint64(16))
                total = np.bincount(where, n, minlength=len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                seen = total > 0
                weight[seen, j] = discount * kinds[seen] / total[seen]
                own[np.searchsorted(keys, grams_j), j] = (n - discount) / total[where]
            if k > 1:
                below = lower[np.searchsorted(self.grams[k - 1], keys & np.uint64((1 << 16 * (k - 1)) - 1))]
            else:
                below = lower
            lower = own + weight[at] * below
            self.grams[k], self.logs[k] = keys, np.log(lower).astype(np.float32)
            self.contexts[k], self.backoff[k] = contexts, np.log(weight).astype(np.float32)
        self.unknown = np.float32(-np.log(alphabet))

    def log_probs(self, found: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each 4-gram, per language."""
        scores = np.zeros((len(found), len(self.langs)), dtype=np.float32)
        open_rows = np.arange(len(found))
        for k in range(ORDER, 0, -1):
            if not len(open_rows):
                break
            codes = found[open_rows] & np.uint64((1 << 16 * k) - 1 if k < 4 else (1 << 64) - 1)
            at = np.minimum(np.searchsorted(self.grams[k], codes), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == codes
            scores[open_rows[hit]] += self.logs[k][at[hit]]
            open_rows, codes = open_rows[~hit], codes[~hit] >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.contexts[k], codes), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == codes
            scores[open_rows[known]] += self.backoff[k][at[known]]
        scores[open_rows] += self.unknown
        return scores


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of their id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """``langs`` in code point order, ``base`` the log probability of an unknown character in each, and the
    summands: ``block, kind, gram, j, value``, ``j`` being the language's place and ``kind`` twice the
    order, one more for a context of the next order."""

    def __init__(self, langs: list[str], base: np.ndarray, summands: DataFrame, n_blocks: int):
        self.langs, self.base, self.summands, self.n_blocks = langs, base, summands, n_blocks

    def block(self, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per kind: sorted n-grams, and their values per language."""
        rows = self.summands.filter(F.col("block") == k).select("kind", "gram", "j", "value").toArrow()
        kind, j, value = (rows[c].to_numpy() for c in ("kind", "j", "value"))
        gram = rows["gram"].to_numpy().view(np.uint64)
        tables = {}
        for x in np.unique(kind).tolist():
            own = kind == x
            keys, where = np.unique(gram[own], return_inverse=True)
            values = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
            values[where, j[own]] = value[own]
            tables[x] = keys, values
        return tables


def add_up(column: pa.Array, tables: dict[int, tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sums of a block's summands per language, and the number of characters."""
    sums, n = np.zeros((len(column), width)), np.zeros(len(column), dtype=np.int64)
    for rows, sizes, found in _pieces(column):
        every, where = np.unique(found, return_inverse=True)
        scores = np.zeros((len(every), width), dtype=np.float32)
        for kind, (keys, values) in tables.items():
            k, context = divmod(kind, 2)
            codes = (every >> np.uint64(16) if context else every) & np.uint64((1 << 16 * k) - 1)
            at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            hit = keys[at] == codes
            scores[hit] += values[at[hit]]
        part = np.add.reduceat(scores[where], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
        np.add.at(sums, rows, part)
        np.add.at(n, rows, sizes)
    return sums, n


def judge(sums: np.ndarray, n: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per row: language, score, cross-entropy in nats."""
    best = sums.argmax(axis=1)
    top = sums[np.arange(len(sums)), best]
    odds = np.exp(SHARPNESS * (sums - top[:, None])).sum(axis=1)
    empty = n == 0
    found = ["und" if e else langs[b] for e, b in zip(empty, best, strict=True)]
    return found, np.where(empty, 0.0, 1 / odds), -top / np.maximum(n, 1)


def _low(gram: Column, k: int) -> Column:
    """The last ``k`` characters of n-grams."""
    return gram.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else gram


def train(rows: DataFrame, max_grams: int = MAX_GRAMS) -> Model | None:
    """Models of all languages in ``rows`` (``lang``, ``text``), in blocks of about ``max_grams`` rows; None
    if there is nothing to learn."""
    spark = rows.sparkSession
    level = (
        rows.filter("lang is not null and text is not null")
        .select("lang", "text")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    levels = {ORDER: materialise(level, "language-grams")}
    for k in range(ORDER - 1, 0, -1):
        fewer = levels[k + 1].groupBy("lang", _low(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = materialise(fewer, "language-grams")
    once, twice = (F.count_if(F.col("n") == x) for x in (1, 2))
    discounts: dict[tuple[str, int], float] = {}
    for k, level in levels.items():
        for r in level.groupBy("lang").agg(once.alias("ones"), twice.alias("twos")).collect():
            found = r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] else 0.5
            discounts[r["lang"], k] = min(max(found, 0.1), 0.95)
    langs = sorted({lang for lang, _ in discounts})
    if not langs:
        return None
    alphabet = levels[1].select("gram").distinct().count() + 1

    below, parts, base = None, [], np.full(len(langs), -np.log(alphabet))
    for k in range(1, ORDER + 1):
        constants = spark.createDataFrame(
            pa.table({"lang": langs, "j": pa.array(range(len(langs)), pa.int32()), "discount": [discounts[x, k] for x in langs]})
        )
        level = levels[k].withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = materialise(
            level.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            .join(constants, "lang")
            .withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total")),
            "language-contexts",
        )
        if k == 1:
            level = level.withColumn("under", F.lit(1.0 / alphabet))
            for r in contexts.select("j", "weight").collect():  # the one empty context of each language
                base[r["j"]] += np.log(r["weight"])
        else:
            level = level.withColumn("low", _low(F.col("gram"), k - 1)).join(
                below.select("lang", F.col("gram").alias("low"), F.col("p").alias("under")), ["lang", "low"]
            )
            kept = F.lit(2 * k - 1).cast("int").alias("kind")
            parts.append(contexts.select(kept, F.col("context").alias("gram"), "j", F.log("weight").cast("float").alias("value")))
        own, rest = (F.col("n") - F.col("discount")) / F.col("total"), F.col("weight") * F.col("under")
        below = materialise(
            level.join(contexts, ["lang", "context"])
            .select("lang", "gram", "j", (own + rest).alias("p"), F.log1p(own / rest).cast("float").alias("value")),
            "language-probabilities",
        )
        parts.append(below.select(F.lit(2 * k).cast("int").alias("kind"), "gram", "j", "value"))
    summands = parts[0]
    for part in parts[1:]:
        summands = summands.union(part)
    n_rows = summands.count()
    n_keys = summands.select("kind", "gram").distinct().count()
    n_blocks = max(-(-n_rows // max_grams), -(-n_keys * len(langs) // (CELLS * max_grams)))
    block = F.pmod(F.xxhash64("kind", "gram"), F.lit(n_blocks)).alias("block")
    return Model(langs, base, summands.select(block, "*"), n_blocks)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, n_symbols`` of every row, from its text only."""
    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    if model is None:
        return columns.selectExpr(
            "doc_id", "held_out", "'und' as lang_pred", "0D as score", "0D as cross_entropy", "0L as n_symbols"
        )
    langs, base, width = model.langs, model.base, len(model.langs)
    found = None
    for k in range(model.n_blocks):
        shared = docs.sparkSession.sparkContext.broadcast(model.block(k))

        def add(batches, shared=shared):
            for batch in batches:
                sums, n = add_up(batch["text"], shared.value, width)
                listed = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, width, dtype=np.int32), sums.ravel())
                yield pa.record_batch(
                    [batch["doc_id"], batch["held_out"], batch["text_hash"], listed, pa.array(n)],
                    names=["doc_id", "held_out", "text_hash", "sums", "n"],
                )

        part = columns.mapInArrow(add, "doc_id long, held_out boolean, text_hash long, sums array<double>, n long")
        if model.n_blocks > 1:  # one block at a time in the tasks
            part = materialise(part, "language-sums")
            shared.unpersist()
        if found is None:
            found = part
            continue
        more = part.groupBy("doc_id", "text_hash").agg(F.first("sums").alias("more")).toDF("id", "hash", "more")
        on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
        both = F.zip_with("sums", "more", lambda a, b: a + b).alias("sums")
        found = materialise(found.join(more, on).select("doc_id", "held_out", "text_hash", both, "n"), "language-sums")

    def decide(batches):
        for batch in batches:
            n = batch["n"].to_numpy()
            sums = batch["sums"].flatten().to_numpy().reshape(len(n), width) + n[:, None] * base
            best, score, entropy = judge(sums, n, langs)
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], pa.array(best, pa.string()), pa.array(score), pa.array(entropy), batch["n"]],
                names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "n_symbols"],
            )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, n_symbols long"
    return found.mapInArrow(decide, schema)


def identify(docs: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Learn from the rows that are not held out; predict and calibrate on all rows."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), max_grams)
    found = materialise(predict(docs, model), "language-scores")
    length = F.floor(F.log2(F.col("n_symbols") + 1)).cast("int")
    usual = (
        found.filter("not held_out and n_symbols > 0")
        .groupBy("lang_pred", length.alias("length"))
        .agg(F.avg("cross_entropy").alias("mean"), F.coalesce(F.stddev("cross_entropy"), F.lit(0.0)).alias("spread"))
    )
    limit = F.col("mean") + REJECT_AT * F.col("spread") + 1e-6
    return (
        found.withColumn("length", length)
        .join(usual, ["lang_pred", "length"], "left")
        .select(
            "doc_id", "held_out", "lang_pred", "score", "cross_entropy",
            F.coalesce(F.col("cross_entropy") > limit, F.lit(True)).alias("rejected"),
        )
    )
