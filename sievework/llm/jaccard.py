"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its 5-word shingles.  All sets are sorted by one global order, rare shingles first;
two sets of similarity t or more then share a shingle among their first ``n - ceil(t n) + 1``.

1. *Order.*  A shingle ranks by an upper bound of its document frequency: the smaller of the counts of its
   own cell and of its rarest word's cell, in two tables of hash cells counted over all documents.
   Their size is fixed, whatever the corpus.  The order only decides how many candidates there are,
   never which links are found.
2. *Groups.*  Documents with identical prefix and size have the same group key, a hash of both, so a
   group enters the join once however many copies it has.  Documents with identical sets form one class.
3. *Postings.*  One row per group and prefix shingle.  That bound also says how long a shingle's posting can
   get, before any shuffle; long ones are salted, so no task gathers a hot shingle.
4. *Stars.*  Each posting links its groups to the one in whose order the shingle stands first, which has the
   fewest rarer shingles of its own: among edited copies that is the least edited one.  These pairs,
   one or a few per group, are verified on whole sets and settle nearly all components.  Before texts are
   fetched, a pair must pass a bound: the cells in which the parities of two sets differ are no more than the
   shingles in which the sets differ.
5. *The rest.*  Pairs of groups that share a posting, fit in size and position, and are not in one
   component yet are expanded to classes and verified, so no link between components is lost.

6. *Links.*  Steps 4 and 5 give components, which is all that ``keep_one`` needs.  Every link is inside one, so
   ``components_of`` sends the shingle sets of components of two classes and more, in blocks of bounded size, to
   tasks that count the shared shingles of all pairs of a block in one product.  What comes
   out is one number per class and block; no pair is written.

Defined cases: texts without words (null, empty) have size 0 and are linked with nothing; fewer words than a
shingle make one shingle; equal sets are one class, with no pairs inside; a null ``doc_id`` counts as
the smallest id; repeated rows are returned as often as they occur; an empty table gives an empty
result.  Extra columns are ignored by ``components_of`` and pass through ``keep_one``, which keeps one row of a
component, whatever ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.components import components
from sievework.llm.words import documents_words, mix, shingles, whole_row
from sievework.session import materialise

WIDTH, NUM, DEN = 5, 3, 4  # similarity of NUM / DEN
WORD_CELLS, SHINGLE_CELLS = 1 << 17, 1 << 18
SALT_ROWS = 20_000
_NO_ID = -(1 << 63)
_OTHER = np.uint64(0xA0761D6478BD642F)


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(WORD_CELLS + SHINGLE_CELLS, dtype=np.int64)
    for batch in batches:
        for words, _, _ in documents_words(batch["text"], True):
            counts[np.unique(_cells(words, WORD_CELLS))] += 1
            counts[np.unique(_cells(shingles(words, WIDTH), SHINGLE_CELLS)) + WORD_CELLS] += 1
    cells = np.flatnonzero(counts)
    yield pa.record_batch({"cell": cells.astype(np.int32), "n": counts[cells]})


def cell_ranks(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every word cell and shingle cell: 1024 times the binary logarithm of its frequency."""
    counted = (
        docs.select("text").mapInArrow(_count_cells, "cell int, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    ranks = np.zeros(WORD_CELLS + SHINGLE_CELLS, dtype=np.uint16)
    ranks[counted["cell"].to_numpy()] = np.ceil(1024 * np.log2(1.0 + counted["n"].to_numpy()))
    return ranks[:WORD_CELLS], ranks[WORD_CELLS:]


class Set:
    """A document's shingles in the global order."""

    def __init__(self, words: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]):
        found = shingles(words, WIDTH)
        own = ranks[0][_cells(words, WORD_CELLS)]
        rarest = np.minimum(own[: len(found)], ranks[1][_cells(found, SHINGLE_CELLS)])
        for k in range(1, min(WIDTH, len(words))):
            np.minimum(rarest, own[k : k + len(found)], out=rarest)
        self.hashes, at = np.unique(found, return_index=True)
        self.n = len(self.hashes)
        keys = rarest[at].astype(np.uint64) << np.uint64(48) | self.hashes >> np.uint64(16)
        prefix = self.n - (NUM * self.n + DEN - 1) // DEN + 1 if self.n else 0
        self.prefix = np.sort(keys)[:prefix]

    def identity(self) -> bytes:
        """128 bits of the whole set."""
        a, b = mix(self.hashes ^ _OTHER).sum(dtype=np.uint64), mix(self.hashes + _OTHER).sum(dtype=np.uint64)
        return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")

    def parity(self) -> bytes:
        """Parity of the number of shingles per cell, in twice as many cells as shingles at least (a power of 2)."""
        cells = 1 << max(6, (2 * self.n - 1).bit_length())
        return np.packbits(np.bincount((self.hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()

    def group(self) -> int:
        """64 bits of prefix and size."""
        x = mix(self.prefix ^ _OTHER).sum(dtype=np.uint64) + np.uint64(self.n)
        return int(mix(np.array([x]))[0].view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Set(w, ranks) for w, _, _ in documents_words(batch["text"], True)]
        yield pa.record_batch(
            {
                "id": batch["id"],
                "print": batch["print"],
                "n": pa.array([s.n for s in found], pa.int64()),
                "cid": pa.array([s.identity() for s in found], pa.binary()),
                "gid": pa.array([s.group() for s in found], pa.int64()),
                "parity": pa.array([s.parity() for s in found], pa.binary()),
            }
        )


def _postings(batches: Iterator[pa.RecordBatch], ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # groups of this task, each written once

    def out(parts: list) -> pa.RecordBatch:
        sizes = [len(p) for p, _, _ in parts]
        return pa.record_batch(
            {
                "token": np.concatenate([p for p, _, _ in parts]).view(np.int64),
                "gid": np.repeat(np.array([g for _, g, _ in parts], dtype=np.int64), sizes),
                "n": np.repeat(np.array([n for _, _, n in parts], dtype=np.int32), sizes),
                "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]),
            }
        )

    parts, held = [], 0
    for batch in batches:
        for words, _, _ in documents_words(batch["text"], True):
            if not len(words):
                continue
            own = Set(words, ranks)
            gid = own.group()
            if gid in seen:
                continue
            seen.add(gid)
            parts.append((own.prefix, gid, own.n))
            held += len(own.prefix)
            if held > 1 << 18:
                yield out(parts)
                parts, held = [], 0
    if parts:
        yield out(parts)


def _fits(a: Column, b: Column) -> Column:
    """Can sets of these sizes be similar enough?"""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _may_link(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Can they, if this is the first shingle they share?  Nothing before it is shared."""
    need = F.ceil((n_a + n_b) * NUM / (NUM + DEN))
    return _fits(n_a, n_b) & (F.least(n_a - pos_a, n_b - pos_b) >= need)


def _posting_rows(texts: DataFrame, ranks: Broadcast) -> DataFrame:
    """Postings shared by two groups or more: ``token, gid, n, pos, hub``."""
    rows = texts.select("text").mapInArrow(
        lambda b: _postings(b, ranks.value), "token long, gid long, n int, pos int"
    )
    most = F.pow(F.lit(2.0), F.shiftrightunsigned("token", 48) / 1024.0)
    salts = F.ceil(most / SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod("gid", salts).cast("int"))
    one = Window.partitionBy("token", "salt")
    rows = rows.withColumns(
        {
            "hub": F.min(F.struct("pos", "n", "gid")).over(one),
            "low": F.min("gid").over(one),
            "high": F.max("gid").over(one),
        }
    )
    return materialise(
        rows.filter((F.col("low") != F.col("high")) | (salts > 1)).drop("low", "high"), "jaccard-postings"
    )


def _star_pairs(postings: DataFrame) -> DataFrame:
    """``g1, g2``: each group with the hub of its posting, and hubs of salts with each other."""
    inner = postings.filter(
        (F.col("gid") != F.col("hub.gid"))
        & _may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"))
    ).select(F.col("hub.gid").alias("g1"), F.col("gid").alias("g2"))
    hubs = postings.select("token", "salt", "hub").distinct()
    hubs = hubs.withColumn("top", F.min("hub").over(Window.partitionBy("token"))).filter(
        (F.col("hub.gid") != F.col("top.gid"))
        & _may_link(F.col("hub.n"), F.col("hub.pos"), F.col("top.n"), F.col("top.pos"))
    )
    return inner.union(hubs.select(F.col("top.gid").alias("g1"), F.col("hub.gid").alias("g2"))).distinct()


def _group_pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``g1, g2`` that may hold a link and are not in one component yet.
    ``groups``: ``gid, root``, the root null where a group's classes are in several.

    Only the first shingle two groups share can decide, so a pair is not formed at a shingle whose
    predecessors among the groups' shared shingles are the same: they share that one as well."""
    own = Window.partitionBy("gid").orderBy("pos")
    rows = postings.withColumns({"prev": F.lag("token").over(own), "prev_pos": F.lag("pos").over(own)})
    # Each task that has read a copy of a group wrote the group's postings: one of them is enough.
    rows = rows.filter(F.col("prev_pos").isNull() | (F.col("prev_pos") < F.col("pos"))).drop("prev_pos")
    rows = rows.join(groups, "gid")
    spread = (
        rows.groupBy("token")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.col("root").isNull()).alias("mixed"))
        .filter("low <> high or mixed")
    )
    rows = rows.join(spread.select("token"), "token")
    rows = rows.select("token", "gid", "n", "pos", "prev", "root")
    a, b = rows.alias("a"), rows.alias("b")
    smaller_first = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.gid") < F.col("b.gid")))
    indexed = F.col("a.pos") <= F.col("a.n") - F.ceil(F.col("a.n") * (2 * NUM) / (NUM + DEN))
    may = _may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
    first = F.coalesce(F.col("a.prev") != F.col("b.prev"), F.lit(True))
    apart = F.col("a.root").isNull() | F.col("b.root").isNull() | (F.col("a.root") != F.col("b.root"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & smaller_first & indexed & may & first & apart)
    return pairs.select(F.col("a.gid").alias("g1"), F.col("b.gid").alias("g2")).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, None
    for batch in batches:
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        keep = []
        texts = zip(
            documents_words(batch["text_a"], True), documents_words(batch["text_b"], True), strict=True
        )
        for k, ((left, _, _), (right, _, _)) in enumerate(texts):
            if a[k] != last:
                last, held = a[k], np.unique(shingles(left, WIDTH))
            other = np.unique(shingles(right, WIDTH))
            both = len(held) + len(other) - len(np.union1d(held, other))
            keep.append(DEN * both >= NUM * (len(held) + len(other) - both))
        yield pa.record_batch({"a": batch["a"], "b": batch["b"]}).filter(pa.array(keep, pa.bool_()))


def _folded(parity: bytes, size: int) -> np.ndarray:
    """The parities of ``size`` bytes of cells, each two or more of the given ones together."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, dtype=np.uint8).reshape(-1, size), axis=0)


def _may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shingle of one set only flips one cell, so the sets differ in as many shingles as cells at least."""
    for batch in batches:
        n = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
        most = n + 2 * (-NUM * n // (NUM + DEN))  # how many they may differ in
        apart = []
        for x, y in zip(batch["p_a"].to_pylist(), batch["p_b"].to_pylist(), strict=True):
            size = min(len(x), len(y))
            apart.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))
        yield pa.record_batch({"a": batch["a"], "b": batch["b"]}).filter(pa.array(np.array(apart, dtype=np.int64) <= most))


_CELL_BITS = 24


def _among(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``texts`` whose ``id, print`` may be among ``chosen``: a bitmap of fixed size (2 MB) keeps most others from the
    shuffle of the join that follows."""
    cell = F.pmod(F.xxhash64("id", "print"), F.lit(1 << _CELL_BITS))
    marked = chosen.select((cell + 1).alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
    )
    bits = np.zeros(1 << (_CELL_BITS - 3), dtype=np.uint8)
    for r in marked.collect():
        part = np.frombuffer(r.bits, dtype=np.uint8)
        bits[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def there(cells: pd.Series) -> pd.Series:
        at = cells.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return texts.filter(there(cell))


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, turn: str) -> DataFrame:
    """The pairs of classes (``a, b``) that are similar enough, by their whole texts; those that their parities tell
    apart do not need them."""
    one, two = (
        classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}")) for c in "ab"
    )
    pairs = pairs.join(one, "a").join(two, "b").mapInArrow(_may_be_alike, "a binary, b binary")
    pairs = materialise(pairs, f"jaccard-pairs-{turn}")
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    chosen = materialise(
        classes.join(needed, "cid").select("cid", F.col("rep").alias("id"), "print"), f"jaccard-chosen-{turn}"
    )
    found = materialise(
        _among(texts, chosen).join(chosen, ["id", "print"]).select("cid", "text").dropDuplicates(["cid"]),
        f"jaccard-texts-{turn}",
    )
    left = found.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = found.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return materialise(rows.mapInArrow(_verify, "a binary, b binary"), f"jaccard-links-{turn}")


class Classes:
    """``documents``: ``id, n, cid``; ``classes``: ``cid, rep``, its smallest id; ``links`` between
    classes: ``a, b``, each once with ``a < b``."""

    def __init__(self, documents: DataFrame, classes: DataFrame, links: DataFrame):
        self.documents, self.classes, self.links = documents, classes, links


def _texts(docs: DataFrame) -> DataFrame:
    """Rows of one id, or of none, may have different texts: the print tells which one is meant."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("print"), "text"
    )


def join_classes(docs: DataFrame, every: bool = True) -> Classes:
    """Find the links between the distinct shingle sets of ``docs``: every one, or only enough of them to
    connect every component."""
    texts = _texts(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(cell_ranks(texts))
    documents = materialise(
        texts.mapInArrow(lambda b: _sets(b, ranks.value), "id long, print long, n long, cid binary, gid long, parity binary"),
        "jaccard-documents",
    )
    smallest = documents.filter("n > 0").groupBy("cid", "gid", "n").agg(
        F.min(F.struct("id", "print")).alias("of"), F.first("parity").alias("parity")
    )
    classes = materialise(
        smallest.select("cid", "gid", "n", "parity", F.col("of.id").alias("rep"), F.col("of.print").alias("print")),
        "jaccard-classes",
    )
    postings = _posting_rows(texts, ranks)
    firsts = classes.groupBy("gid").agg(F.min("cid").alias("first"))
    stars = _star_pairs(postings)
    one, two = firsts.toDF("g1", "a"), firsts.toDF("g2", "b")
    pairs = stars.join(one, "g1").join(two, "g2").select("a", "b")
    inside = classes.join(firsts, "gid").filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    tried = pairs.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = materialise(tried, "jaccard-stars")
    links = _links(tried, texts, classes, "stars")

    roots = components(links, "jaccard-star-roots").toDF("cid", "root")
    rooted = materialise(
        classes.join(roots, "cid", "left").select("cid", "gid", F.coalesce("root", "cid").alias("root")),
        "jaccard-rooted",
    )
    groups = rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    groups = materialise(groups.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("root")), "jaccard-groups")
    mixed = groups.filter("root is null").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    rest = _group_pairs(postings, groups).union(mixed)
    one, two = rooted.toDF("a", "g1", "root_a"), rooted.toDF("b", "g2", "root_b")
    rest = (
        rest.join(one, "g1").join(two, "g2")
        .filter("root_a <> root_b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    found = Classes(documents, classes, links.union(_links(rest, texts, classes, "rest")))
    if every:
        pairs = _blocks(found, _labelled(found), texts).applyInArrow(_linked_pairs, "a binary, b binary")
        found.links = materialise(pairs, "jaccard-links")
    return found


# --------------------------------------------------- links inside components

BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 19
SMALL = 64
STEP = 1.1  # blocks of a large component hold sets of about one size
_REACH = int(np.ceil(np.log(DEN / NUM) / np.log(STEP)))
_FEW = 16  # classes of a block that share a shingle; of more, a matrix product counts


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingles(words, WIDTH)) for words, _, _ in documents_words(batch["text"], True)]
        yield pa.record_batch({"cid": batch["cid"], "shingles": pa.array([x.tobytes() for x in sets], pa.large_binary())})


def _blocks(found: Classes, labelled: DataFrame, texts: DataFrame):
    """Classes with their shingle sets, grouped so that every link is inside one group: ``root, one, two``.

    Links are inside components.  Those of up to ``SMALL`` classes go whole into bags of about
    ``BLOCK_CLASSES``; larger ones are cut by size and then by hash into blocks of that many, and a class
    goes once to every block of a size that it could be linked with.  A single class has no link and stays away.
    """
    sized = labelled.join(found.classes.select("cid", "n", "print"), "cid")
    whole = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("all")).filter("m > 1")
    members = materialise(sized.join(whole, "root"), "jaccard-members")
    chosen = members.select("cid", F.col("rep").alias("id"), "print")
    sets = _among(texts, chosen).join(chosen, ["id", "print"]).select("cid", "text").dropDuplicates(["cid"])
    sets = materialise(sets.mapInArrow(_class_sets, "cid binary, shingles binary"), "jaccard-sets")

    small = (F.col("m") <= SMALL) & (F.col("all") <= BLOCK_SHINGLES)
    many, much = members.filter(small).agg(F.count("*"), F.sum("n")).first()
    bags = int(max(1, -(-many // BLOCK_CLASSES), -(-(much or 0) // BLOCK_SHINGLES)))
    bag = F.pmod(F.xxhash64("root"), F.lit(bags))
    bagged = members.filter(small).select(
        "cid", "n", F.lit(None).cast("binary").alias("root"), bag.alias("block"), bag.alias("one"), bag.alias("two")
    )
    level = F.floor(F.log("n") / F.log(F.lit(STEP))).cast("int")
    large = members.filter(~small).withColumn("level", level)
    slices = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    # One entry per level of size: fewer than 250 for any length a text can have.
    levels = large.groupBy("root", "level").agg(slices.alias("slices")).groupBy("root").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "slices"))).alias("levels")
    )
    number = lambda lev, s: lev.cast("long") * F.lit(1 << 32) + s
    there = F.filter(F.sequence(F.col("level") - _REACH, F.col("level") + _REACH), lambda x: F.map_contains_key("levels", x))
    others = F.flatten(
        F.transform(there, lambda x: F.transform(F.sequence(F.lit(0), F.col("levels")[x] - 1), lambda s: number(x, s)))
    )
    cut = large.join(levels, "root").withColumn(
        "block", number(F.col("level"), F.pmod(F.xxhash64("cid"), F.col("levels")[F.col("level")]))
    ).withColumn("other", F.explode(others))
    cut = cut.select(
        "cid", "n", "root", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    return bagged.unionByName(cut).join(sets, "cid").groupBy("root", "one", "two")


def _linked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left and of the right block, and which are linked; the blocks may be one."""
    n, block = table["n"].to_numpy(), table["block"].to_numpy()
    left = np.flatnonzero(block == table["one"][0].as_py())
    right = np.flatnonzero(block == table["two"][0].as_py())
    tokens = np.frombuffer(b"".join(table["shingles"].to_pylist()), dtype=np.uint64)
    rows = np.repeat(np.arange(len(n)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    times = np.diff(np.concatenate([starts, [len(tokens)]]))
    common = np.repeat(times, times)
    both = np.zeros((len(n), len(n)))
    few = np.flatnonzero((common > 1) & (common <= _FEW))
    own, of = rows[few], tokens[few]
    for lag in range(1, min(_FEW, len(few))):
        same = of[lag:] == of[:-lag]
        pairs = own[:-lag][same] * len(n) + own[lag:][same]
        both += np.bincount(pairs, minlength=both.size).reshape(both.shape)
    both += both.T
    most = np.flatnonzero(times > _FEW)
    for at in range(0, len(most), 4096):
        part = most[at : at + 4096]
        has = np.zeros((len(n), len(part)), dtype=np.float32)
        column = np.repeat(np.arange(len(part)), times[part])
        spots = np.concatenate([np.arange(starts[k], starts[k] + times[k]) for k in part])
        has[rows[spots], column] = 1
        both[np.ix_(left, right)] += has[left] @ has[right].T
    shared = both[np.ix_(left, right)]
    alike = DEN * shared >= NUM * (n[left][:, None] + n[right][None, :] - shared)
    return left, right, alike & (left[:, None] != right[None, :])


def _linked_counts(table: pa.Table) -> pa.Table:
    """``cid, n_links``: links of every class of the group that has one."""
    left, right, linked = _linked(table)
    count = np.zeros(len(table), dtype=np.int64)
    count[left] += linked.sum(axis=1)
    if left[0] != right[0]:
        count[right] += linked.sum(axis=0)
    some = np.flatnonzero(count)
    return pa.table({"cid": table["cid"].take(pa.array(some)), "n_links": count[some]})


def _linked_pairs(table: pa.Table) -> pa.Table:
    """``a, b``: every link of the group once, with ``a < b``."""
    left, right, linked = _linked(table)
    ids = table["cid"].to_pylist()
    i, j = np.nonzero(linked)
    pairs = {tuple(sorted((ids[a], ids[b]))) for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True)}
    a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def components_of(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, class_id, n_links``, ids being smallest members;
    ``n_links`` is the number of other classes that the row's class is linked with."""
    found = join_classes(docs, every=False)
    classes = _labelled(found)
    n_links = (
        _blocks(found, classes, _texts(docs)).applyInArrow(_linked_counts, "cid binary, n_links long")
        .groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    )
    labelled = classes.join(n_links, "cid", "left").drop("root")
    real = lambda c: F.when(c != F.lit(_NO_ID), c)
    return found.documents.join(labelled, "cid", "left").select(
        real(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real(F.coalesce("component", "id")).alias("component_id"),
        real(F.coalesce("rep", "id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _labelled(found: Classes) -> DataFrame:
    """``cid, rep, root, component`` of every class."""
    roots = components(found.links, "jaccard-roots").toDF("cid", "root")
    labelled = found.classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    return materialise(labelled.join(smallest, "root").select("cid", "rep", "root", "component"), "jaccard-components")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest real ``doc_id``, or of none if all are null, and of texts
    under one id the one of the smallest hash.  Documents without words all stay.

    A row is known by its id and its text's hash, so another text under a dropped row's id stays; of rows
    alike in both, one stays.
    """
    found = join_classes(docs, every=False)
    rows = found.documents.join(_labelled(found).select("cid", "root"), "cid").groupBy("root", "id", "print").agg(
        F.count("*").alias("copies")
    )
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id") == _NO_ID, "id", "print")).alias("first"))
    judged = materialise(
        rows.join(first, "root").select(
            "id", "print", ((F.col("id") == F.col("first.id")) & (F.col("print") == F.col("first.print"))).alias("stays"),
            "copies",
        ).filter("not stays or copies > 1"),
        "jaccard-judged",
    )
    keyed = docs.select(
        whole_row(docs).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64("text").alias("print"),
    )
    alone = keyed.join(judged, ["id", "print"], "left_anti").select("doc")
    # Repeated rows of one id and text: any of them, chosen by what it holds.
    repeated = keyed.join(judged.filter("stays"), ["id", "print"], "left_semi").withColumn("held", F.to_json("doc"))
    one = repeated.groupBy("id", "print").agg(F.min_by("doc", "held").alias("doc")).select("doc")
    return alone.unionByName(one).select(*[F.col(f"doc.`{c}`") for c in docs.columns])
