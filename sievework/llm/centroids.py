"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids.

1. *Tree.*  Every round the driver builds a vantage-point tree over the centroids (``CLUSTERS`` of them) and
   broadcasts it: fixed in size, whatever the table.  An inner node holds one centroid and, for either half
   of the rest, the least and the largest distance to it; a leaf holds up to ``LEAF`` centroids.
2. *Search.*  A vector visits nodes best first, by a lower bound from the triangle inequality, until the best
   bound left is above its nearest centroid.  The radius is inclusive: a node that may hold a
   centroid equally near is visited, so ties go to the smaller number.  Distances are exact integers;
   bounds are rounded downwards.  The vectors of a batch take their steps together, each with its own bounds.
3. *Update.*  Tasks return sums per centroid and component, in limbs of ``LIMB`` bits, so they are exact at any
   magnitude; Spark adds them up, and the driver sees one number per centroid, component and limb.

Nothing is kept between rounds but the centroids: every round reads the table anew, so a lost executor costs
its own tasks only.

Components up to ``NARROW`` in absolute value, in vectors and centroids, make every product exact in doubles;
vectors beyond it, or all if a centroid is beyond it, are compared with whole Python integers and without pruning.

Defined cases: null, short and long vectors, and those with a null, NaN or infinite component (or one that
overflows when scaled) are left out; a null ``vec_id`` counts as empty text in the starting order and comes
back as null; vectors of one id are ordered by their components; repeated rows are rows of their own; fewer
vectors than centroids make fewer centroids; an empty table gives an empty result; a distance beyond the
largest long is given as that.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, 2
LEAF = 4
NARROW = 1 << 22
LIMB = 40
ROWS = 8192
LONGEST = (1 << 63) - 1
_LESS = 1e-12  # more than the rounding of a square root and a difference


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``x`` to rows ``c``, as whole numbers."""
    if x.dtype == object or c.dtype == object:
        return ((x[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(axis=2)
    x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


class Tree:
    """Vantage-point tree; node 0 is the root.  ``points`` are the centroids a node holds itself, ``below`` its
    children with the least and the largest distance of their centroids to ``points[0]``."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.prunes = centroids.dtype != object
        self.points: list[np.ndarray] = []
        self.below: list[list[tuple[int, float, float]]] = []
        self._grow(np.arange(len(centroids)))

    def _grow(self, members: np.ndarray) -> int:
        node = len(self.points)
        self.points.append(members)
        self.below.append([])
        if len(members) <= LEAF:
            return node
        gaps = squared(self.centroids[members], self.centroids[members])
        # The vantage point sees its companions at the most different distances.
        spread = gaps.astype(np.float64).std(axis=1) if self.prunes else np.zeros(len(members))
        vantage = int(spread.argmax())
        rest = np.delete(np.arange(len(members)), vantage)
        rest = rest[np.argsort(gaps[vantage][rest], kind="stable")]
        self.points[node] = members[[vantage]]
        for half in np.array_split(rest, 2):
            near, far = (float(gaps[vantage][half[k]]) ** 0.5 if self.prunes else 0.0 for k in (0, -1))
            self.below[node].append((self._grow(members[half]), near, far))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of every row and the squared distance to it."""
        exact = object if not self.prunes or x.dtype == object else np.int64
        bounds = np.full((len(x), len(self.points)), np.inf)
        bounds[:, 0] = 0
        best = np.full(len(x), -1, dtype=exact)
        found = np.full(len(x), len(self.centroids), dtype=np.int64)
        open_rows = np.arange(len(x))
        while len(open_rows):
            turn = bounds[open_rows].argmin(axis=1)
            for node in np.unique(turn):
                self._visit(int(node), open_rows[turn == node], x, bounds, best, found)
            least = bounds[open_rows].min(axis=1)
            if exact is object:
                open_rows = open_rows[np.isfinite(least)]
            else:
                radius = np.sqrt(best[open_rows].astype(np.float64)) * (1 + _LESS)
                open_rows = open_rows[np.isfinite(least) & (least <= radius)]
        return found, best

    def _visit(self, node, rows, x, bounds, best, found) -> None:
        points = self.points[node]
        here = squared(x[rows], self.centroids[points])
        for k, c in enumerate(points):
            d = here[:, k]
            better = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], c
        own = bounds[rows, node]
        if self.below[node]:
            away = np.sqrt(here[:, 0].astype(np.float64)) if best.dtype != object else None
            for child, near, far in self.below[node]:
                if away is None:
                    bounds[rows, child] = 0
                    continue
                inner = away - far - _LESS * (away + far)
                outer = near - away - _LESS * (away + near)
                bounds[rows, child] = np.maximum(own, np.maximum(inner, outer))
        bounds[rows, node] = np.inf


def _whole(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` as whole numbers, as Python's where they are large."""
    x = np.floor(SCALE * x)
    if not x.size or np.abs(x).max() <= NARROW:
        return x.astype(np.int64)
    return np.vectorize(int, otypes=[object])(x)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the rows that count, those of large components apart."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["embedding"]), WIDTH), False))
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            x = pc.list_flatten(part["embedding"]).cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = x.reshape(-1, WIDTH)
                scaled = x * SCALE
                real = np.isfinite(scaled).all(axis=1)
                wide = real & (np.abs(np.floor(scaled)) > NARROW).any(axis=1)
            for rows in (np.flatnonzero(real & ~wide), np.flatnonzero(wide)):
                if len(rows):
                    yield part["vec_id"].take(pa.array(rows)), _whole(x[rows])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, low = value >> LIMB, value & ((1 << LIMB) - 1)
        if low:
            yield limb, sign * low
        limb += 1


def _sums(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """``cell, limb, part``: sums of a task; cell is centroid * (WIDTH + 1) + component, the last the count."""
    total = np.zeros((len(tree.centroids), WIDTH + 1), dtype=object)
    for _, x in _vectors(batches):
        found, _ = tree.nearest(x)
        for c in np.unique(found):
            mine = x[found == c]
            total[c, :WIDTH] += mine.sum(axis=0).astype(object)
            total[c, WIDTH] += len(mine)
    rows = [(cell, limb, part) for cell, value in enumerate(total.ravel()) for limb, part in _limbs(int(value))]
    cells, limbs, parts = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.record_batch(
        {"cell": pa.array(cells, pa.int32()), "limb": pa.array(limbs, pa.int32()), "part": pa.array(parts, pa.int64())}
    )


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for ids, x in _vectors(batches):
        found, best = tree.nearest(x)
        if best.dtype == object:
            best = np.array([min(int(d), LONGEST) for d in best], dtype=np.int64)
        yield pa.record_batch({"vec_id": ids, "cluster": pa.array(found, pa.int32()), "distance": pa.array(best, pa.int64())})


def _centroid_table(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) > NARROW for row in rows for v in row)
    return np.array(rows, dtype=object if wide else np.int64).reshape(-1, WIDTH)


def starting(vectors: DataFrame) -> list[list[int]]:
    """The vectors of the smallest hashes of ``SEED:<vec_id>``, in that order."""
    real = F.forall("embedding", lambda x: F.abs(x.cast("double") * SCALE) < F.lit(float("inf")))
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.filter((F.size("embedding") == WIDTH) & real).orderBy(order, "embedding").limit(CLUSTERS)
    return [[int(np.floor(SCALE * float(x))) for x in r.embedding] for r in first.select("embedding").collect()]


def _moved(vectors: DataFrame, tree: Broadcast, rows: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; centroids without vectors stay."""
    parts = vectors.mapInArrow(lambda b: _sums(b, tree.value), "cell int, limb int, part long")
    sums = parts.groupBy("cell", "limb").agg(F.sum(F.col("part").cast("decimal(20, 0)")).alias("part")).collect()
    total = [[0] * (WIDTH + 1) for _ in rows]
    for cell, limb, part in sums:
        total[cell // (WIDTH + 1)][cell % (WIDTH + 1)] += int(part) << (LIMB * limb)
    return [[v // t[WIDTH] for v in t[:WIDTH]] if t[WIDTH] else old for t, old in zip(total, rows, strict=True)]


def cluster(table: DataFrame) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector that counts, and the final centroids."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    context = table.sparkSession.sparkContext
    rows = starting(vectors)
    for _ in range(ROUNDS if rows else 0):
        tree = context.broadcast(Tree(_centroid_table(rows)))
        rows = _moved(vectors, tree, rows)
        tree.unpersist()
    if not rows:
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), rows
    tree = context.broadcast(Tree(_centroid_table(rows)))
    found = vectors.mapInArrow(lambda b: _assigned(b, tree.value), "vec_id long, cluster int, distance long")
    return materialise(found, "centroids"), rows


def clustered(table: DataFrame) -> DataFrame:
    """Per vector ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    found, rows = cluster(table)
    summed = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()
    inertia = sum(int(r.s) for r in summed)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    facts = [(r.cluster, min(int(r.s), LONGEST), min(inertia, LONGEST), digests[r.cluster]) for r in summed]
    # CLUSTERS rows at most.
    known = table.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
