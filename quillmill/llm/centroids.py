"""Centroid clustering; the nearest centroid is found by the threshold algorithm.

For every dimension the centroids are sorted by their component. A vector walks each
of these lists outward from its own value, all lists by one centroid a step. A centroid
met for the first time gets its exact squared distance. The frontier of a list is the
difference at which it stands; a centroid not met yet differs by that much at least in
every dimension, so the walk ends when the sum of squared frontiers strictly exceeds
the best exact distance (strictly, so that a tie with a smaller number is still met).

Components are integers floor(scale * x), so distances and sums are exact. Tasks reduce
their vectors to sums by centroid and dimension; the driver holds no more than k
centroids. Batches of vectors take their steps together in numpy.

Cases: a vector with another number of components, a null, NaN or infinite one, or one
of 2**21 or more in size (whose distances need not fit a long) is left out, as is a
null vector. Repeated ids are vectors of their own; where hashes of ids tie, the start
takes the smaller components first, null ids last. Fewer vectors than `k` give fewer
centroids; an empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Stash

#: Vectors that take their steps together.
STEP_ROWS = 1024


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors with `dims` finite components as arrays of integers."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float(1 << 21), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("int"))
    return vectors.filter(F.coalesce((F.size(v) == dims) & fine, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of x, and the steps it took."""
    k, dims = centroids.shape
    ids = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, ids, 0)
    far = np.int64(1) << 40
    padded = np.vstack([np.full((1, dims), -far), lists, np.full((1, dims), far)])
    column = np.arange(dims)
    best, label, steps = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k), np.zeros(len(x), int)
    hi = np.stack([np.searchsorted(lists[:, d], x[:, d]) for d in range(dims)], 1) + 1  # in padded lists
    lo = hi - 1
    met = np.zeros((len(x), k), bool)
    row = np.arange(len(x))
    for _ in range(k):
        below, above = x[row] - padded[lo, column], padded[hi, column] - x[row]
        down = below <= above
        at = np.where(down, lo, hi) - 1
        frontier = np.where(down, below, above)
        lo, hi = lo - down, hi + ~down
        now = np.zeros((len(row), k), bool)
        now[np.arange(len(row))[:, None], ids[at, column]] = True
        a, c = np.nonzero(now & ~met[row])
        met[row] |= now
        d = ((x[row[a]] - centroids[c]) ** 2).sum(1)
        found = np.full((len(row), k), np.iinfo(np.int64).max)
        found[a, c] = d
        c = found.argmin(1)  # of ties the smaller number
        d = found[np.arange(len(row)), c]
        closer = (d < best[row]) | ((d == best[row]) & (c < label[row]))
        best[row[closer]], label[row[closer]] = d[closer], c[closer]
        steps[row] += 1
        on = (frontier**2).sum(1) <= best[row]
        row, lo, hi = row[on], lo[on], hi[on]
        if not len(row):
            break
    return label, best, steps


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, STEP_ROWS):
            part = b.slice(at, STEP_ROWS)
            yield part.column("id"), part.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def move(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of what is nearest to each; one that has nothing stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for _, x in _blocks(batches, dims):
            label = nearest(x, centroids)[0]
            for c in np.unique(label):
                own = x[label == c]
                sums[c, :dims] += own.sum(0)
                sums[c, dims] += len(own)
        c, d = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(sums[c, d], pa.int64())], ["c", "d", "s"])

    out, sums = centroids.copy(), {}
    for r in kept.mapInArrow(run, "c int, d int, s long").groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * (dims + 1) rows at most
        sums[r.c, r.d] = int(r.s)
    for c in range(k):
        if n := sums.get((c, dims), 0):
            out[c] = [sums.get((c, d), 0) // n for d in range(dims)]
    return out


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dims):
            label, best, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(best, pa.int64())], ["id", "cluster", "distance"])

    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, cluster int, distance long")


def start(kept: DataFrame, k: int, order: Column) -> np.ndarray:
    rows = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row a kept vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    stash = Stash(spark, "centroids")
    kept = stash.keep(quantised(vectors, id_col, vector_col, dims, scale), "kept")
    centroids = start(kept, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    if len(centroids):
        for _ in range(rounds):
            centroids = move(kept, centroids)
        placed = assign(kept, centroids)
    else:
        placed = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    placed = stash.keep(placed, "placed")
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    spread = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    facts = [(c, spread.get(c, 0), sum(spread.values()), digest) for c, digest in digests]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
