"""Centroid clustering of integer vectors with block-norm screening.

A vector x is compressed once to 8-bit codes: x = step * code + r, with one step
for each vector. The remainder r is cut into segments of ``BLOCK`` components, of
which only the norms are kept, beside the codes. By Cauchy and Schwarz a segment
of r has at most |r_s| |c_s| in common with that of a centroid c, so
|x|^2 + |c|^2 - 2 (step * code c + sum over s of |r_s| |c_s|) is a lower bound of
the squared distance that takes the compressed vector and the centroid alone.
The centroid of least bound gets its exact distance first; of the others only
those whose bound does not exceed the best distance so far get one. Bounds are
floating-point numbers and lowered by more than their error, distances are exact
integers, so the result is that of comparing with every centroid.

A round is one pass over the vectors: each task assigns its rows and returns
one row for each centroid with the sums of its own rows, which Spark adds up.
Only k rows reach the driver, the vectors are never shuffled, and the k
centroids of a round go to the tasks with its code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, check_shipped, materialize

#: Components of a segment, and the largest component: squared distances of 64 of them fit 64 bits.
BLOCK, MOST = 8, 1 << 27
#: Share of |x|^2 + |c|^2 by which bounds are lowered; their error is under 1e-14 of it.
SLACK = 1e-12
COMPRESSED = "vec_id long, q array<int>, step int, codes array<byte>, norms array<double>"


def block_norms(q: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row; the last segment may be shorter."""
    squares = q.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, q.shape[1], BLOCK), axis=1))


def compress(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, codes, norms of the remainder's segments) of each row."""
    step = np.maximum(1, -(-np.abs(q).max(1) // 127))
    codes = np.rint(q / step[:, None]).astype(np.int64)
    return step.astype(np.int32), codes.astype(np.int8), block_norms(q - step[:, None] * codes)


@dataclass(frozen=True)
class Centroids:
    """Centroids (k rows) with the norms of their segments."""

    q: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(q: np.ndarray) -> Centroids:
        check_shipped(2 * q.nbytes, f"{len(q)} centroids")
        return Centroids(q, block_norms(q))

    def bounds(self, q: np.ndarray, step: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """A number for each row and centroid that its squared distance is not below."""
        square, own = np.einsum("nd,nd->n", q, q)[:, None].astype(np.float64), (self.q**2).sum(1).astype(np.float64)
        common = step[:, None] * (codes.astype(np.float64) @ self.q.T.astype(np.float64)) + norms @ self.norms.T
        return (square + own) * (1 - SLACK) - 2 * common - 1

    def nearest(self, q: np.ndarray, step: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, number of exact distances) of each row; of
        centroids equally far the first."""
        low = self.bounds(q, step, codes, norms)
        cluster = low.argmin(1)
        far = lambda rows, c: ((q[rows] - self.q[c]) ** 2).sum(1)
        distance, tried = far(slice(None), cluster), np.ones(len(q), dtype=np.int32)
        first = cluster.copy()
        for c in range(len(self.q)):
            open_ = np.flatnonzero((low[:, c] <= distance) & (first != c))
            if not len(open_):
                continue
            d = far(open_, c)
            tried[open_] += 1
            better = (d < distance[open_]) | ((d == distance[open_]) & (c < cluster[open_]))
            rows = open_[better]
            distance[rows], cluster[rows] = d[better], c
        return cluster.astype(np.int32), distance, tried


def compressed(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """The vectors with exactly ``dims`` components, none of them null or
    non-finite, as q = floor(scale * x), with their compressed form. In the shared
    folder, since every round reads them."""
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == dims).where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            step, codes, norms = compress(_rows(b, "q", np.int64))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(step), lists(codes), lists(norms)], ["vec_id", "q", "step", "codes", "norms"])

    return materialize(kept.select("vec_id", whole.alias("q")).mapInArrow(run, COMPRESSED))


def _rows(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1).astype(kind)


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _rows(batch, "q", np.int64), batch.column("step").to_numpy(), _rows(batch, "codes", np.int8), _rows(batch, "norms", np.float64)


def starts(held: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of ``seed:vec_id``, ties by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = held.select(mark.alias("mark"), "q").orderBy(F.col("mark").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in first], dtype=np.int64)


def _assigned(held: DataFrame, centroids: Centroids) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *map(pa.array, centroids.nearest(*_parts(b)))], ["vec_id", "cluster", "distance", "n_exact"])

    return held.mapInArrow(run, "vec_id long, cluster int, distance long, n_exact int")


def _totals(held: DataFrame, centroids: Centroids) -> list[tuple[int, int, int, list[int]]]:
    """(cluster, rows, sum of distances, sums of components) of each non-empty cluster."""
    k, dims = centroids.q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, dtype=np.int64), [0] * k, np.zeros((k, dims), dtype=np.int64)
        for b in bounded(batches):
            q, *short = _parts(b)
            cluster, distance, _ = centroids.nearest(q, *short)
            for c in np.unique(cluster):
                own = cluster == c
                n[c] += own.sum()
                sums[c] += q[own].sum(0)
                # in two halves: the distances of a task may add up to more than 64 bits
                far[c] += (int((distance[own] >> 32).sum()) << 32) + int((distance[own] & 0xFFFFFFFF).sum())
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array([str(far[c]) for c in at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "far", "sums"])

    rows = held.mapInArrow(run, "cluster int, n long, far string, sums array<long>")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    got = rows.groupBy("cluster").agg(F.sum("n").alias("n"), whole(F.col("far")).alias("far"), *(whole(F.col("sums")[d]).alias(f"s{d}") for d in range(dims))).collect()
    return [(r["cluster"], r["n"], int(r["far"]), [int(r[f"s{d}"]) for d in range(dims)]) for r in got]


@dataclass(frozen=True)
class Clustering:
    """vectors (vec_id, cluster, distance, n_exact); centroids; inertia by cluster."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> Clustering:
    """Lloyd's rounds from the vectors of smallest hash: assign, then replace each
    centroid that has vectors by the floor of their mean; at last assign again.
    With fewer than k vectors there are as many centroids as vectors."""
    held = compressed(vectors, dims, scale)
    q = starts(held, k, seed)
    if not len(q):
        empty = held.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_exact"))
        return Clustering(empty, np.zeros((0, dims), dtype=np.int64), {})
    for _ in range(rounds):
        q = q.copy()
        for c, n, _, sums in _totals(held, Centroids.of(q)):
            q[c] = [s // n for s in sums]
    last = Centroids.of(q)
    return Clustering(_assigned(held, last), q, {c: far for c, _, far, _ in _totals(held, last)})


def op11(vectors: DataFrame) -> DataFrame:
    """The cluster of every vector of 64 finite components, and how far it is.

    Null vectors, those of other lengths, and those with a null or non-finite
    component are left out. Repeated rows get a row each, and each counts. Rows
    without vec_id count as others do, and start as centroids last. Ties between
    centroids go to the smaller number, ties between starts (equal vec_id) to the
    smaller components. Components beyond 2^27 count as 2^27, so that distances
    fit a long; a sum of distances that doesn't is null. An empty table gives no
    rows; other columns aren't looked at.
    """
    got = cluster(vectors)
    sha = [F.sha2(F.lit(",".join(map(str, c.tolist()))), 256) for c in got.centroids]
    fits = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    own = [fits(got.inertia.get(c, 0)) for c in range(len(sha))]
    of = lambda columns, kind: (F.get(F.array(*columns), F.col("cluster")) if columns else F.lit(None)).cast(kind)
    return got.vectors.select("vec_id", "cluster", "distance", of(own, "long").alias("cluster_inertia"), fits(sum(got.inertia.values())).alias("inertia"), of(sha, "string").alias("centroid_sha256"))
