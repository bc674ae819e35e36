"""Centroid clustering with Elkan's bounds, on exact integers.

A vector takes part when it has exactly DIMS components, none of them null or non-finite; component x becomes
floor(256 * x). Each round assigns every vector to its nearest centroid (squared distance; ties: the smaller number)
and moves every centroid that has vectors to the floor of their mean.

Each vector carries an upper bound of the distance to its own centroid and one lower bound for each centroid,
as float32. The centroids' moves widen them, always away from the truth (float32 is rounded up or down by one
step). A distance is computed only where neither a lower bound nor half the distance between two centroids
is above the upper bound: with a strict comparison, so that a tie is always decided by exact numbers. Distances are exact
64-bit integers. The state (vector, bounds) is written once a round to the shared folder and the one before deleted;
what reaches the driver is one row a centroid and component.

Defined results: components beyond 2**27 in size take their vector out like non-finite ones, as squared distances
would not fit 64 bits; null ids seed last; copies of an id are vectors of their own, which seed in the order of
their components; fewer vectors than centroids make fewer clusters; a sum beyond 64 bits is null; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, ship

DIMS, CENTROIDS, ROUNDS, SALT = 64, 40, 5, 2
SIZE, LARGEST, EXACT = 256.0, 1 << 27, 1 << 21  # below EXACT, products of doubles stay under 2**53
ROWS = 4096
STATE = "vec_id long, x binary, cluster int, upper float, lower binary, distance long"


def integers(column: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column take part, and their components as integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = pc.fill_null(column.filter(fits).flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * SIZE)
        good = (np.abs(whole) <= LARGEST).all(1)  # false for nan and infinity
    return at[good], whole[good].astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to rows c: len(x) by len(c)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d.astype(np.float32), np.float32(np.inf))


def below(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(d.astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Centroids:
    """Centroids, half the distances between them, and how far each has moved since the round before."""

    def __init__(self, rows: np.ndarray, before: np.ndarray | None = None):
        self.rows = rows
        self.half = below(np.sqrt(squared(rows, rows).astype(np.float64)) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(1, initial=np.inf)
        self.moved = None if before is None else above(np.sqrt(((rows - before) ** 2).sum(1).astype(np.float64))).astype(np.float64)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, squared distance and bounds of vectors that have none yet."""
        d = squared(x, self.rows)
        own = d.argmin(1)  # the first of equal ones
        best = d[np.arange(len(x)), own]
        return own, best, above(np.sqrt(best.astype(np.float64))), below(np.sqrt(d.astype(np.float64)))

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before; exact asks for every vector's distance. Last: how many distances were computed."""
        upper = above(upper.astype(np.float64) + self.moved[own])
        lower = below(lower.astype(np.float64) - self.moved[None])
        own, best = own.copy(), np.full(len(x), -1, np.int64)
        asked = (upper >= self.near[own]) & ((upper[:, None] >= lower) & (upper[:, None] >= self.half[own])).any(1)
        rows = np.arange(len(x)) if exact else np.flatnonzero(asked)
        best[rows] = ((x[rows] - self.rows[own[rows]]) ** 2).sum(1)
        tight = np.sqrt(best[rows].astype(np.float64))
        upper[rows], lower[rows, own[rows]] = above(tight), below(tight)
        rows, made = np.flatnonzero(asked), len(rows)
        for j in range(len(self.rows)):
            a = own[rows]
            at = rows[(a != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= self.half[a, j])]
            if not len(at):
                continue
            d = ((x[at] - self.rows[j]) ** 2).sum(1)
            made += len(at)
            root = np.sqrt(d.astype(np.float64))
            lower[at, j] = below(root)
            won = (d < best[at]) | (d == best[at]) & (j < own[at])
            own[at[won]], best[at[won]], upper[at[won]] = j, d[won], above(root[won])
        return own, best, upper, lower, made


def _state(vec_id: pa.Array, x: np.ndarray, found: tuple) -> pa.RecordBatch:
    own, best, upper, lower = found[:4]
    packed = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
    cols = [vec_id, packed(x.astype("<i4")), pa.array(own, pa.int32()), pa.array(upper, pa.float32()), packed(lower.astype("<f4")), pa.array(best, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["vec_id", "x", "cluster", "upper", "lower", "distance"])


def _unpacked(column: pa.Array, kind: str, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, wide)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and x (little-endian 32-bit integers) of the vectors that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            at, x = integers(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array([row.tobytes() for row in x.astype("<i4")], pa.binary())], names=["vec_id", "x"])

    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, x binary")


def seeds(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The components of the k vectors whose ids hash smallest."""
    digest = F.coalesce(F.sha2(F.concat(F.lit(f"{SALT}:"), F.col("vec_id").cast("string")), 256), F.lit("~"))
    rows = vectors.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.frombuffer(b"".join(r["x"] for r in rows), "<i4").reshape(-1, DIMS).astype(np.int64)


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    k = len(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            order = np.argsort(own, kind="stable")
            x, own = _unpacked(batch.column("x"), "<i4", DIMS).astype(np.int64)[order], own[order]
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(x, first)
                n += np.bincount(own, minlength=k)
        c = np.repeat(np.flatnonzero(n), DIMS)
        cols = [pa.array(c, pa.int32()), pa.array(np.tile(np.arange(DIMS), len(c) // DIMS), pa.int32()), pa.array(total[n > 0].ravel(), pa.int64()), pa.array(np.repeat(n[n > 0], DIMS), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "dim", "total", "n"])

    summed = state.select("cluster", "x").mapInArrow(run, "cluster int, dim int, total long, n long")
    out = before.copy()
    for r in summed.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():  # k * DIMS rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def assigned(state: DataFrame, centroids: Centroids, exact: bool) -> DataFrame:
    k = len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x = _unpacked(batch.column("x"), "<i4", DIMS).astype(np.int64)
            if "lower" in batch.schema.names:
                lower = _unpacked(batch.column("lower"), "<f4", k)
                found = centroids.assign(x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), lower, exact)
            else:
                found = centroids.first(x)
            yield _state(batch.column("vec_id"), x, found)

    return state.mapInArrow(run, STATE)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    state = keep(kept(vectors))
    rows = seeds(state, k)
    before = None
    for turn in range(rounds + 1):
        last = turn == rounds
        old, state = state, keep(assigned(state, Centroids(rows, before), last))
        forget(old)
        if not last:
            before, rows = rows, means(state, rows)
    inertia = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}  # a row a centroid
    whole = lambda n: int(n) if n < 1 << 63 else None
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    found = [(c, whole(n), whole(sum(inertia.values())), digest(rows[c])) for c, n in sorted(inertia.items())]
    about = F.broadcast(spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
