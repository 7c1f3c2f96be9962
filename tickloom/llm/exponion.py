"""Operator 11, centroid clustering: k-means in exact integers with Exponion search.

A vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to all others.
Bounds follow the centroids' moves, and a vector whose upper bound is strictly below its lower bound, or below half the
way from its centroid to the nearest other, keeps its centroid unseen. Any other vector scans the centroids inside a
ball around its current one, of radius twice the upper bound plus the way to the nearest other centroid, which holds
the nearest and the second nearest. The ball's centroids are read off the sorted distance list of the current centroid,
in annuli of doubling width. The radius is inclusive and the tests are strict, so ties are seen and go to the smaller
number. Bounds are floating-point numbers, rounded outwards; distances and sums are integers, so they are exact.

A round is one pass without a shuffle: tasks write their vectors with new bounds and, beside them, one row of sums a
centroid. The sums are added up in Spark, and only the new centroids (``k`` rows) reach the driver. Rounds are tables in
the shared folder; the one before is removed. Copies need no care, as nothing is dealt by a vector's value.

Defined results: vectors that are null, of another length, or with a null or non-finite component have no row.
Components are cut off at 2**27 in size (values of 524,288), so that squared distances fit 64 bits. Repeated rows are vectors of
their own. A null id counts as an empty text among the first centroids, ids that repeat go by their components. With
fewer vectors than centroids every vector starts one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

CENTROIDS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
LIMIT = 1 << 27
#: Components up to which sums of products are exact in floating point.
EXACT = 1 << 22
#: Factors that round a bound outwards.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Centroids in the first annulus.
ANNULUS = 4
NONE = np.iinfo(np.int64).max
STATE = "vec_id {0}, x array<int>, cluster int, upper double, lower double, distance bigint, n bigint, sums array<bigint>, scanned bigint"


class Centroids:
    """Centroids, their distances from each other in ascending order, and how far each has moved."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.c = np.array(rows, np.int64)
        self.k = len(rows)
        self.small = int(np.abs(self.c).max(initial=0)) <= EXACT
        apart = np.sqrt(((self.c[:, None, :] - self.c[None]) ** 2).sum(-1).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.near = self.apart[:, 1] if self.k > 1 else np.full(1, np.inf)
        self.moved = np.zeros(self.k) if before is None else np.sqrt(((self.c - np.array(before, np.int64)) ** 2).sum(-1).astype(float))
        most = np.sort(self.moved)[::-1]
        # the largest move among the others
        self.others = np.where(self.moved == most[0], most[min(1, self.k - 1)] if (self.moved == most[0]).sum() == 1 else most[0], most[0])

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances to each vector's centroid."""
        return ((x - self.c[cluster]) ** 2).sum(1)

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of all vectors to some centroids."""
        c = self.c[which]
        if self.small and int(np.abs(x).max(initial=0)) <= EXACT:
            a, b = x.astype(float), c.astype(float)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
        return np.stack([((x - row) ** 2).sum(1) for row in c], 1)

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Moves every vector to its nearest centroid; returns the number of distances that were computed."""
        upper += self.moved[cluster]
        upper *= UP
        lower -= self.others[cluster]
        lower *= DOWN
        safe = np.maximum(lower, self.near[cluster] * (DOWN / 2))
        open_ = np.flatnonzero(~(upper < safe))
        known = open_[np.isfinite(upper[open_])]
        upper[known] = np.sqrt(self.own(x[known], cluster[known]).astype(float)) * UP
        open_ = open_[~(upper[open_] < safe[open_])]
        return len(known) + sum(self.ball(int(a), open_[cluster[open_] == a], x, cluster, upper, lower) for a in np.unique(cluster[open_]))

    def ball(self, a: int, rows: np.ndarray, x, cluster, upper, lower) -> int:
        """Nearest and second nearest centroid of the vectors of centroid ``a`` inside their balls."""
        radius = (2 * upper[rows] + self.near[a]) * UP if self.k > 1 else np.full(len(rows), np.inf)
        inside = np.searchsorted(self.apart[a], radius, side="right")
        far = np.argsort(-inside, kind="stable")
        rows, inside = rows[far], inside[far]
        best, second, number = np.full(len(rows), NONE), np.full(len(rows), NONE), np.full(len(rows), self.k)
        start, width, scanned = 0, ANNULUS, 0
        while n := int(np.searchsorted(-inside, -start, side="left")):
            which = self.order[a, start:start + width]
            d = self.squared(x[rows[:n]], which)
            scanned += d.size
            least = d.min(1)
            first = np.where(d == least[:, None], which, self.k).min(1)
            d[which == first[:, None]] = NONE
            next_ = d.min(1)
            better = (least < best[:n]) | ((least == best[:n]) & (first < number[:n]))
            second[:n] = np.where(better, np.minimum(best[:n], next_), np.minimum(second[:n], least))
            best[:n], number[:n] = np.where(better, least, best[:n]), np.where(better, first, number[:n])
            start, width = start + width, 2 * width
            if start >= self.k:
                break
        cluster[rows] = number
        upper[rows] = np.sqrt(best.astype(float)) * UP
        lower[rows] = np.where(second == NONE, np.inf, np.sqrt(second.astype(float)) * DOWN)
        return scanned


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that count, as integers."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(e, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(LIMIT - 1.0)), F.lit(-1.0 * LIMIT))).cast("int"))
    return vectors.filter((F.size("embedding") == dimensions) & ~odd).select("vec_id", whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The vectors of the least hashes, in ascending order; ``k`` rows at most."""
    h = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in vectors.orderBy(h, "vec_id", "x").limit(k).select("x").collect()]


def assigned(state: DataFrame, centroids: Centroids) -> DataFrame:
    """Every vector with its nearest centroid, bounds and distance, and one row of sums a task and centroid."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        sums, counts, scanned = np.zeros(centroids.c.shape, np.int64), np.zeros(centroids.k, np.int64), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            vectors = b.column("x")
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            cluster = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            upper, lower = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
            scanned += centroids.search(x, cluster, upper, lower)
            for j in np.unique(cluster):
                own = x[cluster == j]
                sums[j] += own.sum(0)
                counts[j] += len(own)
            nothing = pa.nulls(n)
            ids = b.column("vec_id")
            schema = schema or pa.schema([
                ("vec_id", ids.type), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()),
                ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("scanned", pa.int64())])
            yield pa.RecordBatch.from_arrays([
                ids, vectors.cast(pa.list_(pa.int32())), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(centroids.own(x, cluster)),
                nothing.cast(pa.int64()), nothing.cast(pa.list_(pa.int64())), nothing.cast(pa.int64())], schema=schema)
        if schema:
            used = np.flatnonzero(counts)
            nothing = pa.nulls(len(used))
            seen = np.where(np.arange(len(used)) == 0, scanned, 0)
            yield pa.RecordBatch.from_arrays([
                nothing.cast(schema.field("vec_id").type), nothing.cast(pa.list_(pa.int32())), pa.array(used.astype(np.int32)), nothing.cast(pa.float64()), nothing.cast(pa.float64()),
                nothing.cast(pa.int64()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64())), pa.array(seen)], schema=schema)

    return state.mapInArrow(run, STATE.format(kind))


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floored means of the centroids' vectors; a centroid without vectors stays."""
    parts = state.filter("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    wide = F.sum(F.col("part").cast("decimal(38,0)"))
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(wide.alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster][r.place] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, scanned: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, x, cluster, distance) of every kept vector after the rounds, and the centroids.

    ``scanned`` gets the number of distances that each pass computed.
    """
    x = kept_vectors(vectors, dimensions, scale)
    now = first_centroids(x, k)
    if not now:
        return x.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    state, before = x.select("*", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), None
    for i in range(rounds + 1):
        after = staged(assigned(state, Centroids(now, before)), "clusters")
        unstage(state)
        state, path = after.filter("n IS NULL"), after.staged_path
        state.staged_path = path
        if scanned is not None:
            scanned.append(after.agg(F.sum("scanned")).first()[0])
        if i < rounds:
            before, now = now, moved(after, now)
    return state.select("vec_id", "x", "cluster", "distance"), now
