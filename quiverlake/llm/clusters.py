"""Centroid clustering in integers, with N-simplex projection to skip centroids.

Vectors become integers, so that distances, sums and means are exact.  The distances of a vector to a few pivots
are computed in one pass and kept with it, as the vector's coordinates over the simplex of the pivots: coordinates
in the space that the pivots span, and the height (apex) above it.  Two points whose apices lie on the same side
are at least as far apart as their coordinates say, and with apices on opposite sides at most that far.  In each
round a vector compares its few coordinates with those of the centroids; only centroids whose lower bound isn't
above the least upper bound are computed exactly.  Pivots are the first centroids, and from the second round on
the centroids of then, which later ones stay close to; how many centroids the bounds spare depends on how far the
vectors reach out of the pivots' space.

A round is one pass over the written vectors: tasks return sums and counts for each centroid, which is all that
is shuffled.  Centroids (``k`` of them) are the only thing that the driver and every task hold.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones are
left out; equal vectors and rows with equal ids count as often as they occur; a null id is never one of the first
centroids and is reported as it is; fewer vectors than centroids make fewer centroids; columns besides id and
vector are left out, so that their names can't clash; an empty table gives no rows.  Scaled components must stay
within ``LARGEST``, so that squared distances fit into a long; a table with larger ones is refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.session import discard, materialize

#: Clusters, rounds, components of a vector, and the scale of components.
CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Most pivots beside the first; points close to the space of the others are not taken.
PIVOTS = 16
#: Rounds before which pivots are chosen from the centroids.
_CHOOSE = (0, 1)
LARGEST = 1 << 26
#: Height of a pivot above the others' space, against the largest one, from which it counts.
_STEEP = 1e-2
#: Share of the length by which bounds may err: some thousand times what rounding does at that steepness.
_SLACK = 1e-6
_BLOCK = 4096


def square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


@dataclass(frozen=True)
class Simplex:
    """Pivots (integers), and the triangle that turns inner products into coordinates."""

    pivots: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Pivots from ``points``: the first, then always the point highest above the space of those before."""
        base = points[:1]
        edges = (points - base).astype(np.float64)
        rest, chosen, steepest = edges.copy(), [], 0.0
        while len(chosen) < min(most, points.shape[1]):
            height = np.sqrt(square(rest))
            k = int(height.argmax())
            steepest = max(steepest, height[k])
            if height[k] <= _STEEP * steepest:
                break
            chosen.append(k)
            along = rest[k] / height[k]
            for _ in range(2):
                rest -= np.outer(rest @ along, along)
        if not chosen:
            return cls(base, np.zeros((0, 0)))
        gram = (points[chosen] - base) @ (points[chosen] - base).T
        return cls(np.concatenate([base, points[chosen]]), np.linalg.inv(np.linalg.cholesky(gram.astype(np.float64))))

    def project(self, squares: np.ndarray) -> np.ndarray:
        """Coordinates and apex from the exact squared distances to the pivots."""
        edges = square(self.pivots[1:] - self.pivots[:1])
        inner = (squares[:, :1] + edges - squares[:, 1:]) / 2.0
        flat = inner @ self.inverse.T
        apex = np.sqrt(np.maximum(squares[:, 0] - square(flat), 0.0))
        return np.column_stack([flat, apex])

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([square(x - p) for p in self.pivots], 1)

    def nearest(self, x: np.ndarray, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and exact squared distance of the nearest centroid of each row, and the distances computed.

        ``points`` are the projections of the rows; ties go to the smaller number.
        """
        c = self.project(self.distances(centroids))
        reach = np.sqrt(square(points))[:, None] + np.sqrt(square(c))[None] + 1.0
        flat = square(points[:, None, :-1] - c[None, :, :-1])
        low = np.sqrt(flat + (points[:, -1:] - c[:, -1]) ** 2) - _SLACK * reach
        high = np.sqrt(flat + (points[:, -1:] + c[:, -1]) ** 2) + _SLACK * reach
        row, number = np.nonzero(low <= high.min(1, keepdims=True))
        exact = square(x[row] - centroids[number])
        best = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(best, row, exact)
        hit = np.flatnonzero(exact == best[row])
        chosen = np.full(len(x), -1)
        chosen[row[hit[::-1]]] = number[hit[::-1]]  # the smallest number is written last
        return chosen, best, len(row)


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``(id, x array<long>)`` of the vectors that count."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.when(F.abs(x) <= LARGEST / scale, F.floor(x * scale)).otherwise(F.raise_error("component too large for exact distances").cast("long"))
    return given.where((F.size("v") == dim) & ~F.exists("v", bad)).select("id", F.transform("v", whole).alias("x"))


def first_centroids(whole: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of least hash of seed and id; equal ids by components."""
    mark = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = whole.where(F.col("id").isNotNull()).orderBy(mark, "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _project(whole: DataFrame, simplex: Simplex, dim: int) -> DataFrame:
    """Vectors as bytes with their projections, which later rounds read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                b = batch.slice(at, _BLOCK)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                points = simplex.project(simplex.distances(x))
                packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x.astype("<i4"), points.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([b.column(0), *packed], names=["id", "x", "point"])

    return whole.mapInArrow(run, f"id {whole.schema['id'].dataType.simpleString()}, x binary, point binary")


def _assigned(projected: DataFrame, simplex: Simplex, centroids: np.ndarray, keep_rows: bool) -> DataFrame:
    """Rows ``(id, cluster, distance)``, or, not ``keep_rows``, sums and counts of a task for each cluster."""
    dim = centroids.shape[1]
    kind = projected.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                b = batch.slice(at, _BLOCK)
                x = _matrix(b.column(1), dim, "<i4").astype(np.int64)
                chosen, distance, _ = simplex.nearest(x, _matrix(b.column(2), len(simplex.pivots), "<f8"), centroids)
                if keep_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chosen, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])
                else:
                    np.add.at(sums, chosen, x)
                    counts += np.bincount(chosen, minlength=len(counts))
        if not keep_rows:
            live = np.flatnonzero(counts)
            number, place = np.repeat(live, dim), np.tile(np.arange(dim), len(live))
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in ((number, pa.int32()), (place, pa.int32()), (sums[live].ravel(), pa.int64()), (np.repeat(counts[live], dim), pa.int64()))], names=["cluster", "place", "total", "n"])

    return projected.mapInArrow(run, f"id {kind}, cluster int, distance long" if keep_rows else "cluster int, place int, total long, n long")


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """Rows ``(id, cluster int, distance long)`` after ``rounds`` rounds, and the centroids.

    A cluster without vectors keeps its centroid.
    """
    whole = integers(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return whole.where("false").select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    projected = whole
    for r in range(rounds + 1):
        if r in _CHOOSE:
            simplex, before = Simplex.of(centroids), projected
            projected = materialize(_project(whole, simplex, dim), "projected")
            if before is not whole:
                discard(before)
        if r == rounds:
            break
        found = _assigned(projected, simplex, centroids, False).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for f in found:  # k * dim rows at most
            centroids[f.cluster, f.place] = int(f.total) // f.n
    return _assigned(projected, simplex, centroids, True).withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` (both long) and ``centroid_sha256``."""
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    assigned = materialize(assigned, "assigned")
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    if not sums:
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    each = of([F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))])
    return assigned.select("*", each.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by comparing every vector with every centroid."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    near = lambda c: f"SELECT id, x, cluster, d FROM (SELECT v.id, v.x, c.cluster, {gap} AS d, row_number() OVER (PARTITION BY v.n ORDER BY {gap}, c.cluster) AS r FROM v, {c} c) WHERE r = 1"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER () AS n, list_transform(embedding::DOUBLE[], lambda e: floor(64 * e)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT x, sha256('1:' || CAST(id AS VARCHAR)) AS h FROM v WHERE id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
            f"m{r} AS (SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i)",
            f"f{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f{r} f USING (cluster))",
        ]
    last = f"c{rounds}"
    return (
        f"WITH {', '.join(steps)}, z AS ({near(last)}) SELECT id AS vec_id, CAST(z.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN {last} c ON c.cluster = z.cluster"
    )
