"""Vector search over the context table and best-first retrieval along its tree.

Nearest neighbours are exact.  A query set of at most one block goes to all tasks: each partition of vectors
is multiplied with it and keeps its own nearest, so only ``queries * k`` rows of each partition are shuffled.
Larger query sets never reach the driver: blocks of queries meet slices of vectors in tiles that Spark
shuffles, and each tile keeps the nearest of its queries.  One such pass also holds every row that the tree
walk can reach, because each expansion looks at fewer neighbours than the first pass; the walk itself runs
once for each query over those few rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import scoring
from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.session import materialize

#: Queries of a block, and vectors of a slice that a block meets in one tile.
QUERY_BLOCK = 4096
SLICE = 131_072
_ROWS = 2048

#: Stop after so many rounds with the same best rows.
STEADY_ROUNDS = 3
LEAST_TOP = 10


def over_fetch(limit: int) -> int:
    return max(3 * limit, 50)


def _rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the vectors of length ``dim`` without nulls and NaN."""
    fit = np.nonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))[0]
    x = np.asarray(column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    whole = ~np.isnan(x).any(1)
    return fit[whole], x[whole]


class _Nearest:
    """The ``k`` nearest so far of each of some queries: arrays of distance, order and name."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.cosine = self._scaled(queries) if metric == "cosine" else queries, k, metric == "cosine"
        self.norm = (self.q**2).sum(1)
        self.bound = np.full(len(queries), np.inf)  # squared distance of the k-th nearest so far
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))

    @staticmethod
    def _scaled(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x**2).sum(1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def add(self, ids: np.ndarray, order: np.ndarray, x: np.ndarray) -> None:
        x = self._scaled(x) if self.cosine else x  # unit vectors: the squared distance is twice the cosine distance
        for at in range(0, len(x), _ROWS):
            part = x[at : at + _ROWS]
            norm = (part**2).sum(1)
            rough = norm[:, None] + self.norm[None, :] - 2 * (part @ self.q.T)
            least = np.minimum(self.bound, np.partition(rough, self.k - 1, axis=0)[self.k - 1]) if len(part) > self.k else self.bound
            row, n = np.nonzero(rough <= least + 1e-9 * (1 + self.norm + norm.max()))  # rounding and ties stay inside
            if len(row):
                d = 1 - (part[row] * self.q[n]).sum(1) if self.cosine else np.sqrt(((part[row] - self.q[n]) ** 2).sum(1))
                self._merge(n, d, order[at + row], ids[at + row])

    def _merge(self, *fresh: np.ndarray) -> None:
        n, d, order, ids = (np.concatenate(x) for x in zip(self.held, fresh))
        by = np.lexsort((order, d, n))
        n, d, order, ids = n[by], d[by], order[by], ids[by]
        first = np.searchsorted(n, np.arange(len(self.bound)))
        keep = np.arange(len(n)) - first[n] < self.k
        self.held = n, d, order, ids = n[keep], d[keep], order[keep], ids[keep]
        last = np.searchsorted(n, np.arange(len(self.bound)), side="right") - 1
        full = np.bincount(n, minlength=len(self.bound)) == self.k
        kth = d[last[full]]
        self.bound[full] = 2 * kth if self.cosine else kth * kth

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        n, d, order, ids = self.held
        return pa.RecordBatch.from_arrays([pa.array(qid[n], pa.int64()), pa.array(ids.tolist(), pa.string()), pa.array(order, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "ord", "distance"])


_FOUND = "query_id long, id string, ord long, distance double"


def _columns(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep, x = _rows_of(batch.column("vector"), dim)
    return np.array(batch.column("id").to_pylist(), object)[keep], batch.column("ord").to_numpy(zero_copy_only=False)[keep], x


def _nearest_of_block(queries: list, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """One block of queries, at most ``QUERY_BLOCK``, against each partition of vectors; no shuffle."""
    qid = np.array([q.query_id for q in queries], np.int64)
    q = np.array([q.vector for q in queries], np.float64)

    def run(batches):
        best = _Nearest(q, k, metric)
        for b in batches:
            best.add(*_columns(b, q.shape[1]))
        yield best.rows(qid)

    return vectors.select("id", "ord", "vector").mapInArrow(run, _FOUND)


def _nearest_by_tiles(queries: DataFrame, vectors: DataFrame, k: int, metric: str, block: int, slice_rows: int) -> DataFrame:
    """Blocks of queries meet slices of vectors; each tile is one group of bounded size."""
    blocks, slices = -(-queries.count() // block), max(1, -(-vectors.count() // slice_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.lit(None).cast("string").alias("id"), F.col("query_id").alias("ord"), F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("asks"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), every(slices).alias("s"))
    given = vectors.select("id", F.col("ord").cast("long").alias("ord"), F.col("vector").cast("array<double>").alias("vector"), F.lit(False).alias("asks"), every(blocks).alias("b"), F.pmod(F.xxhash64("ord", "id"), F.lit(slices)).cast("int").alias("s"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        q, v = (t.combine_chunks() for t in (table.filter(asks), table.filter(pc.invert(asks))))
        found = []
        for dim in pc.unique(pc.list_value_length(q.column("vector"))).to_pylist():
            at, x = _rows_of(q.column("vector").combine_chunks(), dim) if dim else ([], [])
            if not len(at):
                continue
            best = _Nearest(x, k, metric)
            for b in v.to_batches(max_chunksize=8 * _ROWS):
                best.add(*_columns(b, dim))
            found.append(best.rows(q.column("ord").to_numpy()[at]))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("ord", pa.int64()), ("distance", pa.float64())])
        return pa.Table.from_batches(found, schema)

    return asked.union(given).groupBy("b", "s").applyInArrow(run, _FOUND)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", block: int = QUERY_BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """The ``k`` nearest vectors of each query: ``(query_id, id, ord, distance, rank)``.

    ``queries (query_id long, vector)``, ``vectors (id string, ord long, vector)``; ties go to the lower
    ``ord``.  Vectors that are null, hold nulls or have another length are passed over.
    """
    few = queries.where(F.col("vector").isNotNull()).limit(block + 1).collect()  # one block and one row at most
    if not few:
        found = vectors.sparkSession.createDataFrame([], _FOUND)
    elif len(few) <= block and len({len(q.vector) for q in few}) == 1 and all(None not in q.vector for q in few):
        found = _nearest_of_block(few, vectors, k, metric)
    else:
        found = _nearest_by_tiles(queries, vectors, k, metric, block, slice_rows)
    w = Window.partitionBy("query_id").orderBy("distance", "ord")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, contexts: DataFrame, limit: int, where=None, metric: str = "l2", mode: str = "post") -> DataFrame:
    """Nearest contexts of each query with ``score`` 1 - distance.

    ``mode="post"``: the nearest ``max(3 * limit, 50)`` of all vectors are filtered, so that fewer than
    ``limit`` rows may be left; ``mode="pre"``: the nearest of the rows that pass the filter.
    """
    pred = where.column() if where else F.lit(True)
    if mode == "pre":
        vectors = vectors.join(contexts.where(pred).select("id"), "id", "left_semi")
    near = knn(queries, vectors, over_fetch(limit), metric)
    w = Window.partitionBy("query_id").orderBy("distance", "ord")
    rows = near.join(contexts.where(pred), "id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    score = 1 - F.col("distance")
    return rows.withColumn("score", F.when(F.isnan(score), 0.0).otherwise(score)).drop("rank")


def walk(rows: list[tuple], limit: int, threshold: float = 0.0, starts: tuple[str, ...] = (), converge: bool = True) -> list[tuple[str, float]]:
    """Best-first walk of one query over its nearest rows ``(uri, parent, level, score, rank, in_scope)``.

    Rows are in order of distance.  Leaves near the query are candidates at once; directories are start
    points, the others (``starts``) follow with score 0.  The best directory is opened, half of its score
    goes to its children, and its subdirectories join the queue, until nothing is left or the best rows
    have stayed the same for three openings.
    """
    m = max(limit, LEAST_TOP)
    first = [r for r in rows if r[5]][: 3 * m]
    candidates: dict[str, float] = {}
    queue: list[tuple[float, str]] = []
    known: set[str] = set()
    for uri, _, level, score, _, _ in first:
        if level is None or level == 2:
            candidates[uri] = max(score, candidates.get(uri, score))
        elif uri not in known:
            known.add(uri)
            heapq.heappush(queue, (-score, uri))
    for uri in starts:
        if uri not in known:
            known.add(uri)
            heapq.heappush(queue, (0.0, uri))
    wide = max(2 * limit, 20)
    reach = over_fetch(wide)
    children: dict[str, list[tuple]] = {}
    for r in rows:
        if r[5] and r[4] <= reach:
            children.setdefault(r[1], []).append(r)
    visited: set[str] = set()
    steady, last = 0, None
    while queue:
        negative, uri = heapq.heappop(queue)
        if uri in visited:
            continue
        visited.add(uri)
        below = children.get(uri, [])[:wide]
        if not below:
            continue
        for child, _, level, score, _, _ in below:
            final = 0.5 * score - 0.5 * negative if -negative > 0 else score
            if not np.isfinite(final):
                final = 0.0
            if final <= threshold:
                continue
            candidates[child] = max(final, candidates.get(child, final))
            if level is not None and level != 2 and child not in visited:
                heapq.heappush(queue, (-final, child))
        if converge:
            best = {u for u, _ in sorted(candidates.items(), key=lambda x: (-x[1], x[0]))[:limit]}
            steady = steady + 1 if best == last and len(best) >= limit else 0
            last = best
            if steady >= STEADY_ROUNDS:
                break
    return list(candidates.items())


def retrieve(
    queries: DataFrame, vectors: DataFrame, contexts: DataFrame, as_of, limit: int = 5, threshold: float = 0.0,
    where=None, starts: tuple[str, ...] = (), metric: str = "l2", hot_weight: float = 0.2, converge: bool = True,
) -> DataFrame:
    """Hierarchical retrieval: ``(query_id, uri, context_type, level, semantic, hotness, score, place)``."""
    limit = limit if limit > 0 else 5
    m = max(limit, LEAST_TOP)
    near = knn(queries, vectors, over_fetch(3 * m), metric)
    pred = where.column() if where else F.lit(True)
    rows = near.join(contexts, "id").withColumn("in_scope", F.coalesce(pred, F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "ord"])
        given = [(u, p, None if pd.isna(lv) else int(lv), 1 - d, r, s) for u, p, lv, d, r, s in zip(pdf["uri"], pdf["parent_uri"], pdf["level"], pdf["distance"], pdf["rank"], pdf["in_scope"])]
        found = walk(given, limit, threshold, starts, converge)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(found), "uri": [u for u, _ in found], "semantic": [s for _, s in found]})

    walked = rows.select("query_id", "uri", "parent_uri", "level", "distance", "ord", "rank", "in_scope").groupBy("query_id").applyInPandas(run, "query_id long, uri string, semantic double")
    walked = materialize(walked, "walked")  # few rows: only their contexts are looked up
    facts = contexts.join(walked.select("uri").distinct(), "uri", "left_semi").groupBy("uri").agg(F.min_by(F.struct("context_type", "level", "active_count", "updated_at"), F.coalesce("level", F.lit(2))).alias("c"))
    hot = scoring.hotness(F.coalesce("c.active_count", F.lit(0)), F.col("c.updated_at"), as_of)
    scored = walked.join(facts, "uri").withColumn("hotness", hot).withColumn("score", scoring.blend(F.col("semantic"), F.col("hotness"), hot_weight))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uri"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).select(
        "query_id", U.with_level(F.col("uri"), F.col("c.level")).alias("uri"), "c.context_type", "c.level", "semantic", "hotness", "score", "place"
    )


def categorize(results: DataFrame) -> DataFrame:
    """Results by type in order of place: memory, skill, and resource for all others."""
    kind = F.when(F.col("context_type").isin("memory", "skill"), F.col("context_type")).otherwise("resource")
    rows = F.array_sort(F.collect_list(F.struct("place", "uri", "score")))
    return results.groupBy("query_id", kind.alias("kind")).agg(rows.alias("results"))


def rerank_by_overlap(results: DataFrame, query_text: str = "query", doc_text: str = "abstract") -> DataFrame:
    """Default reranker: the share of query tokens that the text holds; null texts keep their score."""
    q, d = F.array_distinct(X.tokens(F.col(query_text))), X.tokens(F.col(doc_text))
    share = F.try_divide(F.size(F.array_intersect(q, d)), F.size(q))
    return results.withColumn("score", F.coalesce(share, F.col("score")))


def context_block(results: DataFrame, most: int) -> DataFrame:
    """Numbered snippets of each query until ``most`` bytes are used."""
    line = F.concat(F.lit("["), F.col("context_type"), F.lit("] "), F.col("uri"), F.lit(": "), F.substring("abstract", 1, 300))
    used = F.sum(F.octet_length("line")).over(Window.partitionBy("query_id").orderBy("place"))
    return results.withColumn("line", line).withColumn("used", used).where(F.col("used") <= most).drop("used")
