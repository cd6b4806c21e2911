"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and equal ones collapse to classes.  A unit vector x is stored as
``s * q + e`` with int8 ``q``; the length of the error ``e`` is known exactly, so the dot product of two
vectors lies within ``ex * (1 + ey) + ey`` of the product of their int8 forms.  Tiles of int8 vectors are
multiplied (as float32, exact for such integers); only pairs that the bound leaves possibly above the
threshold are computed again in double precision.

Classes are dealt to G rows of tiles, and each pair of rows is one task, so every class goes to G tasks; a row
has at most ``ROW`` classes, fewer where there would be too few tasks.  Vectors travel as the bytes of their own
components (four for a float), from which a task has both forms.  A task returns, for each vector, the number
of vectors it links to and at most one edge (a forest), never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component, as are vectors of another length; equal vectors link with each other;
rows with equal ids count as two vectors; a null id is reported as it is; columns besides id and vector are
left out, so that their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.components import connected_components, with_smallest
from quiverlake.llm.simhash import _Forest
from quiverlake.session import materialize

THRESHOLD = 0.95
#: Most and least classes of one row of tiles, and classes of one product inside a task.
ROW = 6144
LEAST_ROW = 512
_BLOCK = 1024


def tile_rows(n: int, tasks: int, row: int = ROW) -> int:
    """Rows of tiles for ``n`` classes: as many as their size asks for, or as ``tasks`` pairs of rows need."""
    wanted = math.ceil((math.sqrt(8 * tasks + 1) - 1) / 2)
    return max(1, -(-n // row), min(wanted, n // LEAST_ROW))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by the largest part first, so none overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 form, scale, and length of the error of each row, rounded up."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    error = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8), scale, error


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Yield (rows of a, rows of b) of the pairs with cosine at or above the threshold.

    ``b`` None: the pairs within ``a``, each once.
    """
    own = b is None
    b = a if own else b
    qa, sa, ea = quantise(a)
    qb, sb, eb = (qa, sa, ea) if own else quantise(b)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for i in range(0, len(a), _BLOCK):
        left = qa[i : i + _BLOCK].astype(exact)
        for j in range(i if own else 0, len(b), _BLOCK):
            dot = left @ qb[j : j + _BLOCK].astype(exact).T
            x, y = slice(i, i + _BLOCK), slice(j, j + _BLOCK)
            slack = ea[x].max() * (1 + eb[y].max()) + eb[y].max()
            low = (threshold - slack - 1e-6) / (sa[x].max() * sb[y].max())
            m, n = np.nonzero(dot >= (low if low > 0 else -np.inf))  # coarse, by the largest of the tile
            m, n, near = m + i, n + j, dot[m, n]
            fit = near * sa[m] * sb[n] + ea[m] * (1 + eb[n]) + eb[n] >= threshold - 1e-9
            if own and i == j:
                fit &= m < n
            m, n = m[fit], n[fit]
            for k in range(0, len(m), 1 << 16):
                p, r = m[k : k + (1 << 16)], n[k : k + (1 << 16)]
                sure = np.einsum("ij,ij->i", a[p], b[r]) >= threshold
                yield p[sure], r[sure]


def _usable(col: str) -> F.Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(col).isNotNull() & ~F.exists(col, bad) & F.exists(col, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", row: int = ROW) -> DataFrame:
    """Rows ``(id, n_links long, component_id, kept boolean)``, one for each vector."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = given.where(_usable("v"))
    classes = materialize(
        usable.groupBy("v").agg(F.count("*").alias("w"), F.min("id").alias("least"))
        .select("v", "w", "least", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("c")), "classes")
    n = classes.count()
    rows = tile_rows(n, int(spark.conf.get("spark.sql.shuffle.partitions")), row)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, kind).tobytes())

    own = F.pmod(F.xxhash64("c"), F.lit(rows)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    tiles = classes.select("c", "w", packed("v").alias("v"), "dim", own.alias("own")).withColumn("p", F.explode(pairs)).select("c", "w", "v", "own", "dim", "p.i", "p.j")

    def join(key, table):
        x = unit(np.frombuffer(b"".join(table["v"].to_pylist()), kind).astype(np.float64).reshape(table.num_rows, -1))
        c, w, home = (table[k].to_numpy() for k in ("c", "w", "own"))
        i, j = key[1].as_py(), key[2].as_py()
        left = home == i
        order = np.concatenate([np.nonzero(left)[0], np.nonzero(~left)[0]])
        x, c, w, k = x[order], c[order], w[order], int(left.sum())
        links, forest = np.zeros(len(c), np.int64), _Forest(len(c))
        if i == j or 0 < k < len(c):
            for p, r in tile_links(x, None, threshold) if i == j else tile_links(x[:k], x[k:], threshold):
                r = r if i == j else r + k
                np.add.at(links, p, w[r])
                np.add.at(links, r, w[p])
                forest.link(p, r)
        at = np.nonzero(links)[0]
        return pa.table({"c": c[at], "links": links[at], "to": c[forest.roots()[at]]}, schema=pa.schema([("c", pa.int64()), ("links", pa.int64()), ("to", pa.int64())]))

    found = materialize(tiles.groupBy("dim", "i", "j").applyInArrow(join, "c long, links long, to long"), "links")
    groups = connected_components(found.select(F.col("c").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = (
        classes.select("c", "w", "v", "least").join(counts, "c", "left").join(groups, F.col("c") == F.col("node"), "left")
        .select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"))
    )
    of_class = with_smallest(named, "component", "least", "v").select("v", "n_links", F.col("smallest").alias("component_id"))
    linked = usable.join(of_class, "v").select("id", "n_links", "component_id")
    alone = given.where(~_usable("v")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
