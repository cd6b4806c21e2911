"""Vector columns: distances, cut and scaled vectors, the hash embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), 0.0).otherwise(F.try_divide(dot(a, b), scale))


def truncate(v: Column, dim: int) -> Column:
    """The first ``dim`` parts scaled to length one, where the vector is longer; zero vectors stay."""
    head = F.slice(v, 1, dim)
    size = norm(head)
    return F.when(F.size(v) <= dim, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(head, lambda x: F.when(size == 0, x.cast("double")).otherwise(F.try_divide(x.cast("double"), size))))


def fnv1a(word: str) -> int:
    """32-bit FNV-1a over the code points of a word."""
    h = 2166136261
    for c in word:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Bag of hashed words, scaled to length one; the first axis for a text without words.

    The default of the embedding hook: any pandas UDF from text to ``array<double>`` can take its place.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                if w not in slots:
                    slots[w] = fnv1a(w) % dim
                v[slots[w]] += 1
            size = np.sqrt((v * v).sum())
            if size == 0:
                v[0] = size = 1.0
            out.append(v / size)
        return pd.Series(out)

    return embed(text)
