"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Every pair of a good and a bad labelled document says that the first is preferred.  The score of a
document is a weighted sum of text features; the weights minimise the logistic loss on feature
differences.  A document is kept when its score lies above a quantile of the training scores: the share
of bad documents among the training rows.  ``score`` is the logistic of the distance to that threshold,
placed so that the threshold falls on ``CUT``.

Labels are read from at most ``SAMPLE_ROWS`` rows, chosen by a hash of the id; ``PAIRS`` preference pairs
are drawn from them.  Features look at whole texts; labels, language, source and id are no features.

Defined results: a null text counts as empty; empty and very long texts are scored like any other, whole;
repeated rows and equal texts get equal scores; the columns of the input stay, but for one named like the
score, which the score replaces; an empty table stays empty; with no usable labels (none, or one class only) all weights are zero and each score is CUT.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quiverlake.llm.common import add_columns, map_rows, text_of

SAMPLE_ROWS = 20_000
PAIRS = 60_000
CUT = 0.7
#: Signs that prose rarely holds (fixed value).
SIGNS = "#$%&*+/<=>@[]^_`{|}~\\"

NAMES = ["signs", "doubled_signs", "bars", "repeats", "distinct", "repeated_lines", "digits", "stops", "titles", "word_length", "line_words", "length", "top_word", "ends"]


def features(text: str) -> list[float]:
    """Shares and ratios of one whole text; all finite, for the empty text too."""
    words, lines = text.split(), text.split("\n")
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = set(words)
    return [
        math.sqrt(sum(map(text.count, SIGNS)) / chars),
        math.sqrt(sum(text.count(s + s) for s in SIGNS) / n),
        math.sqrt(text.count("|") / n),
        math.sqrt(sum(map(eq, words, islice(words, 1, None))) / n),
        len(kinds) / n,
        1 - len(set(lines)) / len(lines),
        math.sqrt(sum(map(text.count, "0123456789")) / chars),
        math.sqrt((text.count(".") + text.count(",")) / n),
        sum(map(str.istitle, words)) / n,
        math.log1p(chars / n),
        math.log1p(n / len(lines)),
        math.log1p(n),
        math.log1p(n) * (1 - len(kinds) / n),
        float(text.rstrip()[-1:] in (".", "!", "?", "")),
    ]


@dataclass(frozen=True)
class Ranking:
    """Centre and scale of the features, weights, threshold and steepness."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.array(self.centre)) / np.array(self.scale), -8, 8) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.utility(x) - self.threshold) + math.log(CUT / (1 - CUT)), -700, 700)
        return 1 / (1 + np.exp(-z))


def fit_ranking(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Newton steps on the logistic loss of the feature differences of preference pairs."""
    d = x.shape[1] if x.ndim == 2 else len(NAMES)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranking((0.0,) * d, (1.0,) * d, (0.0,) * d, 0.0, 1.0)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(seed)
    std = lambda v: np.clip((v - centre) / scale, -8, 8)
    gap = std(good)[rng.integers(len(good), size=pairs)] - std(bad)[rng.integers(len(bad), size=pairs)]
    w = np.zeros(d)
    for _ in range(25):
        miss = 1 / (1 + np.exp(np.clip(gap @ w, -500, 500)))
        grad = -(gap * miss[:, None]).mean(0) + ridge * w
        curve = (gap * (miss * (1 - miss))[:, None]).T @ gap / pairs + ridge * np.eye(d)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    u = np.sort(std(x) @ w)
    k = int((y == 0).sum())  # the quantile: as many below as there are bad documents
    threshold = float(u[k - 1] + u[min(k, len(u) - 1)]) / 2
    spread = np.median(std(good) @ w) - np.median(std(bad) @ w)
    return Ranking(tuple(centre), tuple(scale), tuple(w), threshold, float(8 / max(spread, 1e-9)))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """Fit on the labelled rows of ``labels (doc_id, quality)``, at most ``sample_rows`` of them."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

    def rows(batches):
        for b in batches:
            yield {"x": [features(t) for t in b["text"]], "y": b["y"], "k": b["doc_id"]}

    # ordered, so that the fit doesn't depend on the order in which tasks end
    found = map_rows(texts, rows, "x array<double>, y int, k " + docs.schema["doc_id"].dataType.simpleString()).orderBy("k", "y", "x").collect()
    return fit_ranking(np.array([r.x for r in found]).reshape(len(found), len(NAMES)), np.array([r.y for r in found]))


def score(docs: DataFrame, ranking: Ranking, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out``: the score of each whole text.  No shuffle."""

    def compute(texts: list) -> dict:
        x = np.array([features(t or "") for t in texts]).reshape(-1, len(NAMES))
        return {out: ranking.score(x).tolist()}

    return add_columns(docs, [text_col], StructType([StructField(out, DoubleType())]), compute)


def held_out() -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document with a ranking learned from the rows that aren't held out."""
    ranking = learn(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), ranking)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
