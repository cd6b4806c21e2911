"""Embedding by a service that may fail: batches, bounded requests in flight, retries, dead letters.

Rows of a partition go out in batches, some requests at a time, and come back in order.  Errors are classed by
their message: transient ones are tried again with growing pauses; a batch that fails for good is halved until
the rows that the service won't take stand alone.  These come back as dead letters, with the error, so that no row
is lost and none ends the job.  A lost executor's partition is embedded again.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from quiverlake.functions.text import PERMANENT, TRANSIENT
from quiverlake.session import materialize

#: Texts to vectors; raises an error if the service fails.
Service = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Limits:
    """Rows of a request, requests in flight for a task, tries, and pauses in seconds (base, most)."""

    batch: int = 32
    in_flight: int = 4
    tries: int = 3
    base: float = 0.5
    most: float = 5.0


def error_class(message: str) -> str:
    if any(w in message for w in PERMANENT):
        return "permanent"
    return "transient" if any(w in message for w in TRANSIENT) else "unknown"


def ask(service: Service, texts: Sequence[str], limits: Limits) -> list[tuple[Sequence[float] | None, str | None, str | None]]:
    """``(vector, error, class)`` of each text; the error is that of the last try."""
    message = ""
    for t in range(limits.tries):
        try:
            found = service(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return [(v, None, None) for v in found]
        except Exception as e:  # noqa: BLE001  whatever a service raises is a failed request
            message = f"{type(e).__name__}: {e}"
            if error_class(message) != "transient":
                break
            if t + 1 < limits.tries:
                time.sleep(min(limits.most, limits.base * 2**t))
    if len(texts) == 1:
        return [(None, message, error_class(message))]
    half = len(texts) // 2
    return ask(service, texts[:half], limits) + ask(service, texts[half:], limits)


def embed(rows: DataFrame, service: Service, text: str = "vectorize_text", limits: Limits = Limits()) -> DataFrame:
    """``rows`` with ``vector array<float>``, ``error`` and ``error_class``; one of vector and error is null.

    Null texts aren't sent and are dead letters of class permanent; columns of these names are replaced.
    """
    made = [StructField("vector", ArrayType(FloatType())), StructField("error", StringType()), StructField("error_class", StringType())]
    kept = [f for f in rows.schema if f.name not in {m.name for m in made}]
    given = rows.select(*[f.name for f in kept])
    kind = StructType([*kept, *made])
    at = given.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        waiting: deque[tuple[pa.RecordBatch, list[str | None], Future]] = deque()

        def take() -> pa.RecordBatch:
            b, texts, answer = waiting.popleft()
            found = iter(answer.result())
            each = [next(found) if t is not None else (None, "no text", "permanent") for t in texts]
            new = [pa.array([e[k] for e in each], schema.field(len(kept) + k).type) for k in range(3)]
            return pa.RecordBatch.from_arrays([*b.columns, *new], schema=schema)

        with ThreadPoolExecutor(limits.in_flight) as pool:
            for whole in batches:
                for k in range(0, whole.num_rows, limits.batch):
                    b = whole.slice(k, limits.batch)
                    texts = b.column(at).to_pylist()
                    sent = [t for t in texts if t is not None]
                    waiting.append((b, texts, pool.submit(ask, service, sent, limits) if sent else pool.submit(list)))
                    if len(waiting) >= limits.in_flight:
                        yield take()
            while waiting:
                yield take()

    return given.mapInArrow(run, kind)


def embedded_and_dead(rows: DataFrame, service: Service, text: str = "vectorize_text", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Rows with their vectors, and dead letters with their errors; the service is asked once for both."""
    done = materialize(embed(rows, service, text, limits), "embedded")
    return done.where(F.col("error").isNull()).drop("error", "error_class"), done.where(F.col("error").isNotNull()).drop("vector")
