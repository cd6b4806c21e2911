"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string  # the parser of DDL strings that works without a session

from quiverlake.session import materialize

#: Rows that are turned into Python lists together; lists of texts then stay in the low megabytes.
BATCH_ROWS = 256

#: Words of the word-based operators: anything but ASCII white space.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many signs in front as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Run ``rows`` over the columns of a partition as lists of at most ``batch_rows`` values.

    ``rows`` gets an iterator of ``{column: list}`` and yields the same shape.  The session's settings stay as
    they are; ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds what comes from the JVM at once.
    """
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in _slices(batches, batch_rows))
        for out in rows(lists):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def add_columns(df: DataFrame, inputs: list[str], fields: StructType, compute: Callable[..., dict[str, list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``fields``, computed from the lists of the columns ``inputs`` of each batch.

    Other columns pass as Arrow data, whatever their types; a field that exists is replaced in its place.
    """
    made = {f.name: f for f in fields}
    kept = [made.pop(f.name, f) for f in df.schema if f.name not in drop]
    kind = StructType([*kept, *made.values()])
    arrow, names = to_arrow_schema(kind), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, BATCH_ROWS):
            new = compute(*(b.column(names.index(c)).to_pylist() for c in inputs))
            columns = [pa.array(new[f.name], f.type) if f.name in new else b.column(names.index(f.name)) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, kind)


def text_of(col: str = "text") -> F.Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> dict[str, F.Column]:
    """Two hashes, ``k`` of id and text and ``k2`` of the text; rows with equal keys are repeated rows."""
    text = text_of(text_col)
    return {"k": F.xxhash64(id_col, text), "k2": F.crc32(text.cast("binary"))}


def keep_keys(docs: DataFrame, keys: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` for each of the ``chosen`` keys; ``keys`` has those of every row."""
    rows = materialize(keys.groupBy("k", "k2").agg(F.count("*").alias("rows")).join(chosen, ["k", "k2"]), "chosen")
    names = unused(docs, "k", "k2")
    given = docs.withColumns(dict(zip(names, row_keys(id_col, text_col).values())))

    def of(kept: DataFrame) -> DataFrame:
        return given.join(kept.select("k", "k2").toDF(*names), names, "left_semi")

    kept = of(rows.where("rows = 1"))
    if not rows.where("rows > 1").isEmpty():
        kept = kept.unionByName(of(rows.where("rows > 1")).dropDuplicates(names))
    return kept.select(*docs.columns)
