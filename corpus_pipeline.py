"""Corpus pipeline: quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes the result of each stage as
Parquet and reads it again as the documents of the next.  All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import near_copies, packing, quality, substrings
from quiverlake.llm.common import table, unused
from quiverlake.llm.registry import BYTE_BPE
from quiverlake.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; labels of held-out rows aren't learned from.

    Null texts are judged as empty ones; repeated rows stay or go together; all columns stay, whatever their
    names; an empty table stays empty.
    """
    ranking = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~quality.held_out()))
    mark = unused(docs, "quality")[0]
    return quality.score(docs, ranking, mark).where(F.col(mark) >= quality.CUT).select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of five-word shingles): the one of the smallest id.

    SimHash proposes and exact sets decide, see :mod:`quiverlake.llm.near_copies`.  Texts without words are copies
    of each other; of repeated rows, and of rows that share the smallest id, exactly one stays; rows without an
    id stay only where no other of their group has one; all columns stay; an empty table stays empty.
    """
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur elsewhere; ``n_chars`` follows the text.

    Null and empty texts stay as they are; repeated rows lose each other's windows; a text that loses all its
    words stays as an empty one; all columns stay; an empty table stays empty.
    """
    words, removed = unused(docs, "words", "removed")
    reduced = substrings.remove_repeats(docs, counts=(words, removed))
    length = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return reduced.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; null and empty texts are one piece, the end id."""
    return packing.piece_digests(packing.pack(docs, BYTE_BPE))


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_copies),
    ("repeats", cut_repeats),
    ("packing", pack_windows),
]

#: SQL can't express the trained ranking, groups of near copies or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
