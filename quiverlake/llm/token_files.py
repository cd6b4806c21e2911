"""Token-id files: whole documents in ascending id order, coded by :mod:`quiverlake.llm.rangecoder`.

The container is a Parquet table.  A row holds some whole documents: their ids and lengths, the coded
blocks of their concatenated token ids, the bits of an id, a checksum for each block, and its place: the id range it belongs
to and the number of token ids before it in that range.  Ranges ascend with the document id, so the place
of every document in the whole follows from the sums of the ranges.

Defined results: a null or empty text is the end id alone; null document ids come first; rows with equal
ids follow each other in order of text; ids of documents are numbers or texts; texts of any length are one
row; other columns are left out, so that their names can't clash; a damaged block raises; an empty table
reads back empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import rangecoder
from quiverlake.llm.byte_tokens import byte_tokenizer
from quiverlake.llm.common import map_rows, text_of
from quiverlake.llm.ranges import IdRanges, range_parts

END_ID = 2
#: Token ids of a row, at most; a document with more is one row.
ROW_IDS = rangecoder.BLOCK
#: Coded rows that are turned into Python objects together.
READ_ROWS = 8

_COLUMNS = ["part", "start_in_part", "doc_ids", "lengths", "blocks", "sums", "ids", "bits"]


def _cuts(n: int) -> list[slice]:
    """Even blocks of a row of n ids."""
    blocks = -(-n // rangecoder.BLOCK)
    return [slice(k * n // blocks, (k + 1) * n // blocks) for k in range(blocks)]


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = END_ID) -> None:
    """Tokenize every whole text once and write the container to ``out``."""
    given = docs.select("doc_id", text_of().alias("text"))
    parts = range_parts(docs)
    ranges = IdRanges.of(given, "doc_id", parts)
    placed = (
        given.withColumn("part", ranges.part("doc_id"))
        .repartition(parts // 4, "part")
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        encoder = byte_tokenizer(path)
        bits = max(rangecoder.ID_BITS, (encoder.greatest_id | end_id).bit_length())
        part, run = None, 0
        held: list[tuple] = []  # documents of the row that is filled
        held_ids = 0

        def code() -> dict:
            ids = np.concatenate([np.frombuffer(i, "<u4") for _, i in held])
            blocks = [ids[c] for c in _cuts(len(ids))]
            row = (part, run, [d for d, _ in held], [len(i) for _, i in held], rangecoder.encode_blocks(blocks, bits), [rangecoder.checksum(b) for b in blocks], len(ids), bits)
            return {n: [v] for n, v in zip(_COLUMNS, row)}

        for b in batches:
            for at, doc, text in zip(b["part"], b["doc_id"], b["text"]):
                ids = encoder.encode(text)
                ids.append(end_id)
                if held and (at != part or held_ids + len(ids) > ROW_IDS):
                    yield code()
                    run += held_ids
                    held, held_ids = [], 0
                if at != part:
                    part, run = at, 0
                held.append((doc, ids))
                held_ids += len(ids)
        if held:
            yield code()

    coded = map_rows(placed, rows, f"part int, start_in_part long, doc_ids array<{kind}>, lengths array<long>, blocks array<binary>, sums array<long>, ids long, bits int")
    coded.write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Rows ``(doc_id, start, tokens binary)`` of a container; tokens are little-endian unsigned 32-bit."""
    stored = spark.read.parquet(out)
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    # one number for each range; the ranges are a fixed multiple of the shuffle partitions
    totals = dict(stored.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    before, run = [], 0
    for p in range(max(totals, default=-1) + 1):
        before.append(run)
        run += totals.get(p, 0)
    start = F.element_at(F.lit(before), F.col("part") + 1) + F.col("start_in_part") if before else F.col("start_in_part")

    def rows(batches):
        for b in batches:
            for doc_ids, lengths, blocks, sums, n, bits, place in zip(*(b[c] for c in ("doc_ids", "lengths", "blocks", "sums", "ids", "bits", "start"))):
                parts = rangecoder.decode_blocks(blocks, [c.stop - c.start for c in _cuts(n)], bits)
                for k, (x, s) in enumerate(zip(parts, sums)):
                    if rangecoder.checksum(x) != s:
                        raise ValueError(f"block {k} of the row of document {doc_ids[0]} is damaged")
                ends = np.cumsum(lengths)
                starts, whole = (ends - lengths).tolist(), np.concatenate(parts)
                yield {"doc_id": doc_ids, "start": [place + k for k in starts], "tokens": [whole[k:e].tobytes() for k, e in zip(starts, ends.tolist())]}

    return map_rows(stored.select("doc_ids", "lengths", "blocks", "sums", "ids", "bits", start.alias("start")), rows, f"doc_id {kind}, start long, tokens binary", READ_ROWS)


def token_digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))
