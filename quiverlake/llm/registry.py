"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quiverlake.llm import bpe, clusters, licenses, merkle, packing, periods, pieces, quality, sharding, simhash, substrings, token_files, vectors
from quiverlake.llm.common import table
from quiverlake.session import work_folder

#: Tokenizer files; the folder is a parameter of the deployment.
TOKENIZERS = os.environ.get("QUIVERLAKE_TOKENIZERS", os.path.dirname(public_tokenizers.path("word_bpe_49k.json")))
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECE_BPE = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_successor(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, BYTE_BPE)
    return token_files.token_digests(token_files.read_tokens(spark, out))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.removal_digests(substrings.remove_repeats(docs))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.roundtrip_digests(pieces.encode_and_decode(table(spark, sf_dir, "documents"), PIECE_BPE, packed=True))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_inertia(*clusters.cluster(table(spark, sf_dir, "embeddings")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.collapse_runs(table(spark, sf_dir, "documents"), repeat_some=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports the parameters above

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_merkle": op3_merkle,
    "op4_licenses": op4_licenses,
    "op5_vectors": op5_vectors,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_substrings": op10_substrings,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_clusters": op12_clusters,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op4_licenses": licenses.oracle_sql(), "op12_clusters": clusters.oracle_sql(), "op13_runs": periods.oracle_sql()}
