"""Queries that apply the corpus operators, with production parameters, to their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from registra.llm import bpe, langid, lines, mixing, oracles, periodic, permutation, pii, secrets, simhash, sketch, tokenfile, trie, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = tokenfile.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tokenfile.read_tokens(spark, path)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"))


def op5_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find(table(spark, sf_dir, "documents"), planted=True)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_tokens": op3_tokens,
    "op4_neighbours": op4_neighbours,
    "op5_sketch": op5_sketch,
    "op6_mixing": op6_mixing,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
    "op11_lines": op11_lines,
    "op12_trie": op12_trie,
    "op13_periodic": op13_periodic,
}
ORACLE_SQL: dict[str, str] = {"op11_lines": oracles.LINES, "op12_trie": oracles.TRIE}
