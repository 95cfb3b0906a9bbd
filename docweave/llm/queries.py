"""The operators' queries over their whole tables, with SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import chat, codes, decontaminate, graph, langid, matroska, pieces, pii, simhash, substrings, suffixes, toxicity, trie
from docweave.llm.common import table
from docweave.llm.oracles import OP1, OP11, OP13, OP6, OP7, OP8
from docweave.registry import Registry

REGISTRY = Registry()


@REGISTRY.query("op1_chat", OP1)
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@REGISTRY.query("op2_matroska")
def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(table(spark, sf_dir, "documents"))


@REGISTRY.query("op3_pieces")
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op6_suffixes", OP6)
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op7_substrings", OP7)
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op8_decontamination", OP8)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op11_trie", OP11)
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_report(table(spark, sf_dir, "conversations"))


@REGISTRY.query("op12_vectors")
def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicate_report(table(spark, sf_dir, "embeddings"))


@REGISTRY.query("op13_codes", OP13)
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(table(spark, sf_dir, "embeddings"))
