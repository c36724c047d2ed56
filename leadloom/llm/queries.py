"""Queries of the training-data operators, by name, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, language, licenses, mixing, near_duplicates, neighbours, ogg, repeats, secrets, token_file, toxicity, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_license_scan": lambda spark, d: licenses.op1(spark, table(spark, d, "documents")),
    "op2_source_mix": lambda spark, d: mixing.op2(spark, table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.op3(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_secret_scan": lambda spark, d: secrets.op4(spark, table(spark, d, "documents")),
    "op5_ngram_join": lambda spark, d: near_duplicates.op5(spark, table(spark, d, "documents")),
    "op6_byte_bpe": lambda spark, d: bpe.op6(spark, table(spark, d, "documents")),
    "op7_language_id": lambda spark, d: language.op7(spark, table(spark, d, "documents")),
    "op8_token_file": lambda spark, d: token_file.op8(spark, table(spark, d, "documents")),
    "op9_ogg_media": lambda spark, d: ogg.op9(spark, table(spark, d, "documents")),
    "op10_nearest": lambda spark, d: neighbours.op10(spark, table(spark, d, "embeddings")),
    "op11_whitening": lambda spark, d: whitening.op11(spark, table(spark, d, "embeddings")),
    "op12_suffix_dedup": lambda spark, d: repeats.op12(spark, table(spark, d, "documents")),
    "op13_conversation_trie": lambda spark, d: conversation_trie.op13(spark, table(spark, d, "conversations")),
}

ORACLES: dict[str, str] = {"op2_source_mix": mixing.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
