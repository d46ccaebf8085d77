"""Queries of the corpus operators for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, chosen_path, decontaminate, isolation_rules, language_mixture, line_chunks, pu_quality, token_lengths, unigram_lattice, warc
from .common import ready, table
from .oracles import ORACLES
from .rule_stats import BASE

__all__ = ["ORACLES", "QUERIES"]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(ready(spark), sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.round("identity", 6).alias("identity"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_lattice.lattice_scores(table(ready(spark), sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(table(ready(spark), sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation_rules.screen(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "anomaly")


def op6_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.token_lengths(table(ready(spark), sf_dir, "documents"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(ready(spark), sf_dir, "documents")).drop("mark")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(table(ready(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_decontaminate, op3_lattice, op4_language, op5_isolation, op6_token_lengths, op7_line_chunks, op8_pu_quality, op9_chosen_path, op10_bpe_tree)
}
