"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last give the columns of documents. Benchmark items come from sf_dir.

Defined results of every stage: rows with null ids or texts, repeated rows, empty tables and extra columns of any name are
taken; each stage says below what becomes of them, and passes extra columns on unchanged (the last returns its own).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake import runtime
from sonolake.llm import bpe_tree, chosen_path, decontaminate, language_mixture, line_chunks
from sonolake.llm.common import materialise, ready, table, unused

#: A text of which no language explains this share is rejected.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, without a letter, or mixed so that no language has LEAST_SHARE.

    The model learns from all rows that name a language. lang becomes the predicted language. Each row is judged by its own
    text, so null and repeated ids make no difference; if no row names a language, all go.
    """
    ready(spark)
    found, (lang, score, *more) = language_mixture.annotate(docs, *language_mixture.learn(docs, F.lit(True)))
    kept = found.where((F.col(lang) != language_mixture.UNDETERMINED) & (F.col(score) >= LEAST_SHARE)).drop(*more)
    return kept.select(*(F.col(lang).alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated line chunks from texts; a document that loses lines and has no word left goes. n_chars follows the text.

    Null and empty texts stay as they are (n_chars of a null text is null). Repeated rows of one id and text are one document.
    """
    return line_chunks.cleaned(docs).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id.

    Null texts and texts without words stay. A row without an id goes if a row with an id has an equal set of shingles; of rows
    that repeat an id, or have none, one stays for each text.
    """
    ready(spark)
    doc, mark = unused(docs.columns, "doc", "mark")
    result = chosen_path.near_duplicates(docs)
    gone = F.when(F.col("doc_id").isNull(), F.col("component_id").isNotNull()).otherwise(~F.col("kept"))
    lost = materialise(result.where(gone).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct(), "near-lost")
    left = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left_anti")
    named = docs.select(F.col("doc_id").alias(doc), F.xxhash64("text").alias(mark))
    again = materialise(named.groupBy(doc, mark).agg(F.count("*").alias("n")).where("n > 1").select(doc, mark), "near-repeated")
    if again.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark))
    twice = left.join(again, same).dropDuplicates([doc, mark]).select(*docs.columns)
    return left.join(again, same, "left_anti").unionAll(twice)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item. Each row is judged by its own text, whatever its id; null texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of each row's text; a null text is encoded as an empty one."""
    ready(spark)
    return bpe_tree.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: EM, shingle similarity and byte-pair merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's inner tables go when its result is written, and its result when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with runtime.temporaries(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            written = made.pop()
        if last:
            runtime.remove_folder(spark, last)
        last = written
    return STAGES[-1][1](spark, docs, sf_dir)
