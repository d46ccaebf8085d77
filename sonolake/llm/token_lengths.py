"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are counted by their number of tokens. Sums over the histogram from its top (suffix sums) then
give, for a limit at each length that occurs: how many documents are longer, how many tokens survive when
every document is cut at the limit, how many are lost, and the quantile rank of the length. at_limits() and at_quantiles()
answer for any limit and share from these rows.

The histogram is summed up in two steps, inside ranges of SPAN lengths and over the ranges' totals, so
that no task gets all lengths.

Defined results: null and empty texts have length 0 and count; repeated rows count each; an empty table
gives no rows (at_limits() then gives zeros, at_quantiles() nulls). Extra columns are not read. A limit below the smallest
length fits no document and cuts all; limits are not negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_tree import TreeCodec
from .common import materialise, ready

SPAN = 1024


def lengths(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row of column n_tokens for each document."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(codec.encode(t)) // 4 for t in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, n_docs."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """For a context limit at each occurring length:

    n_docs (of this length), docs_le and tokens_le (that fit), docs_gt and tokens_gt (longer ones),
    truncated_total (tokens left when all are cut at the limit), lost_tokens, and quantile
    (share of documents that fit).
    """
    span = F.floor(F.col("n_tokens") / SPAN)
    cells = hist.select("n_tokens", "n_docs", span.alias("span"))
    sums = cells.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    up = Window.orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = sums.select("span", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t_above"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inner = Window.partitionBy("span").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    tail = cells.join(above, "span").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.coalesce(F.sum("n_docs").over(inner), F.lit(0)) + F.col("d_above")).alias("docs_gt"),
        (F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")).over(inner), F.lit(0)) + F.col("t_above")).alias("tokens_gt"),
    )
    cut = F.col("t_all") - F.col("tokens_gt") + F.col("n_tokens") * F.col("docs_gt")
    return tail.select(
        "n_tokens", "n_docs", (F.col("d_all") - F.col("docs_gt")).alias("docs_le"), (F.col("t_all") - F.col("tokens_gt")).alias("tokens_le"), "docs_gt", "tokens_gt",
        cut.alias("truncated_total"), (F.col("t_all") - cut).alias("lost_tokens"), ((F.col("d_all") - F.col("docs_gt")) / F.col("d_all")).alias("quantile"),
    )


def at_limits(rows: DataFrame, limits: list[int]) -> DataFrame:
    """The same answers for any limits. rows: of answers(); what stands below a limit is the last row not above it.

    All limits are found in one pass of partial aggregates. With no row below, every document is longer than the limit.
    """
    last = [F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "docs_le", "tokens_le", "docs_gt"))).alias(f"at{i}") for i, x in enumerate(limits)]
    one = rows.agg(F.coalesce(F.max(F.col("docs_le") + F.col("docs_gt")), F.lit(0)).alias("docs"), F.coalesce(F.max(F.col("tokens_le") + F.col("tokens_gt")), F.lit(0)).alias("tokens"), *last)
    each = F.array(*(F.struct(F.lit(x).cast("long").alias("context"), F.col(f"at{i}").alias("at")) for i, x in enumerate(limits)))
    found = one.select("docs", "tokens", F.explode(each).alias("e")).select("docs", "tokens", "e.*")
    le, fit = F.coalesce("at.docs_le", F.lit(0)), F.coalesce("at.tokens_le", F.lit(0))
    cut = fit + F.col("context") * (F.col("docs") - le)
    return found.select("context", le.alias("docs_le"), fit.alias("tokens_le"), (F.col("docs") - le).alias("docs_gt"), (F.col("tokens") - fit).alias("tokens_gt"), cut.alias("truncated_total"), (F.col("tokens") - cut).alias("lost_tokens"))


def at_quantiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that this share of the documents does not exceed. rows: of answers()."""
    least = [F.min(F.when(F.col("docs_le") >= F.lit(x) * (F.col("docs_le") + F.col("docs_gt")), F.col("n_tokens"))).alias(f"at{i}") for i, x in enumerate(shares)]
    each = F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"at{i}").alias("n_tokens")) for i, x in enumerate(shares)))
    return rows.agg(*least).select(F.explode(each).alias("e")).select("e.*")


def token_lengths(docs: DataFrame) -> DataFrame:
    return answers(materialise(histogram(lengths(docs)), "token-lengths"))
