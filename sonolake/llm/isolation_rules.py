"""Isolation forest over quality rules' statistics, with a threshold from labelled rows.

Trees split random samples of documents at random values of random statistics; documents that are cut off
after few splits are anomalies: score = 2 ** (-mean path length / expected path length). Samples are all
that the forest needs of the corpus: TREES * SAMPLE rows, those with the smallest hash, whatever the corpus' size.
All documents are scored. The threshold is the score at which labelled good and bad rows part best, found on
a histogram of the scores of all labelled rows that pass the base rules; it never drops more than MAX_LOSS of the labelled good rows.

Defined results: a null or empty text has no words and fails the base rules; rows labelled more than once count
for each label, null labels and labels of unknown ids are left out; without labels of both kinds no document is
an anomaly. Repeated rows count each, equal rows get equal scores; a null doc_id takes no part in labels. An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ready
from .rule_stats import BASE, rule_stats

TREES = 200
#: Small samples keep a crowd of like anomalies from looking normal.
SAMPLE = 64
SEED = 7
BINS = 1000
MAX_LOSS = 0.03


def features() -> list[Column]:
    """Ratios, so that long and short documents compare."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("f_size"), (F.col("word_chars") / words).alias("f_word"), F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("f_symbols"),
        F.log1p("n_dup_lines").alias("f_lines"), (F.col("n_repeat_words") / words).alias("f_repeats"),
    ]


FEATURES = ["f_size", "f_word", "f_symbols", "f_lines", "f_repeats"]


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> dict[str, np.ndarray]:
    """A forest as arrays over nodes: feature (-1: leaf), value, left, right, length (of a leaf's path), and the roots."""
    r = np.random.default_rng(seed)
    feature, value, left, right, length, roots = [], [], [], [], [], []

    def node(rows: np.ndarray, depth: int, limit: int) -> int:
        at = len(feature)
        feature.append(-1), value.append(0.0), left.append(-1), right.append(-1), length.append(0.0)
        lo, hi = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) < 2 or not len(usable):
            length[at] = depth + float(expected_path(len(rows)))
            return at
        f = int(r.choice(usable))
        v = float(r.uniform(lo[f], hi[f]))
        below = rows[:, f] < v
        feature[at], value[at] = f, v
        left[at] = node(rows[below], depth + 1, limit)
        right[at] = node(rows[~below], depth + 1, limit)
        return at

    for _ in range(trees):
        rows = x[r.choice(len(x), min(sample, len(x)), replace=False)] if len(x) else x
        roots.append(node(rows, 0, math.ceil(math.log2(max(2, len(rows))))))
    return {"feature": np.array(feature), "value": np.array(value), "left": np.array(left), "right": np.array(right), "length": np.array(length), "roots": np.array(roots), "norm": np.array(max(1e-9, float(expected_path(min(sample, len(x))))))}


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for root in forest["roots"]:
        at = np.full(len(x), root)
        while (inner := forest["feature"][at] >= 0).any():
            i = at[inner]
            below = x[rows[inner], forest["feature"][i]] < forest["value"][i]
            at[inner] = np.where(below, forest["left"][i], forest["right"][i])
        total += forest["length"][at]
    return 2.0 ** (-total / len(forest["roots"]) / forest["norm"])


def threshold(by_bin: pd.DataFrame, max_loss: float = MAX_LOSS) -> float:
    """by_bin: bin, good (0 or 1), n. The lower edge of the bins to drop; above 1 if labels of one kind are missing."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, g, n in by_bin.itertuples(index=False):
        (good if g else bad)[int(b)] += n
    if not good.sum() or not bad.sum():
        return 2.0
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= max_loss, caught - lost, -1)
    best = int(gain.argmax())
    return best / BINS if gain[best] > 0 else 2.0


def smallest_hashes(stats: DataFrame, most: int) -> DataFrame:
    """The FEATURES of the `most` rows with the smallest hash. A limit on the hash that twice as many rows are expected
    to pass comes first, so that tasks have few rows to send; if fewer than asked for pass, all rows are looked at."""
    h = F.xxhash64("doc_id", *FEATURES)
    hashed = stats.select(*FEATURES, h.alias("h"))
    n = max(1, stats.count())
    share = min(1.0, 2.0 * most / n)
    near = hashed.where(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    if share < 1 and near.count() < most:
        near = hashed
    return near.orderBy("h", *FEATURES).limit(most).select(*FEATURES)


def screen(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, BASE, base_failed, anomaly (score), threshold, kept."""
    spark = ready(docs.sparkSession)
    stats = materialise(rule_stats(docs), "rule-stats").select("doc_id", *BASE, *features())
    rows = smallest_hashes(stats, trees * sample).toPandas().to_numpy(float)
    forest = spark.sparkContext.broadcast(grow(rows, trees, sample))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.drop(columns=FEATURES).assign(anomaly=anomaly(forest.value, p[FEATURES].to_numpy(float)))

    kept_columns = ", ".join(f"{c} long" for c in ["doc_id", *BASE])
    scored = materialise(stats.mapInPandas(run, f"{kept_columns}, anomaly double"), "rule-anomalies")
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long"), (F.col("quality") == 1).alias("good"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = scored.where(~failed).join(marks, "doc_id")
    by_bin = judged.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"), "good").agg(F.count("*").alias("n")).toPandas()
    limit = threshold(by_bin)
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), "anomaly", F.lit(limit).alias("threshold"), (~failed & (F.floor(F.col("anomaly") * BINS) < limit * BINS)).alias("kept"))
