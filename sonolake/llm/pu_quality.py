"""Quality classifier from positive and unlabelled documents.

A logistic model g(x) is fitted on trusted positives P (quality 1) and unlabelled web text U with the
non-negative unbiased risk, where pi is the estimated share of positives among U:

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

plus a small ridge on the weights. With the logistic loss l(g) - l(-g) = -g, so what stands left of max is convex on either side of
the clip: the risk is the larger of two convex functions, the unbiased risk A and the clipped one C (without the second
term). Its minimum is found by its dual: minimise t A + (1 - t) C, smooth and convex, by Newton steps; the second term at that
minimum falls with t, so t is 1 if it is not negative there, 0 if it is still negative at 0, and otherwise the t at which it is 0, by bisection. U is
every document that trains and has no label; gradients and curvatures are sums over all of them, made by the executors.

pi is estimated from P and U alone: a first model tells P from U, and of all score thresholds that one counts whose share of U,
with a margin for chance, divided by its share of P is least (a set that holds positives only has pi times its share of P in U).
Negative labels are not used anywhere.

Defined results: a null or empty text has the features of an empty text and gets a score like any other;
several labels of a document count each; null labels, null ids and labels of unknown documents are left out;
if nothing is unlabelled all training documents are U; if nothing is positive every score is 0.5.
Repeated rows count each. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, ready, text_bytes
from .rule_stats import base_counts

#: Passes over the rows for one t at most, and the expected gain of a step that ends them.
STEPS = 25
TOLERANCE = 1e-6
#: Weight of the squared weights.
RIDGE = 1e-4
#: Values of the dual's t that are tried, on a logarithmic scale.
HALVINGS = 12
#: Score bins of the prior's estimate, and the chance that its margin may fail with.
BINS = 1000
DELTA = 0.1
MOST_STEP = 20.0
CUT = 0.3
#: Characters whose share is a feature each: ASCII punctuation; then the shares of letters, digits, capitals, other bytes, white space.
MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
CLASSES = [np.array([c for c in range(256) if f(c)]) for f in (lambda c: chr(c).isalpha() and c < 128, lambda c: 48 <= c < 58, lambda c: 65 <= c < 91, lambda c: c >= 128, lambda c: c in b" \t\n\r\x0b\x0c")]
WIDTH = len(MARKS) + len(CLASSES) + 8


def features(raw: bytes) -> np.ndarray:
    """Square roots of character shares, and rates of words and lines; the last is the constant 1."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))
    words = raw.split()
    n_words, chars, symbols, dup_lines, repeats = base_counts(raw, words)
    some = max(1, n_words)
    rates = [np.log1p(n_words) / 10, min(4.0, chars / some / 10), np.sqrt(symbols / max(1, chars)), dup_lines / (1 + raw.count(b"\n")), repeats / some, len(set(words)) / some, float(n_words < 50), 1.0]
    return np.concatenate([np.sqrt(n[MARKS]), [np.sqrt(n[c].sum()) for c in CLASSES], rates]).astype(np.float32)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, x (binary, WIDTH single floats)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, x binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sums(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Over rows (x, positive boolean): for U count, loss of -g, its gradient, curvature; for P count, losses of g and -g, sum of x, gradient and curvature of the loss of -g.

    A task sends one row for each sum, so what meets in a place does not grow with the documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = WIDTH
        u_sums, p_sums, counts = np.zeros(d + d * d), np.zeros(d + d + d * d), np.zeros(5)
        for b in batches:
            x, positive = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            for rows_x, out, skip in ((x[~positive], u_sums, 0), (x[positive], p_sums, d)):
                g = rows_x @ w
                s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
                out[skip : skip + d] += s @ rows_x
                out[skip + d :] += ((rows_x * (s * (1 - s))[:, None]).T @ rows_x).ravel()
                counts += (0, 0, len(g), softplus(-g).sum(), softplus(g).sum()) if skip else (len(g), softplus(g).sum(), 0, 0, 0)
            p_sums[:d] += x[positive].sum(0)
        total = np.concatenate([counts[:2], u_sums, counts[2:], p_sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    got = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(5 + 3 * WIDTH + 2 * WIDTH * WIDTH)
    out[got["k"].to_numpy()] = got["v"]
    return out


def minimise(rows: DataFrame, prior: float, t: float, w: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float, float] | None:
    """Weights that minimise t A + (1 - t) C plus the ridge, from w on, with the second term and the clipped risk there; None without positives or unlabelled rows.

    Newton steps, halved while they make it worse. A step costs one pass over the rows.
    """
    d, last, step = WIDTH, None, np.zeros(WIDTH)
    weight = np.full(d, RIDGE)
    weight[-1] = 1e-8
    for _ in range(steps):
        s = sums(rows, w)
        n_u, loss_u, grad_u, curve_u = s[0], s[1], s[2 : 2 + d], s[2 + d : 2 + d + d * d].reshape(d, d)
        n_p, loss_p, loss_np = s[2 + d + d * d : 5 + d + d * d]
        sum_p, grad_p, curve_p = s[5 + d + d * d : 5 + 2 * d + d * d], s[5 + 2 * d + d * d : 5 + 3 * d + d * d], s[5 + 3 * d + d * d :].reshape(d, d)
        if not n_p or not n_u:
            return None
        second, ridge = loss_u / n_u - prior * loss_np / n_p, float(weight @ (w * w)) / 2
        value = prior * loss_p / n_p + t * second + ridge
        if last is not None and value > last[0] + 1e-12:
            if np.abs(step).max() < 1e-6:
                break
            step, w = step / 2, last[1] - step / 2
            continue
        last = value, w, second, prior * loss_p / n_p + max(0.0, second) + ridge
        # over P: l(g) has the gradient (sigmoid - 1) x, l(-g) the gradient sigmoid x
        gradient = t * grad_u / n_u + prior * ((1 - t) * grad_p - sum_p) / n_p + weight * w
        curve = t * curve_u / n_u + (1 - t) * prior * curve_p / n_p + np.diag(weight + 1e-9)
        step = np.linalg.solve(curve, gradient)
        if float(gradient @ step) < TOLERANCE:
            break
        step = step * min(1.0, MOST_STEP / max(1e-9, float(np.abs(step).max())))
        w = w - step
    return last[1:]


def fit(rows: DataFrame, prior: float, steps: int = STEPS) -> np.ndarray | None:
    """Weights of the least non-negative risk, or None without positives or unlabelled rows. rows: x, positive; the others are unlabelled."""
    found = minimise(rows, prior, 1.0, np.zeros(WIDTH), steps)
    if found is None or found[1] >= 0:
        return found and found[0]
    low, high, tried = 0.0, 1.0, [found, minimise(rows, prior, 0.0, found[0], steps)]
    if tried[1][1] > 0:
        for _ in range(HALVINGS):
            t = math.sqrt(low * high) if low else high / 8
            tried.append(minimise(rows, prior, t, tried[-1][0], steps))
            low, high = (t, high) if tried[-1][1] >= 0 else (low, t)
    return min(tried, key=lambda x: x[2])[0]


def estimate_prior(rows: DataFrame) -> float:
    """The share of positives among unlabelled rows. rows: x, positive."""
    found = minimise(rows, 0.5, 1.0, np.zeros(WIDTH), 4)
    if found is None:
        return 0.5
    shared = rows.sparkSession.sparkContext.broadcast(found[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS, np.int64)
        for b in batches:
            g = 1 / (1 + np.exp(-np.clip(matrix(b.column(0)) @ shared.value, -500, 500)))
            at = np.minimum((g * BINS).astype(np.int64), BINS - 1) + BINS * b.column(1).to_numpy(zero_copy_only=False)
            total += np.bincount(at, minlength=2 * BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * BINS), pa.int32()), pa.array(total)], ["k", "n"])

    got = rows.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(2 * BINS)
    count[got["k"].to_numpy()] = got["n"]
    return prior_of(count[:BINS], count[BINS:])


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The least bound over all thresholds, from counts by score bin."""
    above_u, above_p = (np.cumsum(x[::-1]) for x in (unlabelled, positive))
    margin = math.sqrt(math.log(4 / DELTA) / 2 / above_u[-1]) + math.sqrt(math.log(4 / DELTA) / 2 / above_p[-1])
    some = above_p > 0
    bound = (above_u[some] / above_u[-1] + margin) / (above_p[some] / above_p[-1])
    best = int(bound.argmin())
    share = above_u[some][best] / above_u[-1] / (above_p[some][best] / above_p[-1])
    return float(np.clip(share, 0.01, 0.99))


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of the fold (modulus, remainder) are not learned from."""
    spark = ready(docs.sparkSession)
    modulus, rest = held_out_fold
    held = fold("doc_id", modulus) == rest
    table = materialise(feature_table(docs), "pu-features")
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "quality")
    trained = table.where(~held).join(marks, "doc_id", "left").select("x", "quality")
    rows = materialise(trained.select("x", "quality"), "pu-rows")
    n = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    tagged = rows.where("quality is null or quality = 1").select("x", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive"))
    if not n.get(None):
        tagged = rows.where("quality = 1").select("x", F.lit(True).alias("positive")).unionAll(rows.select("x", F.lit(False).alias("positive")))
    w = fit(tagged, estimate_prior(tagged)) if n.get(1) else None
    shared = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, 0.5) if shared.value is None else 1 / (1 + np.exp(-np.clip(matrix(b.column(1)) @ shared.value, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
