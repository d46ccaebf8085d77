"""Language proportions of each document as a mixture of character n-gram models.

Each learned language has a distribution over hashed byte trigrams of lower-cased letters. A document's
trigrams are drawn from a mixture of languages; expectation-maximisation finds the proportions:

    share(l | g) = pi[l] P(g | l) / sum_k pi[k] P(g | k),    pi[l] = mean over trigrams g of share(l | g)

The set of languages grows from the single best one: a language joins if the mixture's likelihood can rise
with it at all (mean over g of P(g | l) / mixture(g) is above 1), and stays if the log likelihood gains more than
PENALTY * ln(number of trigrams) / 2. The largest proportion names the document's language.

Defined results: a null text and a text without a letter are `und` with score 0, as is every text if nothing
was learned. Equal proportions go to the language that sorts first. Rows whose language is null or whose fold is
held out are never learned from; a null id counts as the empty text in the fold. Texts of any length are
read whole. Repeated rows count each; extra columns are not read, and annotate() passes them on, whatever their names. An empty
table gives no rows. The model takes BUCKETS numbers a language, on the driver and in each worker: more than MOST_LANGUAGES
raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import fold, ready, unused

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 8.0
STEPS = 30
TOLERANCE = 1e-4
UNDETERMINED = "und"
#: 512 KB each.
MOST_LANGUAGES = 1000
#: Bytes that are no ASCII letter and no part of a longer character count as a space.
TO_SPACE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram; trigrams with two spaces in a row say nothing and are left out."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(TO_SPACE), np.uint8).astype(np.uint32)
    x, y, z = a[:-2], a[1:-1], a[2:]
    keep = ~(((x == 32) | (z == 32)) & (y == 32))
    return ((((x << 16) | (y << 8) | z) * np.uint32(2654435761)) >> np.uint32(16))[keep]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def learn(docs: DataFrame, train: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(bucket | language) as (BUCKETS, languages), from all rows that train."""
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                t = trigrams(text)
                if len(t) > 20_000:
                    got += np.bincount(t, minlength=BUCKETS)
                else:
                    np.add.at(got, t, 1)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    if (n := rows.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages to learn; the model holds {MOST_LANGUAGES}")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    n = np.full((BUCKETS, len(langs)), SMOOTHING)
    n[found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"])] += found["n"].to_numpy()
    return langs, np.log(n / n.sum(0))


def mixture(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages (0 for others). p: P(g | l) of the document's distinct trigrams, n: their counts."""
    total = n.sum()
    single = n @ np.log(p)
    chosen, best = [int(single.argmax())], float(single.max())
    pi = np.ones(1)
    while len(chosen) < p.shape[1]:
        mix = p[:, chosen] @ pi
        gain = (n / mix) @ p / total
        gain[chosen] = 0
        new = int(gain.argmax())
        if gain[new] <= 1 + 1e-9:
            break
        q = p[:, [*chosen, new]]
        w = np.append(pi * 0.9, 0.1)
        for _ in range(STEPS):
            old = w
            w = w * ((n / (q @ w)) @ q) / total
            if np.abs(w - old).max() < TOLERANCE:
                break
        value = float(n @ np.log(q @ w))
        if value - best <= PENALTY * np.log(total) / 2:
            break
        chosen, pi, best = [*chosen, new], w, value
    out = np.zeros(p.shape[1])
    out[chosen] = pi
    return out


def judge(text: str | None, langs: list[str], model: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """The language, its proportion, the selected languages by falling proportion, and theirs."""
    if not langs or text is None or not has_letter(text):
        return UNDETERMINED, 0.0, [], []
    n = np.bincount(trigrams(text), minlength=BUCKETS)
    at = np.flatnonzero(n)
    pi = mixture(model[at], n[at].astype(float))
    order = [i for i in np.argsort(-pi, kind="stable") if pi[i] > 0]
    return langs[order[0]], min(1.0, float(pi[order[0]])), [langs[i] for i in order], [float(pi[i]) for i in order]


def annotate(docs: DataFrame, langs: list[str], logp: np.ndarray) -> tuple[DataFrame, list[str]]:
    """docs, each row with its language beside it, and the names of the four new columns (see judge)."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(np.exp(logp))
    names = unused(docs.columns, "lang_pred", "score", "languages", "proportions")
    kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t, langs, shared.value) for t in b.column("text").to_pylist()]
            more = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], ArrayType(StringType())), StructField(names[3], ArrayType(DoubleType()))])
    return docs.mapInArrow(run, schema), names


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), languages (those selected, largest first), proportions (theirs)."""
    return annotate(docs.select(F.col("doc_id").cast("long"), "text"), langs, logp)[0].drop("text")


def identify(docs: DataFrame, held_out_fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """predict() with a model of the rows outside the fold (modulus, remainder); adds held_out."""
    modulus, rest = held_out_fold
    held = fold("doc_id", modulus) == rest
    return predict(docs, *learn(docs, ~held)).withColumn("held_out", held)
