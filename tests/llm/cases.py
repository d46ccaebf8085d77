"""Small tables with nulls, empty and very long texts, ties, repeated rows and extra columns."""

import random

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ["n_tokens", "score", "key", "id", "node", "mark", "h", "kept", "label", "held_out", "component", "block", "word", "ids", "payload", "quality", "x", "at"]


def words(seed, n, alphabet="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


def rows():
    base = words(1, 200)
    near = base.split()
    near[100] = "CHANGED"
    passage = "\n".join(words(i, 60) for i in range(50, 55))
    out = [(1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base.upper(), "en", "a"), (4, None, None, None), (5, "", "en", "b"), (6, " \n\t", "fr", "b"), (7, "one two", "fr", "b")]
    out += [(8, "one two", "fr", "b"), (9, words(9, 20_000), "de", "c"), (10, "x" * 30_000, "de", "c"), (11, "12 34 ## 😀", None, "c"), (12, words(3, 80) + "\n" + passage + "\n" + words(4, 80), "en", "a")]
    out += [(13, words(5, 80) + "\n" + passage + "\n" + words(6, 80), "en", "a"), (14, words(15, 80, "äöüßé"), "de", "a"), (None, words(16, 60), "en", "d"), (9, words(9, 20_000), "de", "c")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


def documents(spark, clashing=True):
    df = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def folder(spark, path, docs, **tables):
    """Writes tables as a data folder."""
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
