"""What several corpus operators need: text columns as bytes, word rules, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialise, release, scratch_path, scratch_root, ship_code

__all__ = ["fold", "materialise", "ready", "release", "repeated", "salt", "scratch_path", "scratch_root", "table", "text_bytes", "unused", "words_of"]

#: Rows of an Arrow batch. Texts can be long, so a batch stays far below Spark's default of 10,000.
BATCH_ROWS = 1000
#: Cells that the rows of one key are dealt to.
SALTS = 64


def ready(spark: SparkSession) -> SparkSession:
    ship_code(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text in UTF-8; a null text is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(raw: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case: bytes.lower and bytes.split know ASCII only."""
    return raw.lower().split()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column (in any case) has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def salt(n: Column | int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), n if isinstance(n, Column) else F.lit(n))


def repeated(rows: DataFrame, keys: list[str], by: list[str], least: str | None = None, every: bool = False) -> DataFrame:
    """The rows whose keys occur more than once, with n (how often) and, if asked for, the least value of a column as least.
    With every, also all other rows, those with a null key among them; n and least are null there.

    Rows are counted in cells of keys and a salt made of `by`; the at most SALTS cells of equal keys then meet, and what they
    have together goes back by cell. So one key's rows never meet in one task. No column may be called n, least or salt.
    """
    salted = rows.withColumn("salt", salt(SALTS, *by))
    cells = salted.groupBy(*keys, "salt").agg(F.count("*").alias("n"), *([F.min(least).alias("least")] if least else []))
    same = Window.partitionBy(*keys)
    known = cells.select(*keys, "salt", F.sum("n").over(same).alias("n"), *([F.min("least").over(same).alias("least")] if least else [])).where("n > 1")
    return salted.join(known.hint("merge"), [*keys, "salt"], "left" if every else "inner").drop("salt")
