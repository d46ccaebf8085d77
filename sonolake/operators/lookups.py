"""Small joins and parsing around feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CODECS, SIGNATURES


def signature_join(rows: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """Adds kbps by a range join with the signature table (six rows, so it is broadcast); 0 outside all ranges."""
    ranges = rows.sparkSession.createDataFrame([(float(a), float(b), k) for a, b, k in SIGNATURES], "lo double, hi double, found int")
    met = rows.join(F.broadcast(ranges), (F.col(cutoff) >= F.col("lo")) & (F.col(cutoff) < F.col("hi")), "left")
    return met.withColumn("kbps", F.coalesce("found", F.lit(0))).drop("lo", "hi", "found")


def parse_metadata(rows: DataFrame) -> DataFrame:
    """Header fields given as text: what cannot be parsed takes the default."""
    def read(name: str, kind: str, default: object) -> F.Column:
        return F.coalesce(F.col(name).try_cast(kind), F.lit(default)).alias(name)

    rest = [x for x in rows.columns if x not in ("sample_rate", "bit_depth", "channels", "duration")]
    return rows.select(*rest, read("sample_rate", "int", 44100), read("bit_depth", "int", 16), read("channels", "int", 2), read("duration", "double", 0.0))


def codec_jobs(files: DataFrame) -> DataFrame:
    """Every file with every transcoding target (ten rows): label, encoder, extension, bitrate, arguments.

    The codecs are exploded from a literal, so that no join is needed.
    """
    codecs = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("encoder"), F.lit(x).alias("extension"), F.lit(r).alias("bitrate"), F.lit(e).alias("arguments")) for a, b, x, r, e in CODECS))
    return files.withColumn("codec", F.explode(codecs)).select("*", "codec.*").drop("codec")


def target_path(path: F.Column, source_root: str, target_root: str, label: F.Column) -> F.Column:
    """Where a transcode goes: its label's folder, then the path below the source root; null outside it."""
    inner = relative_path(path, source_root)
    return F.concat(F.lit(target_root.rstrip("/") + "/"), label, F.lit("/"), inner)


def posix(path: F.Column) -> F.Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: F.Column, root: str) -> F.Column:
    """The path below a root with slashes only; null outside it. Drive letters and folders compare without case."""
    start = root.replace("\\", "/").rstrip("/") + "/"
    p = posix(path)
    return F.when(F.lower(F.left(p, F.lit(len(start)))) == start.lower(), F.substring(p, len(start) + 1, 1 << 30))


def shell_path(path: F.Column) -> F.Column:
    """A folder with a drive letter as Unix shells on such systems name it, with a slash at its end."""
    p = posix(path)
    drive, rest = F.lower(F.rtrim(F.substring_index(p, "/", 1), F.lit(":"))), F.regexp_replace(p, "^[^/]*/?", "")
    return F.concat(F.rtrim(F.concat(F.lit("/"), drive, F.lit("/"), rest), F.lit("/")), F.lit("/"))


def repair_summary(rows: DataFrame) -> DataFrame:
    """total, fixed, skipped, errors of rows of a repair (skipped, success booleans)."""
    return rows.agg(F.count("*").alias("total"), F.count_if("success").alias("fixed"), F.count_if(~F.col("success") & F.col("skipped")).alias("skipped"), F.count_if(~F.col("success") & ~F.col("skipped")).alias("errors"))
