"""File scans: paths and sizes without reading bodies, FLAC or other audio by extension. Spark's file source lists no file of 0 bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import OTHER_AUDIO
from ..runtime import hadoop_path


def split_paths(text: str) -> list[str]:
    """Several paths in one string: split at ;, or else at commas; a pair of quotes around a path goes."""
    parts = text.split(";" if ";" in text else ",")
    return [c for p in parts if (c := unquoted(p))]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "flac", "flac").when(ext.isin(OTHER_AUDIO), "other_audio")


def classify(files: DataFrame) -> DataFrame:
    """Adds filename, ext and kind to rows with path, and drops files of no known kind."""
    return files.withColumns({"filename": F.element_at(F.split("path", "/"), -1), "ext": extension(F.col("path")), "kind": kind(F.col("path"))}).where("kind is not null")


def unquoted(path: str) -> str:
    return re.sub(r"""^(["'])(.*)\1$""", r"\2", path.strip())


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths that exist, without quotes around them, and those that don't; empty ones are left out."""
    found: list[str] = []
    missing: list[str] = []
    for p in filter(None, map(unquoted, paths)):
        files, path = hadoop_path(spark, p)
        (found if files.exists(path) else missing).append(p)
    return found, missing


def scan_files(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """path, length, modificationTime, filename, ext, kind of audio files below the folders; contents are not read.

    With a pattern, all files whose name it matches (wav scans, ripping logs); kind may be null then.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    if pattern is None:
        return classify(files)
    named = files.withColumns({"filename": F.element_at(F.split("path", "/"), -1), "ext": extension(F.col("path")), "kind": kind(F.col("path"))})
    return named.where(F.col("filename").rlike(pattern))


def contents(spark: SparkSession, paths: list[str], glob: str = "*") -> DataFrame:
    """path, length, content of files of one name pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths).select("path", "length", "content")
