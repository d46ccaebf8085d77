"""Where results go: rows as JSON, CSV, Parquet or text, and reports as single files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..runtime import hadoop_path, qualified, ship_code
from .files import place


def write_rows(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """kind: parquet, json or csv (with a header; nested columns as JSON text)."""
    if kind == "csv":
        rows = rows.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema))
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_text_file(spark: SparkSession, text: str, path: str) -> None:
    """One file of a given name, in any file system that Spark knows; it appears when complete."""
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(temp, target)


def write_text_report(rows: DataFrame, scan_paths: list[str], path: str) -> None:
    """The text report of any size, as text files that follow one another."""
    report.sorted_lines(report.text_lines(rows, scan_paths)).write.mode("overwrite").text(path)


def write_json_report(rows: DataFrame, scan_paths: list[str], version: str, now: str, path: str) -> None:
    """The JSON report of any size: scan_info, one object, and results, a line a file, below the path."""
    report.scan_info(rows, scan_paths, version, now).coalesce(1).write.mode("overwrite").json(f"{path}/scan_info")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/results")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """processed_files, results, total_files, current_index, start_time, last_update of a progress file; if there is none, one row of an empty state."""
    files, p = hadoop_path(spark, path)
    if files.exists(p):
        state = spark.read.option("multiLine", True).json(path)
        if "processed_files" in state.columns:
            return state
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    none = F.array().cast("array<string>")
    return spark.range(1).select(none.alias("processed_files"), none.alias("results"), F.lit(0).alias("total_files"), F.lit(0).alias("current_index"), now.alias("start_time"), now.alias("last_update"))


def write_features(rows: DataFrame, path: str) -> None:
    """Training features: a row a sample (path, x, y, codec), by class."""
    rows.write.mode("overwrite").partitionBy("y").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bytes(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content (name, content) as a file below the folder, from the tasks; a file appears when complete.

    Gives name and n_bytes. A repeated task writes the same files again.
    """
    ship_code(rows.sparkSession)
    out = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                files, path = place(f"{out}/{name}")
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                temp = f"{path}.{uuid.uuid4().hex}.tmp"
                with files.open_output_stream(temp, compression=None) as f:
                    f.write(content)
                files.move(temp, path)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], ["name", "n_bytes"])

    return rows.select("name", "content").mapInArrow(run, "name string, n_bytes long")


def manifest_head(entries: DataFrame, root: str, logs_found: int) -> dict:
    """What a manifest says of its files: as many numbers as there are sources, and 20 labels."""
    by_source = {r.source: r.n for r in entries.groupBy("source").agg(F.count("*").alias("n")).collect()}
    top = entries.groupBy("top_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "top_label").limit(20).collect()
    return {"root": root, "count": sum(by_source.values()), "ripper_logs_found": logs_found, "source_breakdown": by_source, "top_20_labels": {r.top_label: r.n for r in top}}


def write_manifest(entries: DataFrame, root: str, logs_found: int, path: str) -> None:
    """A manifest of any size: head.json (counts, breakdown, top labels) and files (a line each) below the path."""
    entries.write.mode("overwrite").json(f"{path}/files")
    write_text_file(entries.sparkSession, json.dumps(manifest_head(entries, root, logs_found), ensure_ascii=False), f"{path}/head.json")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a data-set manifest, a row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")


def manifest_document(entries: DataFrame, root: str, logs_found: int) -> str:
    """The manifest of chosen entries (path, source, ripper, top_label) as one JSON text; for sets that fit the driver. Any size: write_manifest."""
    files = [r.asDict() for r in entries.orderBy("path").toLocalIterator()]
    return json.dumps(manifest_head(entries, root, logs_found) | {"files": files}, ensure_ascii=False)
