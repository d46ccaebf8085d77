"""Session helpers shared by every subpackage: code shipping and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
#: Folders that materialise() wrote, by the open temporaries() around it.
_OPEN: list[list[str]] = []


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Workers on other machines have neither the driver's working folder nor its sys.path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sonolake-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """(file system, path) as Hadoop sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without a scheme belongs to Spark's default file system, not to each machine's disk."""
    files, p = hadoop_path(spark, path)
    return files.makeQualified(p).toString().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sonolake-scratch-")
        sc.setCheckpointDir(found)
    return qualified(spark, found)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/sonolake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It cuts the lineage as checkpoint() does, but compressed, columnar, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, p = hadoop_path(spark, path)
    files.delete(p, True)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the folders that materialise() wrote inside; take from the list what is to stay.

    Write what depends on them before the end.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        for path in made:
            remove_folder(spark, path)


def release(spark: SparkSession) -> None:
    """Delete what this application materialised; results that were not written yet cannot be read afterwards."""
    remove_folder(spark, f"{scratch_root(spark)}/sonolake/{spark.sparkContext.applicationId}")
