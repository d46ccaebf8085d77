"""Feature rows, signals and frames derived from the star-schema tables by integer arithmetic, so that the
operators have inputs in data without audio. The oracles derive the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATES = [44100, 48000, 88200, 96000, 192000, 50000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysed file for each order: the measures that rules read."""
    k = F.col("o_orderkey")
    m40 = k % 40
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        (10000 + (k * 37) % 12051).cast("double").alias("cutoff"),
        (300 + (k * 91) % 1300).cast("double").alias("container"),
        F.element_at(F.array(*map(F.lit, RATES)), (k % 6 + 1).cast("int")).alias("rate"),
        F.when(k % 2 == 0, 16).otherwise(24).alias("depth"),
        ((k % 7) * 40).cast("double").alias("std"),
        ((k % 3) * F.lit(0.00001)).alias("energy"),
        F.when(m40 >= 5, m40 / F.lit(100.0)).alias("ratio"),
        (k % 5 == 0).alias("vinyl"),
        (k % 60).cast("double").alias("clicks"),
        (-60 - k % 20).cast("double").alias("noise_db"),
        ((k % 8) / F.lit(16.0)).alias("noise_corr"),
        (k % 16).cast("double").alias("preecho"),
        ((k % 9) / F.lit(10.0)).alias("aliasing"),
        (k % 4 == 0).alias("pattern"),
        ((k % 25) * F.lit(60.0)).alias("segment_std"),
        (k % 6).cast("int").alias("problematic"),
        (-70 + k % 30).cast("double").alias("hiss_db"),
        ((k % 5) / F.lit(10.0)).alias("hiss_corr"),
        (-(k % 15)).cast("double").alias("slope"),
        F.when(k % 11 != 0, (k % 101) / F.lit(100.0)).alias("probability"),
        (k % 1500).cast("double").alias("gap_ms"),
    )


FEATURES_SQL = """f AS (SELECT o_orderkey AS k,
  CAST(10000 + (o_orderkey * 37) % 12051 AS DOUBLE) AS cutoff,
  CAST(300 + (o_orderkey * 91) % 1300 AS DOUBLE) AS container,
  ([44100, 48000, 88200, 96000, 192000, 50000])[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS rate,
  CASE WHEN o_orderkey % 2 = 0 THEN 16 ELSE 24 END AS depth,
  CAST((o_orderkey % 7) * 40 AS DOUBLE) AS std,
  (o_orderkey % 3) * CAST(0.00001 AS DOUBLE) AS energy,
  CASE WHEN o_orderkey % 40 >= 5 THEN (o_orderkey % 40) / CAST(100 AS DOUBLE) END AS ratio,
  o_orderkey % 5 = 0 AS vinyl,
  CAST(o_orderkey % 60 AS DOUBLE) AS clicks,
  CAST(-60 - o_orderkey % 20 AS DOUBLE) AS noise_db,
  (o_orderkey % 8) / CAST(16 AS DOUBLE) AS noise_corr,
  CAST(o_orderkey % 16 AS DOUBLE) AS preecho,
  (o_orderkey % 9) / CAST(10 AS DOUBLE) AS aliasing,
  o_orderkey % 4 = 0 AS pattern,
  (o_orderkey % 25) * CAST(60 AS DOUBLE) AS segment_std,
  CAST(o_orderkey % 6 AS INTEGER) AS problematic,
  CAST(-70 + o_orderkey % 30 AS DOUBLE) AS hiss_db,
  (o_orderkey % 5) / CAST(10 AS DOUBLE) AS hiss_corr,
  CAST(-(o_orderkey % 15) AS DOUBLE) AS slope,
  CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 101) / CAST(100 AS DOUBLE) END AS probability,
  CAST(o_orderkey % 1500 AS DOUBLE) AS gap_ms
  FROM orders)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each user: sig, idx from 0, x."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sig"), (F.row_number().over(w) - 1).alias("idx"), (F.col("value") / 500).alias("x"))


SIGNALS_SQL = """s AS (SELECT user_id AS sig,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 500 AS x FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-sample frame for each vector: vec_id, samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


FRAMES_SQL = """e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS samples FROM embeddings)"""
