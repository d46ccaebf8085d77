"""Report aggregates and the documented queries over result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import lookups, report
from .adaptors import RATES, table
from .registry import query

RESULTS_SQL = """r AS (SELECT o_orderkey AS k, 'lib/' || (o_orderkey % 40) || '/' || o_orderkey || '.flac' AS filepath, 'd' || (o_orderkey % 40) AS folder,
 CAST(CASE WHEN o_orderkey % 50 = 0 THEN 100 WHEN o_orderkey % 77 = 0 THEN 0 ELSE (o_orderkey * 7) % 101 END AS INTEGER) AS score,
 CASE WHEN o_orderkey % 50 = 0 THEN 'NON_FLAC' WHEN o_orderkey % 77 = 0 THEN 'ERROR' WHEN (o_orderkey * 7) % 101 >= 86 THEN 'FAKE_CERTAIN' WHEN (o_orderkey * 7) % 101 >= 61 THEN 'SUSPICIOUS' WHEN (o_orderkey * 7) % 101 >= 31 THEN 'WARNING' ELSE 'AUTHENTIC' END AS verdict,
 CASE WHEN o_orderkey % 50 = 0 THEN 'NON-FLAC FILE (MP3)' ELSE 'x' END AS reason,
 CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 77 = 0 THEN 'Error' WHEN o_orderkey % 9 = 0 THEN 'gap' END AS duration_mismatch,
 CASE WHEN o_orderkey % 77 <> 0 THEN (o_orderkey * 13) % 90000 END AS duration_diff,
 o_orderkey % 3 = 0 AS has_clipping, o_orderkey % 4 = 0 AS has_dc_offset, o_orderkey % 77 = 0 AS is_corrupted, o_orderkey % 8 = 0 AS has_silence_issue, o_orderkey % 10 = 0 AS is_fake_high_res, o_orderkey % 12 = 0 AS is_upsampled,
 o_orderdate AS analyzed_at FROM orders)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    other, failed, raw = k % 50 == 0, k % 77 == 0, ((k * 7) % 101).cast("int")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.format_string("lib/%d/%d.flac", k % 40, k).alias("filepath"), F.format_string("d%d", k % 40).alias("folder"),
        F.when(other, 100).when(failed, 0).otherwise(raw).alias("score"), F.when(other, "NON_FLAC").when(failed, "ERROR").otherwise(R.verdict(raw)).alias("verdict"),
        F.when(other, "NON-FLAC FILE (MP3)").otherwise("x").alias("reason"), F.when(other, None).when(failed, "Error").when(k % 9 == 0, "gap").alias("duration_mismatch"),
        F.when(~failed, (k * 13) % 90000).alias("duration_diff"), (k % 3 == 0).alias("has_clipping"), (k % 4 == 0).alias("has_dc_offset"), failed.alias("is_corrupted"),
        (k % 8 == 0).alias("has_silence_issue"), (k % 10 == 0).alias("is_fake_high_res"), (k % 12 == 0).alias("is_upsampled"), F.col("o_orderdate").alias("analyzed_at"),
    )


def _share(name: str, condition: str) -> str:
    return f"count(*) FILTER ({condition}) AS {name}, CASE WHEN count(*) > 0 THEN printf('%.1f%%', count(*) FILTER ({condition}) / CAST(count(*) AS DOUBLE) * 100) ELSE '0%' END AS {name}_pct"


_STATS = {
    "authentic": "score < 30", "probably_authentic": "score BETWEEN 30 AND 49", "suspect": "score BETWEEN 50 AND 79", "fake": "score >= 80", "duration_issues": "duration_mismatch IS NOT NULL",
    "duration_issues_critical": "duration_mismatch IS NOT NULL AND duration_diff > 44100", "clipping_issues": "has_clipping", "dc_offset_issues": "has_dc_offset", "corrupted_files": "is_corrupted",
    "silence_issues": "has_silence_issue", "fake_high_res": "is_fake_high_res", "upsampled_files": "is_upsampled", "non_flac_files": "verdict = 'NON_FLAC' OR (score = 100 AND contains(reason, 'NON-FLAC FILE'))",
}


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS total, {', '.join(_share(n, w) for n, w in _STATS.items())} FROM r")
def statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.statistics(results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL} SELECT CASE WHEN score >= 80 THEN 'fake' WHEN score >= 50 THEN 'suspect' WHEN score >= 30 THEN 'probably_authentic' ELSE 'authentic' END AS bucket, CASE WHEN score >= 80 THEN '[XX]' WHEN score >= 50 THEN '[!!]' WHEN score >= 30 THEN '[?]' ELSE '[OK]' END AS icon, count(*) AS n_files FROM r GROUP BY ALL")
def report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy(report.bucket(F.col("score")).alias("bucket"), report.score_icon(F.col("score")).alias("icon")).agg(F.count("*").alias("n_files"))


@query(f"WITH {RESULTS_SQL} SELECT count(*) FILTER (score >= 50 AND verdict NOT IN ('NON_FLAC', 'ERROR')) AS suspicious, count(*) FILTER (score >= 80 AND verdict NOT IN ('NON_FLAC', 'ERROR')) AS fake_certain FROM r")
def console_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.console_summary(results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL} SELECT filepath, score, verdict FROM r WHERE score >= 50 ORDER BY score DESC, filepath LIMIT 10")
def suspicious_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.suspicious(results(spark, sf_dir)).select("filepath", "score", "verdict").limit(10)


@query(f"WITH {RESULTS_SQL} SELECT verdict, count(*) AS n_files, round(avg(score), 6) AS avg_score FROM r GROUP BY verdict")
def avg_score_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n_files"), F.round(F.avg("score"), 6).alias("avg_score"))


@query(f"WITH {RESULTS_SQL} SELECT verdict, count(*) AS n_files, round(count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE), 6) AS share FROM r GROUP BY verdict")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = results(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n_files"))
    return counts.select("verdict", "n_files", F.round(F.col("n_files") / F.sum("n_files").over(Window.partitionBy()), 6).alias("share"))


@query(f"WITH {RESULTS_SQL} SELECT folder, count(*) AS n_files, round(avg(CASE WHEN verdict = 'FAKE_CERTAIN' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fake_share, avg(CASE WHEN verdict = 'FAKE_CERTAIN' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.2::DOUBLE AS reject FROM r GROUP BY folder")
def fake_share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg((F.col("verdict") == "FAKE_CERTAIN").cast("double"))
    return results(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("n_files"), F.round(share, 6).alias("fake_share"), (share > 0.2).alias("reject"))


@query(f"WITH {RESULTS_SQL} SELECT folder, k, score FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY analyzed_at DESC, k DESC) AS n FROM r) WHERE n = 1")
def latest_result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest(results(spark, sf_dir), "folder", ("analyzed_at", "k")).select("folder", "k", "score")


@query(f"WITH {RESULTS_SQL} SELECT k, filepath, score FROM r WHERE verdict = 'FAKE_CERTAIN'")
def point_filter_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT k, filepath, score FROM {rows} WHERE verdict = 'FAKE_CERTAIN'", rows=results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL} SELECT k, filepath FROM r WHERE score >= 61")
def quarantine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("score >= 61").select("k", "filepath")


@query(f"WITH {RESULTS_SQL} SELECT k, filepath FROM r WHERE score <= 30")
def playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("score <= 30").select("k", "filepath")


@query(f"WITH {RESULTS_SQL} SELECT k, score FROM r WHERE score < 90")
def legacy_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("score < 90").select("k", "score")


ISSUES_SQL = """i AS (SELECT user_id, CASE event_id % 7 WHEN 0 THEN 'read_failed' WHEN 1 THEN 'corrupted' WHEN 2 THEN 'partial_read' WHEN 3 THEN 'decoder_error' WHEN 4 THEN 'retry' WHEN 5 THEN 'repair' ELSE 'other' END AS issue_type FROM events WHERE user_id % 3 <> 0 AND event_id % 5 = 0 AND NOT (user_id % 2 = 0 AND event_id % 7 < 2))"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row for each user, whose events are issues."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["read_failed", "corrupted", "partial_read", "decoder_error", "retry", "repair", "other"])), (e % 7 + 1).cast("int"))
    real = (F.col("user_id") % 3 != 0) & (e % 5 == 0) & ~((F.col("user_id") % 2 == 0) & (e % 7 < 2))
    item = F.struct(kind.alias("issue_type"), F.lit("").alias("message"), F.lit(None).cast("bigint").alias("frames_read"), F.lit(None).cast("bigint").alias("total_frames"), F.lit(0).alias("retry_count"), F.lit("").alias("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when(real, item)).alias("issues")).withColumn("filepath", F.col("user_id").cast("string"))


@query(f"WITH {ISSUES_SQL} SELECT issue_type, count(*) AS n_issues FROM i GROUP BY issue_type")
def issue_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issue_types(issues(spark, sf_dir))


@query(f"WITH {ISSUES_SQL} SELECT (SELECT count(DISTINCT user_id) FROM events) AS total_files, (SELECT count(DISTINCT user_id) FROM i) AS files_with_issues, (SELECT count(DISTINCT user_id) FROM events) - (SELECT count(DISTINCT user_id) FROM i) AS clean_files, (SELECT count(DISTINCT user_id) FROM i WHERE issue_type IN ('read_failed', 'corrupted')) AS critical_failures")
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.diagnostics(issues(spark, sf_dir))


@query(f"WITH {ISSUES_SQL} SELECT DISTINCT user_id FROM i WHERE issue_type IN ('read_failed', 'corrupted')")
def critical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).where(report.has_critical()).select("user_id")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order yet: some have one, some have none."""
    done = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return report.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("""WITH c AS (SELECT c_custkey, (['flac', 'mp3', 'm4a', 'aac', 'ogg', 'wma', 'opus', 'ape', 'txt'])[CAST(c_custkey % 9 + 1 AS INTEGER)] AS ext FROM customer)
SELECT 'f' || c_custkey || '.' || ext AS filepath, CAST(100 AS INTEGER) AS score, 'NON_FLAC' AS verdict, 'NON-FLAC FILE (' || upper(ext) || ') - Must be replaced with authentic FLAC' AS reason FROM c WHERE ext IN ('mp3', 'm4a', 'aac', 'ogg', 'wma', 'opus', 'ape')
UNION ALL SELECT 'f' || c_custkey || '.flac', CAST(c_custkey % 101 AS INTEGER), CASE WHEN c_custkey % 101 >= 86 THEN 'FAKE_CERTAIN' WHEN c_custkey % 101 >= 61 THEN 'SUSPICIOUS' WHEN c_custkey % 101 >= 31 THEN 'WARNING' ELSE 'AUTHENTIC' END, NULL FROM c WHERE ext = 'flac'""")
def append_non_audio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ext = F.element_at(F.array(*map(F.lit, ["flac", "mp3", "m4a", "aac", "ogg", "wma", "opus", "ape", "txt"])), (k % 9 + 1).cast("int"))
    files = table(spark, sf_dir, "customer").select(k, ext.alias("ext")).withColumn("filepath", F.format_string("f%d.%s", k, "ext")).withColumn("filename", F.col("filepath"))
    score = (k % 101).cast("int")
    flac = files.where("ext = 'flac'").select("filepath", score.alias("score"), R.verdict(score).alias("verdict"))
    return report.other_audio_rows(files).unionByName(flac, allowMissingColumns=True).select("filepath", "score", "verdict", "reason")


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS n_files, round(avg(score), 6) AS avg_score FROM r")
def average_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).agg(F.count("*").alias("n_files"), F.round(F.avg("score"), 6).alias("avg_score"))


@query(f"WITH {RESULTS_SQL} SELECT k, score, verdict FROM r WHERE (k % 2 = 1 AND score >= 50) OR (verdict = 'AUTHENTIC' AND k % 6 IN (1, 3, 4))")
def attribute_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep files that are suspicious, and authentic ones of a high rate."""
    k = F.col("k")
    rate = F.element_at(F.array(*map(F.lit, RATES)), (k % 6 + 1).cast("int"))
    rows = results(spark, sf_dir).withColumns({"bit_depth": F.when(k % 2 == 0, 16).otherwise(24), "sample_rate": rate})
    high = F.col("sample_rate").isin(48000, 96000, 192000)
    return rows.where(((F.col("bit_depth") == 24) & (F.col("score") >= 50)) | ((F.col("verdict") == "AUTHENTIC") & high)).select("k", "score", "verdict")


@query(f"WITH {RESULTS_SQL} SELECT filepath FROM r WHERE score >= 61 AND verdict <> 'NON_FLAC'")
def quarantine_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the JSON lines of a report: each row written as JSON, read again and filtered."""
    lines = results(spark, sf_dir).select(F.to_json(F.struct("filepath", "score", "verdict")).alias("j"))
    rows = lines.select(F.from_json("j", "filepath string, score int, verdict string").alias("r")).select("r.*")
    return rows.where("score >= 61 and verdict <> 'NON_FLAC'").select("filepath")


@query(f"""WITH {RESULTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY k) AS place, count(*) OVER (PARTITION BY folder) AS total FROM r)
SELECT k, printf('[%03d/%03d] ', place, total) || CASE WHEN score >= 80 THEN '❌ FAKE        ' WHEN score >= 50 THEN '⚠️  SUSPICIOUS  ' WHEN score >= 30 THEN '❓ WARNING     ' ELSE '✅ AUTHENTIC   ' END || lpad(score || '/100', 8, ' ') || '  ' || CASE WHEN length(name) > 50 THEN substr(name, 1, 47) || '...' ELSE name END AS line,
 CASE WHEN score >= 80 THEN '[FAKE]' WHEN score >= 50 THEN '[SUSP]' WHEN score >= 30 THEN '[?]' ELSE '[OK]' END AS icon FROM (SELECT *, repeat('x', CAST(k % 60 AS INTEGER)) || k || '.flac' AS name FROM n)""")
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    inside = Window.partitionBy("folder")
    rows = results(spark, sf_dir).withColumns({"place": F.row_number().over(inside.orderBy("k")), "total": F.count("*").over(inside), "filename": F.concat(F.repeat(F.lit("x"), (k % 60).cast("int")), k.cast("string"), F.lit(".flac"))})
    return rows.select(k, report.console_line(F.col("place"), F.col("total")).alias("line"), report.console_icon(F.col("score")).alias("icon"))


@query(f"""WITH {RESULTS_SQL} SELECT ' ' || CASE WHEN score >= 80 THEN '[XX]' ELSE '[!!]' END || ' | ' || rpad(score || '/100', 7, ' ') || ' | ' || rpad(verdict, 15, ' ') || ' | 0.0k     | -        | ' || k || '.flac' AS line FROM r WHERE score >= 50 AND verdict IN ('SUSPICIOUS', 'FAKE_CERTAIN')""")
def report_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines of two verdicts."""
    rows = results(spark, sf_dir).withColumns({"filename": F.format_string("%d.flac", "k"), "cutoff_freq": F.lit(0.0), "estimated_mp3_bitrate": F.lit(0), "suspected_original_rate": F.lit(0)})
    return report.lines_with(report.text_lines(rows, []), "SUSPICIOUS ", "FAKE_CERTAIN").where("part = 2").select("line")


@query("SELECT o_orderkey AS k, 'report_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.txt' AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def dated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), report.dated_name("report", day, "txt").alias("name"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS fixed, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'O') AS errors FROM orders")
def repair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderstatus") == "P").alias("skipped"))
    return lookups.repair_summary(rows)


@query(f"WITH {ISSUES_SQL} SELECT CAST(user_id AS VARCHAR) AS filepath, count(*) AS n_issues FROM i GROUP BY user_id")
def issues_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issues(spark, sf_dir)
    return rows.join(report.files_with_issues(rows), "filepath").select("filepath", F.size("issues").cast("long").alias("n_issues"))


@query("""WITH t AS (SELECT user_id, (['', 'CRC mismatch', 'BAD HEADER found', 'lost SYNC', 'odd', 'ok'])[CAST(user_id % 6 + 1 AS INTEGER)] AS err FROM (SELECT DISTINCT user_id FROM events))
SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN contains(upper(err), 'CRC') THEN 'CRC_MISMATCH' WHEN contains(upper(err), 'HEADER') THEN 'BAD_HEADER' WHEN contains(upper(err), 'SYNC') THEN 'LOST_SYNC' ELSE 'UNKNOWN' END AS error_type FROM t WHERE err <> ''""")
def integrity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id")
    err = F.element_at(F.array(*map(F.lit, ["", "CRC mismatch", "BAD HEADER found", "lost SYNC", "odd", "ok"])), (k % 6 + 1).cast("int"))
    return report.integrity_lists(table(spark, sf_dir, "events").select(k).distinct().select(k.cast("string").alias("path"), err.alias("stderr")))
