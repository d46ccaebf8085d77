"""Aggregates, lists and text forms of analysis results.

results: one row a file with the fields of RESULT; a row that failed has verdict ERROR and null numbers.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ADVICE, BUCKETS, CRITICAL_ISSUES, DIAGNOSTIC_HEAD, OTHER_AUDIO

ISSUE = "struct<issue_type: string, message: string, frames_read: bigint, total_frames: bigint, retry_count: int, timestamp: string>"
RESULT = (
    "filepath string, filename string, score int, verdict string, confidence string, reason string, cutoff_freq double, sample_rate int, bit_depth int, encoder string, "
    "duration_mismatch string, duration_metadata string, duration_real string, duration_diff bigint, has_clipping boolean, clipping_severity string, clipping_percentage double, "
    "has_dc_offset boolean, dc_offset_severity string, dc_offset_value double, is_corrupted boolean, corruption_error string, partial_analysis boolean, is_partial_analysis boolean, "
    "has_silence_issue boolean, silence_issue_type string, is_fake_high_res boolean, estimated_bit_depth int, is_upsampled boolean, suspected_original_rate int, estimated_mp3_bitrate int, "
    f"issues array<{ISSUE}>"
)
WIDTH = 140


def bucket(score: Column) -> Column:
    return reduce(lambda rest, b: F.when(score >= b[0], b[1]).otherwise(rest), reversed(BUCKETS[:-1]), F.lit(BUCKETS[-1][1]))


def score_icon(score: Column) -> Column:
    return F.when(score >= 80, "[XX]").when(score >= 50, "[!!]").when(score >= 30, "[?]").otherwise("[OK]")


def counted(name: str, condition: Column) -> Column:
    return F.count_if(condition).alias(name)


def statistics(results: DataFrame) -> DataFrame:
    """One row: the total, each count and its share as text. An empty input gives zeros and "0%"."""
    s, flag = F.col("score"), lambda n: F.coalesce(F.col(n), F.lit(False))
    mismatch = F.coalesce(F.col("duration_mismatch") != "", F.lit(False))
    counts = [
        counted("authentic", s < 30), counted("probably_authentic", (s >= 30) & (s < 50)), counted("suspect", (s >= 50) & (s < 80)), counted("fake", s >= 80),
        counted("duration_issues", mismatch), counted("duration_issues_critical", mismatch & (F.col("duration_diff") > 44100)),
        counted("clipping_issues", flag("has_clipping")), counted("dc_offset_issues", flag("has_dc_offset")), counted("corrupted_files", flag("is_corrupted")),
        counted("silence_issues", flag("has_silence_issue")), counted("fake_high_res", flag("is_fake_high_res")), counted("upsampled_files", flag("is_upsampled")),
        counted("non_flac_files", (F.col("verdict") == "NON_FLAC") | ((s == 100) & F.col("reason").contains("NON-FLAC FILE"))),
    ]
    names = ["authentic", "probably_authentic", "suspect", "fake", "duration_issues", "duration_issues_critical", "clipping_issues", "dc_offset_issues", "corrupted_files", "silence_issues", "fake_high_res", "upsampled_files", "non_flac_files"]
    one = results.agg(F.count("*").alias("total"), *counts)
    share = lambda n: F.when(F.col("total") > 0, F.format_string("%.1f%%", F.col(n) / F.col("total") * 100)).otherwise("0%").alias(f"{n}_pct")
    return one.select("total", *(x for n in names for x in (F.col(n), share(n))))


def console_summary(results: DataFrame) -> DataFrame:
    """suspicious and fake_certain without rows that were not analysed."""
    real = ~F.col("verdict").isin("NON_FLAC", "ERROR")
    return results.agg(counted("suspicious", (F.col("score") >= 50) & real), counted("fake_certain", (F.col("score") >= 80) & real))


def suspicious(results: DataFrame, least: int = 50) -> DataFrame:
    """Worst first; equal scores by path, so that the order is the same each time."""
    return results.where(F.col("score") >= least).orderBy(F.desc("score"), "filepath")


def other_audio_rows(files: DataFrame) -> DataFrame:
    """Constant result rows for audio files that are not FLAC. files: filepath, filename, ext."""
    upper = F.upper("ext")
    return files.where(F.lower("ext").isin(OTHER_AUDIO)).select(
        "filepath", "filename", F.lit(100).alias("score"), F.lit("NON_FLAC").alias("verdict"), F.lit("CERTAIN").alias("confidence"),
        F.concat(F.lit("NON-FLAC FILE ("), upper, F.lit(") - Must be replaced with authentic FLAC")).alias("reason"), F.lit(0.0).alias("cutoff_freq"), upper.alias("encoder"),
        F.lit(False).alias("is_corrupted"), F.lit(False).alias("has_clipping"), F.lit(0).alias("estimated_mp3_bitrate"),
    )


def pending(files: DataFrame, done: DataFrame, key: str = "filepath") -> DataFrame:
    """Files without a result yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def latest(results: DataFrame, key: str = "filepath", order: Iterable[str] = ("analyzed_at", "seq")) -> DataFrame:
    """The newest row of each key, as an upsert leaves it. Rows merge before the shuffle, so that a key with many rows is no load."""
    newest = results.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r"))
    return newest.select("r.*")


def issue_types(results: DataFrame) -> DataFrame:
    return results.select("filepath", F.explode("issues").alias("i")).groupBy(F.col("i.issue_type").alias("issue_type")).agg(F.count("*").alias("n_issues"))


def has_critical(issues: str = "issues") -> Column:
    return F.exists(F.coalesce(F.col(issues), F.array().cast(f"array<{ISSUE}>")), lambda i: i["issue_type"].isin(CRITICAL_ISSUES))


def diagnostics(results: DataFrame) -> DataFrame:
    """total_files, files_with_issues, clean_files, critical_failures."""
    some = F.coalesce(F.size("issues") > 0, F.lit(False))
    return results.agg(F.count("*").alias("total_files"), counted("files_with_issues", some), counted("clean_files", ~some), counted("critical_failures", has_critical()))


def display_path(path: Column, filename: Column, roots: list[str]) -> Column:
    """The path below the first scan root that holds it, after a backslash; else the file name."""
    return F.coalesce(*(F.when(path.startswith(r.rstrip("/") + "/"), F.concat(F.lit("\\"), F.substring(path, len(r.rstrip("/")) + 2, 1 << 30))) for r in roots), filename)


def fit_width(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(F.rpad(text, width, " "))


def console_line(number: Column, total: Column) -> Column:
    """A result as the console shows it: place, icon, verdict by report bucket, score, and the file name cut at 50."""
    s = F.col("score")
    icon = F.when(s >= 80, "❌").when(s >= 50, "⚠️ ").when(s >= 30, "❓").otherwise("✅")
    verdict = F.when(s >= 80, "FAKE").when(s >= 50, "SUSPICIOUS").when(s >= 30, "WARNING").otherwise("AUTHENTIC")
    name = F.when(F.length("filename") > 50, F.concat(F.left("filename", F.lit(47)), F.lit("..."))).otherwise(F.col("filename"))
    return F.format_string("[%03d/%03d] %s %-12s %7s  %s", number, total, icon, verdict, F.concat(s.cast("string"), F.lit("/100")), name)


def console_icon(score: Column) -> Column:
    return F.when(score >= 80, "[FAKE]").when(score >= 50, "[SUSP]").when(score >= 30, "[?]").otherwise("[OK]")


def scan_info(results: DataFrame, scan_paths: list[str], version: str, now: str) -> DataFrame:
    """One row: what the JSON report says about the scan."""
    return results.agg(F.count_if(F.col("verdict") != "NON_FLAC").alias("total_flac_files"), F.count_if(F.col("verdict") == "NON_FLAC").alias("total_non_flac_files")).select(
        F.lit(now).alias("timestamp"), F.lit(version).alias("analyzer_version"), F.array(*map(F.lit, scan_paths)).cast("array<string>").alias("scan_paths"), "total_flac_files", "total_non_flac_files"
    )


def json_document(results: DataFrame, scan_paths: list[str], version: str, now: str) -> str:
    """The report as one JSON text with scan_info and results; for reports that fit the driver. Any size: sinks.write_json_report."""
    head = scan_info(results, scan_paths, version, now).select(F.to_json(F.struct("*")).alias("j")).first().j
    rows = ",".join(r.j for r in results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())
    return f'{{"scan_info":{head},"results":[{rows}]}}'


def paths_from_json(spark: SparkSession, path: str, condition: str, field: str = "results") -> DataFrame:
    """filepath of a JSON report's rows that a condition holds for: quarantine lists, playlists."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")
    return rows.where(condition).select("filepath")


LINES = "part int, worst int, path string, n int, line string"


def text_lines(results: DataFrame, scan_paths: list[str]) -> DataFrame:
    """The fixed-width report as rows of LINES, to be sorted by all but the line: statistics, suspicious, corrupted and upsampled files, and what to do.

    Only counts come to the driver.
    """
    spark = results.sparkSession
    st = statistics(results).first().asDict()
    rule = "-" * WIDTH
    named = results.withColumn("shown", display_path(F.col("filepath"), F.col("filename"), scan_paths))
    head = [rule, f" Files: {st['total']} | Authentic: {st['authentic']} ({st['authentic_pct']}) | Fake: {st['fake']} ({st['fake_pct']}) | Suspect: {st['suspect']} ({st['suspect_pct']})"]
    short = {"Duration": "duration_issues", "Clipping": "clipping_issues", "DC": "dc_offset_issues", "Silence": "silence_issues", "FakeHiRes": "fake_high_res", "Upsampled": "upsampled_files", "Corrupt": "corrupted_files", "Non-FLAC": "non_flac_files"}
    if some := [f"{k}: {st[v]}" for k, v in short.items() if st[v]]:
        head.append(" Issues: " + ", ".join(some))
    bad = st["suspect"] + st["fake"]
    heads = {
        0: [*head, rule], 1: [f" SUSPICIOUS FILES ({bad})", " " + rule[2:]] if bad else [" No suspicious files found."],
        3: [rule, f" CORRUPTED FILES ({st['corrupted_files']})" if st["corrupted_files"] else " No corrupted files found."],
        5: [rule, f" UPSAMPLED FILES ({st['upsampled_files']})" if st["upsampled_files"] else " No upsampled files found."],
        7: [rule, " Action: " + ", ".join(advice) if (advice := [text for text, k in ADVICE if st[k]]) else " Status: All Good"],
    }
    kbps, rate = F.coalesce("estimated_mp3_bitrate", F.lit(0)), F.coalesce("suspected_original_rate", F.lit(0))
    row = F.format_string(
        " %-4s | %-7s | %-15s | %-8s | %-8s | %s", score_icon(F.col("score")), F.concat(F.col("score").cast("string"), F.lit("/100")), "verdict",
        F.format_string("%.1fk", F.coalesce(F.col("cutoff_freq"), F.lit(0.0)) / 1000), F.when(kbps > 0, F.concat(kbps.cast("string"), F.lit("k"))).otherwise("-"), "shown",
    )
    was = F.when(rate > 0, F.concat(rate.cast("string"), F.lit(" Hz"))).otherwise("Unknown")

    def lines(rows: DataFrame, part: int, worst: Column, line: Column) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), worst.cast("int").alias("worst"), F.col("filepath").alias("path"), F.lit(0).alias("n"), line.alias("line"))

    out = spark.createDataFrame([(part, 0, "", n, x) for part, xs in heads.items() for n, x in enumerate(xs)], LINES)
    out = out.unionAll(lines(named.where("score >= 50"), 2, -F.col("score"), row))
    out = out.unionAll(lines(named.where("is_corrupted"), 4, F.lit(0), F.format_string(" [!!] | %s", "shown")))
    return out.unionAll(lines(named.where("is_upsampled"), 6, F.lit(0), F.format_string(" [?]  | %-15s | %s", was, "shown")))


def sorted_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy("part", "worst", "path", "n").select("line")


def text_report(results: DataFrame, scan_paths: list[str]) -> str:
    """The text report as one text; for reports that fit the driver. Any size: sinks.write_text_report."""
    return "\n".join(r.line for r in sorted_lines(text_lines(results, scan_paths)).toLocalIterator())


def lines_with(lines: DataFrame, *words: str) -> DataFrame:
    """The lines of a report that hold one of the words."""
    return lines.where(reduce(lambda a, b: a | b, (F.col("line").contains(w) for w in words)))


def issues_of(results: DataFrame, filepath: str) -> DataFrame:
    """The issues of one file, a row each."""
    return results.where(F.col("filepath") == filepath).select(F.explode("issues").alias("i")).select("i.*")


def files_with_issues(results: DataFrame) -> DataFrame:
    return results.where(F.coalesce(F.size("issues") > 0, F.lit(False))).select("filepath")


def diagnostic_lines(results: DataFrame) -> DataFrame:
    """Rows of LINES: counts of decoding issues, then every file that has some, by path. Only counts come to the driver."""
    spark = results.sparkSession
    d = diagnostics(results).first()
    share = d.files_with_issues / max(d.total_files, 1) * 100
    counts = [f"  Total files analyzed: {d.total_files}", f"  Files with issues: {d.files_with_issues} ({share:.1f}%)", f"  Clean files: {d.clean_files}", f"  Critical failures: {d.critical_failures}", ""]
    head = ["=" * 80, DIAGNOSTIC_HEAD, "=" * 80, "", "SUMMARY:", *counts]
    if types := issue_types(results).orderBy("issue_type").collect():
        head += ["ISSUE TYPES:", *(f"  {t.issue_type}: {t.n_issues}" for t in types), ""]
    out = spark.createDataFrame([(0, 0, "", n, x) for n, x in enumerate(head)] + [(2, 0, "", 0, ""), (2, 0, "", 1, "=" * 80)], LINES)
    pct = F.when(F.col("i.total_frames") > 0, F.col("i.frames_read") / F.col("i.total_frames") * 100).otherwise(0.0)
    none = F.array().cast("array<string>")
    each = results.where("size(issues) > 0").select("filepath", "filename", has_critical().alias("critical"), F.posexplode("issues").alias("k", "i"))
    texts = F.concat(
        F.when(F.col("k") == 0, F.array(F.lit(""), F.concat(F.when(F.col("critical"), "[CRITICAL] ").otherwise("[WARNING] "), "filename"), F.concat(F.lit("  Path: "), "filepath"))).otherwise(none),
        F.array(F.format_string("  Issue %d: %s", F.col("k") + 1, "i.issue_type"), F.concat(F.lit("    Time: "), F.coalesce("i.timestamp", F.lit(""))), F.concat(F.lit("    Message: "), F.coalesce("i.message", F.lit("")))),
        F.when(F.col("i.frames_read").isNotNull() & F.col("i.total_frames").isNotNull(), F.array(F.format_string("    Data read: %d/%d frames (%.1f%%)", "i.frames_read", "i.total_frames", pct))).otherwise(none),
        F.when(F.col("i.retry_count") > 0, F.array(F.format_string("    Retries: %d", "i.retry_count"))).otherwise(none),
    )
    rows = each.select("filepath", "k", F.posexplode(texts).alias("j", "line")).select(F.lit(1).alias("part"), F.lit(0).alias("worst"), F.col("filepath").alias("path"), (F.col("k") * 100 + F.col("j")).alias("n"), "line")
    return out.unionAll(rows)


def diagnostic_report(results: DataFrame) -> str:
    """As one text; for reports that fit the driver. Any size: sinks.write_lines of sorted_lines(diagnostic_lines())."""
    return "\n".join(r.line for r in sorted_lines(diagnostic_lines(results)).toLocalIterator())


def dated_name(prefix: str, when: Column, extension: str) -> Column:
    """The name of a report that is not given one."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(when, "yyyyMMdd_HHmmss"), F.lit(f".{extension}"))


def integrity_lists(tests: DataFrame) -> DataFrame:
    """error_type, paths (sorted) of decoder test outputs (path, stderr), a row a file, damaged ones only."""
    return tests.select("path", error_type().alias("error_type")).where("error_type is not null").orderBy("error_type", "path")


def integrity_summary(tests: DataFrame) -> DataFrame:
    """error_type, n_files of decoder test outputs (path, stderr); healthy files have a null type. The last token that occurs wins."""
    return tests.groupBy(error_type().alias("error_type")).agg(F.count("*").alias("n_files"))


def error_type() -> Column:
    err = F.upper("stderr")
    return F.when(F.col("stderr").isNull() | (F.col("stderr") == ""), F.lit(None)).when(err.contains("CRC") | err.contains("MISMATCH"), "CRC_MISMATCH").when(err.contains("HEADER"), "BAD_HEADER").when(err.contains("SYNC"), "LOST_SYNC").otherwise("UNKNOWN")
