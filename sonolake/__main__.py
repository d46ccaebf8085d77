"""The job: `spark-submit -m sonolake PATH... [--output PATH] [--format text|json]`, or `python -m sonolake` on one machine."""

from __future__ import annotations

import argparse
import datetime
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from . import __version__ as VERSION
from . import runtime
from .functions.constants import FORMATS, SAMPLE_RANGE, SAMPLE_SECONDS
from .operators import report
from .plans import analysis
from .sources import scan, sinks

log = logging.getLogger("sonolake")


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sonolake", description="Tells lossless audio files that were made from lossy ones.")
    p.add_argument("paths", nargs="+", help="files or folders; several in one argument are parted by ; or ,")
    p.add_argument("-V", "--version", action="version", version=f"sonolake {VERSION}")
    p.add_argument("-v", "--verbose", action="store_true", help="log each result")
    p.add_argument("--sample-duration", type=float, default=SAMPLE_SECONDS, metavar="SECS", help="seconds of a spectrum's sample, %g to %g" % SAMPLE_RANGE)
    p.add_argument("--output", help="where the report goes; without it, a dated name in the first scanned folder")
    p.add_argument("--format", choices=FORMATS, default=FORMATS[0])
    p.add_argument("--parts", action="store_true", help="write the report as a folder of files, of any size")
    out = p.parse_args(argv)
    if not SAMPLE_RANGE[0] <= out.sample_duration <= SAMPLE_RANGE[1]:
        p.error(f"--sample-duration must be between {SAMPLE_RANGE[0]:g} and {SAMPLE_RANGE[1]:g} seconds (got {out.sample_duration:g})")
    return out


def write_report(spark: SparkSession, rows: DataFrame, paths: list[str], args: argparse.Namespace, now: datetime.datetime) -> str:
    extension = "json" if args.format == "json" else "txt"
    target = args.output or f"{paths[0].rstrip('/')}/report_{now:%Y%m%d_%H%M%S}.{extension}"
    if args.parts:
        if args.format == "json":
            sinks.write_json_report(rows, paths, VERSION, now.isoformat(), target)
        else:
            sinks.write_text_report(rows, paths, target)
    else:
        text = report.json_document(rows, paths, VERSION, now.isoformat()) if args.format == "json" else report.text_report(rows, paths)
        sinks.write_text_file(spark, text, target)
    if report.files_with_issues(rows).limit(1).count():
        sinks.write_text_file(spark, report.diagnostic_report(rows), f"{target.rsplit('/', 1)[0]}/diagnostic_{now:%Y%m%d_%H%M%S}.txt")
    return target


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if a path does not exist: nothing is scanned then."""
    args = arguments(sys.argv[1:] if argv is None else argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("sonolake").getOrCreate()
    try:
        paths, missing = scan.existing(spark, [p for raw in args.paths for p in scan.split_paths(raw)])
        if missing:
            print("Invalid paths: " + ", ".join(missing), file=sys.stderr)
            return 1
        with runtime.temporaries(spark):
            rows = runtime.materialise(analysis.analyze(spark, paths, args.sample_duration), "results")
            if args.verbose:
                total = rows.count()
                for n, r in enumerate(rows.select("filename", "score", "verdict", "reason").toLocalIterator(), 1):
                    log.info("%d/%d %s %s/100 %s: %s", n, total, r.verdict, r.score, r.filename, r.reason)
            target = write_report(spark, rows, paths, args, datetime.datetime.now())
            s = report.console_summary(rows).first()
            print(f"{rows.count()} files, {s.suspicious} suspicious, {s.fake_certain} certainly fake; report: {target}")
        return 0
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    sys.exit(main())
