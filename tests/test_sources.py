"""Readers on files made here, scans, and the whole analysis of a small folder."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolake import __main__ as job
from sonolake.operators import lookups, manifest, report
from sonolake.plans import analysis, repair
from sonolake.sources import files, flac, scan, sinks, wav
from sonolake.streaming import incremental

RATE = 44_100


def noise(seconds, edge=None, seed=1, channels=1):
    x = np.random.default_rng(seed).normal(0, 0.1, (int(seconds * RATE), channels))
    if edge:
        s = np.fft.rfft(x, axis=0)
        s[np.fft.rfftfreq(len(x), 1 / RATE) > edge] = 0
        x = np.fft.irfft(s, len(x), axis=0)
    return x


@pytest.mark.parametrize("depth, channels", [(16, 1), (16, 2), (24, 2)])
def test_round_trips(depth, channels):
    x = noise(0.3, channels=channels)
    step = 2.0 ** (1 - depth)
    y, rate, d, total = wav.read_wav(wav.write_wav(x, RATE, depth))
    assert (rate, d, total) == (RATE, depth, len(x)) and np.abs(y - x).max() <= step
    data = flac.write_flac(x, RATE, depth, {"TITLE": ["a", "b"]})
    y, head, error = flac.read_flac(data)
    assert error is None and head.tags == {"TITLE": ["a", "b"]} and (head.sample_rate, head.bit_depth, head.channels, head.total_frames) == (RATE, depth, channels, len(x))
    assert np.abs(y - x).max() <= step
    part, *_ = flac.read_flac(data, 5000, 1000)
    assert np.array_equal(part, y[5000:6000])


def bits(*fields):
    v, n = 0, 0
    for value, width in fields:
        v, n = v << width | value & ((1 << width) - 1), n + width
    return v << (-n % 8), n + (-n % 8)


def rice(v, k):
    u = v << 1 if v >= 0 else (-v << 1) - 1
    return [(1, (u >> k) + 1), (u, k)]


def test_predicted_subframes():
    """A fixed, a linear-prediction and a mid-side frame, coded by hand."""
    head = flac.write_flac(np.zeros((8, 2)), RATE)[: flac.read_header(flac.write_flac(np.zeros((8, 2)), RATE)).audio_at]
    left, right = [10, 12, 15, 14, 10, 3, -4, -9], [1, 1, 2, 3, 5, 8, 13, 21]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    fields = [(0x7FFC << 1, 16), (6, 4), (9, 4), (10, 4), (4, 3), (0, 1), (0, 8), (7, 8)]
    start, size = bits(*fields)
    fields += [(flac.crc(start.to_bytes(size // 8, "big"), 0x07, 8), 8)]
    fields += [(0, 1), (8 + 1, 6), (0, 1), (mid[0], 16), (0, 2), (0, 4), (2, 4)]  # first-order fixed
    for a, b in zip(mid, mid[1:]):
        fields += rice(b - a, 2)
    fields += [(0, 1), (32 + 1, 6), (0, 1), (side[0], 17), (side[1], 17), (4, 4), (1, 5), (4, 5), (-2, 5), (0, 2), (0, 4), (3, 4)]  # order 2: (4a - 2b) >> 1
    for i in range(2, 8):
        fields += rice(side[i] - ((4 * side[i - 1] - 2 * side[i - 2]) >> 1), 3)
    v, n = bits(*fields)
    y, _, error = flac.read_flac(head + v.to_bytes(n // 8, "big") + b"\0\0")
    assert error is None and (y * 32768).astype(int).T.tolist() == [left, right]


def test_damaged_streams():
    data = flac.write_flac(noise(0.5), RATE)
    y, head, error = flac.read_flac(data[: len(data) // 2])
    assert error and 0 < len(y) < head.total_frames
    with pytest.raises(flac.Broken):
        flac.read_header(b"RIFF")


def predicted(x, factors, shift, k):
    """One mono 16-bit subframe by linear prediction, as bit fields."""
    fields = [(0, 1), (32 + len(factors) - 1, 6), (0, 1), *((int(v), 16) for v in x[: len(factors)]), (11, 4), (shift, 5), *((f, 12) for f in factors), (0, 2), (0, 4), (k, 4)]
    for n in range(len(factors), len(x)):
        guess = sum(f * int(x[n - 1 - i]) for i, f in enumerate(factors)) >> shift
        fields += rice(int(x[n]) - guess, k)
    return fields


@pytest.mark.parametrize("order", [1, 2, 8, 32])
def test_linear_prediction_of_many_orders(order):
    """Frames of several lengths and orders decode together."""
    r = np.random.default_rng(order)
    empty = flac.write_flac(np.zeros((16, 1)), RATE)
    data, whole = empty[: flac.read_header(empty).audio_at], []
    for number, n in enumerate((64, 200, 64, 33)):
        x = (2000 * np.sin(np.arange(n) / 9) + r.normal(0, 30, n)).astype(int)
        factors = r.integers(-200, 200, order).tolist()
        start, size = bits((0x7FFC << 1, 16), (6, 4), (9, 4), (0, 4), (4, 3), (0, 1), (number, 8), (n - 1, 8))
        head = start.to_bytes(size // 8, "big")
        v, m = bits(*predicted(x, factors, 9, 9))
        data += head + bytes([flac.crc(head, 0x07, 8)]) + v.to_bytes(m // 8, "big") + b"\0\0"
        whole.append(x)
    y, _, error = flac.read_flac(data)
    assert error is None and np.array_equal((y[:, 0] * 32768).astype(int), np.concatenate(whole))


def test_slices_seek():
    x = noise(8, channels=2)
    data = flac.write_flac(x, RATE)
    y, head, _ = flac.read_flac(data)
    assert hashlib.md5(flac.pcm(np.rint(y * 32768).astype(np.int64), 16)).digest() == head.md5
    for start, count in ((0, 10), (4095, 2), (4096, 4096), (200_000, 44_100), (len(x) - 5, 100), (len(x) + 9, 5)):
        part, _, error = flac.read_flac(data, start, count)
        assert error is None and np.array_equal(part, y[start : start + count])
    assert flac.seek(data, head, 300_000) > len(data) // 2


def test_repair_leaves_out_damaged_frames():
    x = noise(3, channels=2)
    picture = {"type": 3, "mime": "image/png", "desc": "é", "width": 1, "height": 2, "depth": 24, "colors": 0, "data": b"png"}
    data = bytearray(flac.write_flac(x, RATE, tags={"TITLE": ["a", "b"]}, pictures=[picture]))
    data[len(data) // 2 : len(data) // 2 + 40] = bytes(40)
    assert flac.read_flac(bytes(data))[2]
    fixed, n = flac.repair(bytes(data))
    y, head, error = flac.read_flac(fixed)
    assert error is None and len(y) == n == head.total_frames and 0 < len(x) - n <= 3 * 4096
    assert head.tags == {"TITLE": ["a", "b"]} and head.pictures == [picture]
    assert flac.repair(bytes(data[: flac.read_header(bytes(data)).audio_at])) is None


def test_reading_again():
    """Temporary failures of the storage are tried again, later each time; damage that stays is not."""
    waits, calls = [], []

    def read(outcomes):
        def one(path):
            calls.append(path)
            out = outcomes[min(len(calls), len(outcomes)) - 1]
            if isinstance(out, Exception):
                raise out
            return out

        return one

    decode = lambda data: (data, None if data == b"good" else "lost sync" if data.startswith(b"cut") else "not a stream")
    run = lambda *outcomes: (calls.clear(), waits.clear(), files.with_retries("p", decode, read=read(outcomes), wait=waits.append))[2]
    assert run(b"good") == ((b"good", None), 0)
    assert run(OSError("gone"), b"cut1", b"cut2", b"good") == ((b"good", None), 3) and waits == [0.2, 0.4, 0.8]
    assert run(b"cut1", b"cut1", b"good") == ((b"cut1", "lost sync"), 1)
    assert run(b"bad", b"good") == ((b"bad", "not a stream"), 0)
    assert run(b"cut1", b"cut2", b"cut3", b"cut4", b"cut5", b"good")[1] == 4
    with pytest.raises(OSError):
        run(OSError("gone"))


def test_paths(spark):
    assert scan.split_paths('"a b";c') == ["a b", "c"] and scan.split_paths("a, 'b'") == ["a", "b"]
    names = ["song1.flac", "song3.mp3", "song4.txt", "b.m4a", "artist/album/track01.FLAC", "x.ape"]
    got = {r.path: r.kind for r in scan.classify(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {"song1.flac": "flac", "song3.mp3": "other_audio", "b.m4a": "other_audio", "artist/album/track01.FLAC": "flac", "x.ape": "other_audio"}


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    d = tmp_path_factory.mktemp("library")
    (d / "a").mkdir()
    (d / "a/full.flac").write_bytes(flac.write_flac(noise(4, channels=2), RATE))
    (d / "a/cut.wav").write_bytes(wav.write_wav(noise(12, 16_000), RATE))
    deep = np.rint(noise(2, seed=3) * 32768) / 32768
    (d / "deep.wav").write_bytes(wav.write_wav(deep, RATE, 24))
    (d / "broken.flac").write_bytes(b"not a stream")
    (d / "half.flac").write_bytes(flac.write_flac(noise(2), RATE)[:60_000])
    whole = flac.write_flac(noise(1), RATE, tags={"TITLE": ["x" * 50]})
    at = whole.index(b"TITLE")
    (d / "cut tag.flac").write_bytes(whole[:5] + whole[5:at - 4] + (10**6).to_bytes(4, "little") + whole[at:])
    (d / "garbage.wav").write_bytes(b"RIFF\0\0\0\0junk")
    (d / "empty.flac").write_bytes(flac.MARK)
    (d / "frameless.flac").write_bytes(whole[: flac.read_header(whole).audio_at] + b"\x11" * 500)
    (d / "lossy.mp3").write_bytes(b"x")
    (d / "notes.txt").write_text("x")
    return d


def test_analysis_of_a_folder(spark, library):
    rows = {r.filename: r for r in analysis.analyze(spark, [str(library)]).collect()}
    dead = {"broken.flac", "cut tag.flac", "garbage.wav", "empty.flac", "frameless.flac"}
    assert set(rows) == {"full.flac", "cut.wav", "deep.wav", "half.flac", "lossy.mp3", *dead}
    assert {n for n, r in rows.items() if r.verdict == "ERROR"} == dead and all(rows[n].reason.startswith("Error: ") for n in dead)
    assert "R2: Cutoff" in rows["cut.wav"].reason and rows["full.flac"].reason
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "4"
    assert rows["full.flac"].verdict == "AUTHENTIC" and rows["full.flac"].cutoff_freq > 19_000
    assert abs(rows["cut.wav"].cutoff_freq - 16_000) <= 500 and rows["cut.wav"].score > rows["full.flac"].score
    assert rows["deep.wav"].is_fake_high_res and rows["deep.wav"].estimated_bit_depth == 16
    assert rows["broken.flac"].verdict == "ERROR" and rows["broken.flac"].issues[0].issue_type == "read_failed"
    assert rows["half.flac"].partial_analysis and not rows["half.flac"].is_corrupted and rows["half.flac"].issues[0].retry_count == 1
    assert rows["lossy.mp3"].verdict == "NON_FLAC" and rows["lossy.mp3"].score == 100


def test_reports(spark, library, tmp_path):
    rows = analysis.analyze(spark, [str(library), str(library / "not there")]).cache()
    text = report.text_report(rows, [f"file:{library}"])
    assert "NON_FLAC" in text and "lossy.mp3" in text and "CORRUPTED FILES (5)" in text
    sinks.write_text_report(rows, [f"file:{library}"], str(tmp_path / "lines"))
    assert "\n".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*"))).replace("\n\n", "\n").strip() == text.strip()
    document = json.loads(report.json_document(rows, ["a"], "1", "now"))
    assert document["scan_info"]["total_non_flac_files"] == 1 and len(document["results"]) == rows.count()
    (tmp_path / "report.json").write_text(json.dumps(document))
    assert [r.filepath for r in report.paths_from_json(spark, str(tmp_path / "report.json"), "score >= 61").collect()] == [f"file:{library}/lossy.mp3"]
    sinks.write_json_report(rows, ["a"], "1", "now", str(tmp_path / "json_report"))
    assert spark.read.json(str(tmp_path / "json_report/results")).count() == rows.count()
    diagnostics = report.diagnostic_report(rows)
    assert "Files with issues: 6" in diagnostics and diagnostics.count("[CRITICAL]") == 5 and "Retries: 1" in diagnostics
    assert report.issues_of(rows, f"file:{library}/half.flac").count() == 1
    empty = report.statistics(rows.limit(0)).first()
    assert empty.total == 0 and empty.fake_pct == "0%"
    for kind in ("json", "csv", "parquet"):
        sinks.write_rows(rows, str(tmp_path / kind), kind)
    sinks.write_text_file(spark, text, str(tmp_path / "report.txt"))
    assert (tmp_path / "report.txt").read_text() == text
    assert report.pending(rows.select("filepath"), rows.limit(2)).count() == 8


def test_model_is_loaded_once_a_task(spark, library):
    """A model that is certain turns an open file suspicious; without one rule 12 is silent."""
    def model():
        return lambda mel: 0.99 if mel.shape == (128, 862) and mel.min() == -1 and mel.max() == 1 else 0.0

    found = analysis.analyze(spark, [str(library / "a")], model=model)
    rows = {r.filename: r for r in found.collect()}
    assert "R12: CNN classifier flags transcode (p=0.99, confidence=very high, +30pts)" in rows["cut.wav"].reason


def test_segments_are_decoded_alone(spark, library):
    plan = spark.createDataFrame([(f"file:{library}/a/cut.wav", 0, 2.0, 5.0), (f"file:{library}/broken.flac", 0, 0.0, 1.0)], "path string, length long, start double, seconds double")
    rows = {r.path[-7:]: r for r in analysis.segment_rows(plan).collect()}
    assert abs(rows["cut.wav"].cutoff - 16_000) <= 500 and rows["en.flac"].cutoff is None


def test_blocks_of_samples(spark, library):
    files = spark.createDataFrame([(f"file:{library}/{n}",) for n in ("a/full.flac", "deep.wav", "broken.flac", "half.flac")], "path string")
    rows = analysis.sample_blocks(files).collect()
    for name, want in (("a/full.flac", flac.read_flac((library / "a/full.flac").read_bytes())[0]), ("deep.wav", wav.read_wav((library / "deep.wav").read_bytes())[0]), ("half.flac", flac.read_flac((library / "half.flac").read_bytes())[0])):
        mine = sorted((r.start, r) for r in rows if r.path.endswith(name))
        assert all(len(r.samples) == 16_384 * r.channels for _, r in mine[:-1]) and [s for s, _ in mine] == list(range(0, len(want), 16_384))
        assert np.array_equal(np.concatenate([r.samples for _, r in mine]), want.ravel())
    assert not any(r.path.endswith("broken.flac") for r in rows)


def test_repairs_are_rows(spark, library, tmp_path):
    files = scan.scan_files(spark, [str(library)]).where("kind = 'flac'").select("path", "length")
    checked = {r.path.rsplit("/", 1)[1]: r for r in repair.check(files).collect()}
    assert checked["half.flac"].has_mismatch and not checked["full.flac"].has_mismatch and checked["empty.flac"].error
    assert repair.repaired(files, dry_run=True).where("content is not null").count() == 0
    made = repair.repaired(files).cache()
    got = {r.path.rsplit("/", 1)[1]: r for r in made.collect()}
    assert got["full.flac"].skipped and got["half.flac"].success and not got["broken.flac"].success
    assert lookups.repair_summary(made).first().asDict() == {"total": 6, "fixed": 1, "skipped": 1, "errors": 4}
    out = made.where("content is not null").select(F.concat(F.lit("new/"), F.element_at(F.split("path", "/"), -1)).alias("name"), "content")
    assert [r.name for r in sinks.write_bytes(out, f"file://{tmp_path}").collect()] == ["new/half.flac"]
    y, head, error = flac.read_flac((tmp_path / "new/half.flac").read_bytes())
    assert error is None and len(y) == head.total_frames > 0
    sound = scan.scan_files(spark, [str(library)], r"\.wav$").select("path", "length")
    coded = {r.path.rsplit("/", 1)[1]: r for r in repair.reencoded(sound).collect()}
    assert coded["deep.wav"].success and not coded["garbage.wav"].success
    z = flac.read_flac(bytes(coded["deep.wav"].content))
    assert z[1].bit_depth == 24 and np.array_equal(z[0], wav.read_wav((library / "deep.wav").read_bytes())[0])
    plan = files.where("path like '%full.flac'").withColumns({"start": F.lit(1.0), "seconds": F.lit(2.0)})
    assert repair.trimmed(plan).first().samples == 2 * RATE


def test_job(spark, library, tmp_path, capsys):
    assert job.main([str(library / "nowhere")], spark) == 1
    with pytest.raises(SystemExit):
        job.arguments([str(library), "--sample-duration", "3"])
    out = str(tmp_path / "r.json")
    assert job.main([f'"{library / "a"}";{library / "deep.wav"}', "--format", "json", "--output", out], spark) == 0
    assert len(json.loads((tmp_path / "r.json").read_text())["results"]) == 3 and "3 files" in capsys.readouterr().out
    assert job.main([str(library), "-v", "--parts", "--output", str(tmp_path / "parts")], spark) == 0
    assert list((tmp_path / "parts").glob("part-*")) and list(tmp_path.glob("diagnostic_*.txt"))


def test_progress_and_features(spark, tmp_path):
    assert sinks.read_progress(spark, str(tmp_path / "none.json")).first().processed_files == []
    (tmp_path / "p.json").write_text('{"processed_files": ["a"], "results": [], "total_files": 3, "current_index": 1, "start_time": "x", "last_update": "y"}')
    assert sinks.read_progress(spark, str(tmp_path / "p.json")).first().total_files == 3
    sinks.write_features(spark.createDataFrame([("a", [0.5], 1), ("b", [0.1], 0)], "path string, x array<double>, y int"), str(tmp_path / "f"))
    assert sinks.read_features(spark, str(tmp_path / "f")).where("y = 1").first().path == "a"


def test_new_files_come_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.flac").write_bytes(b"x")

    def run():
        stream = incremental.new_files(spark, str(source))
        incremental.run_available(stream, lambda b: b.select("path", "kind"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 1
    (source / "two.mp3").write_bytes(b"x")
    assert run() == 2
    assert run() == 2


def test_manifest_steps(spark, tmp_path):
    logs = spark.createDataFrame([("/m/a/x.log", " 5 -=- 05 - Track Name.flac -=- CDDA (100%)\n 6 -=- 06.flac -=- MPEG (95%)\n")], "log_path string, text string")
    files = spark.createDataFrame([("/m/a/05 - Track Name.flac",), ("/m/a/06.flac",), ("/m/a/cd1/07.flac",), ("/m/b/08.flac",)], "path string")
    found = manifest.tracks(logs)
    assert found.count() == 2
    assert [r.path for r in manifest.authenticated(found, files).collect()] == ["/m/a/05 - Track Name.flac"]
    assert manifest.subtree(logs.select("log_path"), files).count() == 3
    both = logs.withColumn("ripper", F.lit("Audiochecker")).unionAll(logs.withColumn("ripper", F.lit("EAC"))).unionAll(logs.withColumn("ripper", F.lit(None).cast("string")))
    entries = manifest.collect(both, files, "/m")
    assert sorted((r.path, r.source, r.top_label) for r in entries.collect()) == [("/m/a/05 - Track Name.flac", "audiochecker_cdda100", "a/x.log"), *((p, "eac", "a/x.log") for p in ("/m/a/05 - Track Name.flac", "/m/a/06.flac", "/m/a/cd1/07.flac"))]
    assert [f["path"] for f in json.loads(sinks.manifest_document(entries, "/m", 2))["files"]] == sorted(r.path for r in entries.collect())
    sinks.write_manifest(entries, "/m", 2, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/files")).count() == 4 and json.loads((tmp_path / "m/head.json").read_text())["source_breakdown"] == {"audiochecker_cdda100": 1, "eac": 3}
    heads = spark.createDataFrame([(bytearray("Exact Audio Copy é".encode("utf-16")),), (bytearray(b"X Lossless Decoder"),), (bytearray(b"other"),)], "content binary")
    assert [r.r for r in heads.select(manifest.ripper(manifest.log_head(F.col("content"))).alias("r")).collect()] == ["EAC", "XLD", None]
    m = manifest.metrics(spark.sql("select 1 y, 1 p from range(7730) union all select 0, 1 from range(178) union all select 1, 0 from range(1166) union all select 0, 0 from range(712)"), "y", "p").first()
    assert [round(m[c], 4) for c in ("accuracy", "precision", "recall", "specificity", "balanced_accuracy", "f1")] == [0.8627, 0.9775, 0.8689, 0.8, 0.8345, 0.92]


def test_every_row_of_a_mixup_has_a_partner(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("samples"))
    out = manifest.mixup(rows, "k", manifest.beta_weight(0.2, "k", F.lit(1)), F.pmod(F.xxhash64("k"), F.lit(10_000)), 10_000, per_range=100).collect()
    assert len(out) == 3000 and all(r.k != r.partner for r in out) and len({r.partner for r in out}) == 3000
    one = manifest.mixup(rows.limit(1), "k", F.lit(0.5), F.lit(0), 1).collect()
    assert one[0].partner == one[0].k


def test_beta_weights_and_masks(spark):
    w = [r.w for r in spark.range(4000).select(manifest.beta_weight(0.2, "id").alias("w")).collect()]
    assert abs(np.mean(w) - 0.5) < 0.03 and abs(np.var(w) - 1 / (4 * 1.4)) < 0.02 and 0 <= min(w) and max(w) <= 1
    masks = manifest.random_masks(128, 20, 2, "id")
    got = spark.range(500).select(*(c.alias(f"c{i}{j}") for i, m in enumerate(masks) for j, c in enumerate(m))).collect()
    assert all(0 <= r.c00 and r.c00 + r.c01 <= 128 and r.c01 <= 20 for r in got) and max(r.c01 for r in got) == 20 and min(r.c11 for r in got) == 0


def test_split_of_one_class(spark):
    rows = spark.range(1000).select(F.col("id"), F.lit(1).alias("y"))
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    got = {r.split: r.n for r in manifest.stratified_split(rows, "y", order, "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"test": 150, "val": 150, "train": 700}
