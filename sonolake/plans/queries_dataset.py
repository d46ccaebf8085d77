"""Training-set and text operators on documents, pages, labels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import lookups, manifest
from .adaptors import FRAMES_SQL, frames, table
from .registry import query

ENTRIES_SQL = """e AS (SELECT doc_id, '/lib/' || source || '/' || lang || '/' || (doc_id // 3) AS path, source AS label, (['EAC', 'XLD', 'CUERipper', 'Audiochecker'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS ripper, doc_id % 4 AS rank FROM documents)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    ripper = F.element_at(F.array(*map(F.lit, ["EAC", "XLD", "CUERipper", "Audiochecker"])), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.floor(k / 3).cast("string")).alias("path"), F.col("source").alias("label"), ripper.alias("source"), k.alias("seq"))


@query(f"WITH {ENTRIES_SQL} SELECT path, ripper AS source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, doc_id) AS n FROM e) WHERE n = 1")
def dedup_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.best_evidence(entries(spark, sf_dir)).select("path", "source", "doc_id")


@query(f"WITH {ENTRIES_SQL} SELECT ripper AS source, count(*) AS n FROM e GROUP BY ripper")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {ENTRIES_SQL} SELECT label, count(*) AS n FROM e GROUP BY label ORDER BY n DESC, label LIMIT 20")
def label_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.top_labels(entries(spark, sf_dir), "label")


@query(f"WITH {ENTRIES_SQL} SELECT label, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (doc_id * 7919) % 104729, doc_id) AS n FROM e) WHERE n <= 12")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.cap(entries(spark, sf_dir), "label", 12, (F.col("doc_id") * 7919) % 104729, "doc_id").select("label", "doc_id")


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, array_to_string(list_slice(string_split(substr(path, 6), '/'), 1, 2), '/') AS label FROM e")
def top_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("doc_id", manifest.top_label(F.col("path"), "/lib").alias("label"))


_HEADS = ["Exact Audio Copy V1.3", "X Lossless Decoder version 2", "CUERipper v2", "AUDIOCHECKER XLD", "Exact Audio Copy, AUDIOCHECKER", "", "EAC extraction logfile from", "XLD extraction logfile from"]


@query(f"""WITH l AS (SELECT doc_id, ([{", ".join(f"'{h}'" for h in _HEADS)}])[CAST(doc_id % 8 + 1 AS INTEGER)] || text AS head FROM documents)
SELECT doc_id, CASE WHEN contains(head, 'Exact Audio Copy') OR contains(head, 'EAC extraction logfile') THEN 'EAC' WHEN contains(head, 'X Lossless Decoder') OR contains(head, 'XLD extraction logfile') THEN 'XLD'
  WHEN contains(head, 'CUERipper') THEN 'CUERipper' WHEN contains(head, 'AUDIOCHECKER') THEN 'Audiochecker' END AS ripper FROM l""")
def evidence_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", manifest.ripper(F.concat(mark, "text")).alias("ripper"))


#: A log for each document: tracks with and without blanks around the marks, after other words, and of other kinds.
LOGS_SQL = """logs AS (SELECT doc_id, 'AUDIOCHECKER' || chr(10) || ' 1 -=- 0' || (doc_id % 9) || ' - Track.flac -=- ' || CASE WHEN doc_id % 2 = 0 THEN 'CDDA (100%)' ELSE 'MPEG (95%)  ' END || chr(10)
 || CASE WHEN doc_id % 5 = 0 THEN '2-=-b' || doc_id || '.FLAC-=-CDDA (100%)' || chr(10) ELSE 'no track' || chr(10) END || CASE WHEN doc_id % 7 = 0 THEN 'Track 3 -=- c.mp3 -=- CDDA (100%)' || chr(13) || chr(10) || 'Track 4 -=- c.flac -=- CDDA (99%)' ELSE '' END AS text FROM documents)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(
        F.lit("AUDIOCHECKER\n 1 -=- 0"), (k % 9).cast("string"), F.lit(" - Track.flac -=- "), F.when(k % 2 == 0, "CDDA (100%)").otherwise("MPEG (95%)  "), F.lit("\n"),
        F.when(k % 5 == 0, F.format_string("2-=-b%d.FLAC-=-CDDA (100%%)\n", k)).otherwise("no track\n"), F.when(k % 7 == 0, "Track 3 -=- c.mp3 -=- CDDA (100%)\r\nTrack 4 -=- c.flac -=- CDDA (99%)").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_TRACK_SQL = r"'\d+\s*-=-\s*([^\r\n]+\.(?:flac|FLAC))\s*-=-\s*([^\r\n]+)'"


@query(f"WITH {LOGS_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, {_TRACK_SQL}, 1)) AS file, unnest(regexp_extract_all(text, {_TRACK_SQL}, 2)) AS status FROM logs) SELECT doc_id, file, trim(status) AS status FROM t")
def track_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tracks(logs(spark, sf_dir))


@query(f"""WITH {LOGS_SQL}, d AS (SELECT l.doc_id, '/lib/' || source || '/' || lang || '/' AS folder, l.text, CASE WHEN l.doc_id % 3 = 0 THEN 'Audiochecker' WHEN l.doc_id % 3 = 1 THEN 'EAC' END AS ripper FROM logs l JOIN documents USING (doc_id)),
files AS (SELECT DISTINCT folder || '0' || (doc_id % 9) || ' - Track.flac' AS path FROM d UNION SELECT DISTINCT folder || 'cd1/' || (doc_id % 4) || '.flac' FROM d),
t AS (SELECT folder, ripper, unnest(regexp_extract_all(text, {_TRACK_SQL}, 1)) AS file, unnest(regexp_extract_all(text, {_TRACK_SQL}, 2)) AS status FROM d WHERE ripper = 'Audiochecker'),
e AS (SELECT folder || file AS path, 'audiochecker_cdda100' AS source, ripper FROM t WHERE contains(status, 'CDDA (100%)') AND folder || file IN (SELECT path FROM files)
  UNION ALL SELECT path, 'eac', ripper FROM d JOIN files ON starts_with(path, folder) WHERE ripper = 'EAC')
SELECT path, source, ripper, array_to_string(list_slice(string_split(substr(path, 6), '/'), 1, 2), '/') AS top_label, count(*) AS n FROM e GROUP BY ALL""")
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that a log vouches for, as often as one does: logs of checked tracks and logs that vouch for a folder."""
    k = F.col("doc_id")
    folder = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/")).alias("folder"))
    met = logs(spark, sf_dir).join(folder, "doc_id").select(k, "folder", "text", F.concat("folder", k.cast("string"), F.lit(".log")).alias("log_path"), F.when(k % 3 == 0, "Audiochecker").when(k % 3 == 1, "EAC").alias("ripper"))
    files = met.select(F.explode(F.array(F.concat("folder", F.format_string("0%d - Track.flac", k % 9)), F.concat("folder", F.format_string("cd1/%d.flac", k % 4)))).alias("path")).distinct()
    found = manifest.collect(met.select("log_path", "text", "ripper"), files, "/lib")
    return found.groupBy("path", "source", "ripper", "top_label").agg(F.count("*").alias("n"))


@query("SELECT y, split, count(*) AS n FROM (SELECT y, CASE WHEN pos <= k THEN 'test' WHEN pos <= 2 * k THEN 'val' ELSE 'train' END AS split FROM (SELECT quality AS y, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 104729, doc_id) AS pos, round_even(0.15::DOUBLE * count(*) OVER (PARTITION BY quality), 0) AS k FROM labels)) GROUP BY ALL")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return manifest.stratified_split(rows, "y", (F.col("doc_id") * 7919) % 104729, "doc_id").groupBy("y", "split").agg(F.count("*").alias("n"))


@query("SELECT quality AS y, round(1.0::DOUBLE / count(*), 9) AS weight FROM labels GROUP BY quality")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("y")), "y").select("y", F.round("weight", 9).alias("weight"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels),
m AS (SELECT *, (tp + tn) / greatest(tp + fp + fn + tn, 1)::DOUBLE AS a, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r, tn / greatest(tn + fp, 1)::DOUBLE AS s FROM c)
SELECT tp, fp, fn, tn, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity, round(2 * p * r / greatest(p + r, 1e-9::DOUBLE), 6) AS f1, round((r + s) / 2, 6) AS balanced_accuracy FROM m""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest.metrics(table(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy")))


@query("SELECT quality AS y, round(avg(-0.25::DOUBLE * pow(1 - p, 2) * ln(p)), 6) AS loss FROM (SELECT quality, (doc_id % 97 + 1) / 100.0::DOUBLE AS p FROM labels) GROUP BY quality")
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("doc_id") % 97 + 1) / 100
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("y")).agg(F.round(manifest.focal_loss(p), 6).alias("loss"))


@query("""WITH c AS (SELECT * FROM (VALUES ('mp3_128', 'mp3', ''), ('mp3_192', 'mp3', ''), ('mp3_256', 'mp3', ''), ('mp3_320', 'mp3', ''), ('mp3_v0', 'mp3', '-q:a 0'), ('mp3_v2', 'mp3', '-q:a 2'), ('aac_192', 'm4a', ''), ('aac_256', 'm4a', ''), ('opus_128', 'opus', ''), ('vorbis_q5', 'ogg', '-q:a 5')) t(label, extension, arguments)) SELECT doc_id, label, extension, arguments FROM documents, c""")
def codec_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.codec_jobs(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "label", "extension", "arguments")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/data/authentic/' || doc_id || '.flac' ELSE '/data/transcoded/' || (CASE WHEN doc_id % 3 = 1 THEN 'mp3_128' ELSE 'opus_128' END) || '/' || doc_id || '.flac' END AS path FROM documents)
SELECT doc_id, CASE WHEN contains(path, '/transcoded/') THEN string_split(path, '/')[4] END AS codec, CASE WHEN contains(path, '/transcoded/') THEN 1 ELSE 0 END AS y FROM p""")
def transcode_label_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.when(k % 3 == 0, F.format_string("/data/authentic/%d.flac", k)).otherwise(F.format_string("/data/transcoded/%s/%d.flac", F.when(k % 3 == 1, "mp3_128").otherwise("opus_128"), k))
    codec, y = manifest.transcode_label(path)
    return table(spark, sf_dir, "documents").select("doc_id", codec.alias("codec"), y.alias("y"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(string_split(string_split(url, '?')[1], '#')[1], '([^/]*)$', 1) AS filename, lower(regexp_extract(regexp_extract(string_split(string_split(url, '?')[1], '#')[1], '([^/]*)$', 1), '\\.([^.]+)$', 1)) AS ext FROM pages")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"))


@query("""WITH m AS (SELECT doc_id, (['FLAC decoder LOST SYNC', 'decoder error occurred', 'sync error detected', 'invalid frame header', 'unexpected end of file', 'unknown error', 'file not found', 'permission denied'])[CAST(doc_id % 8 + 1 AS INTEGER)] AS message FROM documents)
SELECT doc_id, regexp_matches(lower(message), 'lost sync|decoder error|sync error|invalid frame|unexpected end|unknown error') AS temporary FROM m""")
def temporary_error_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["FLAC decoder LOST SYNC", "decoder error occurred", "sync error detected", "invalid frame header", "unexpected end of file", "unknown error", "file not found", "permission denied"]
    message = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", R.temporary_error(message).alias("temporary"))


@query(f"WITH {FRAMES_SQL} SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: CASE WHEN i >= vec_id % 40 AND i < vec_id % 40 + 15 THEN -1 ELSE samples[CAST(i + 1 AS INTEGER)] END)), 6) AS total FROM e")
def band_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = manifest.mask_bands(F.col("samples"), F.col("vec_id") % 40, F.lit(15))
    return frames(spark, sf_dir).select("vec_id", F.round(F.aggregate(masked, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"""WITH {FRAMES_SQL}, o AS (SELECT *, (vec_id * 7919) % 104729 AS ord FROM e), r AS (SELECT *, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS partner FROM o WINDOW w AS (ORDER BY ord, vec_id))
SELECT r.vec_id, partner, round(list_sum(list_transform(range(64), lambda i: (0.7::DOUBLE * r.samples[CAST(i + 1 AS INTEGER)] + 0.3::DOUBLE * p.samples[CAST(i + 1 AS INTEGER)]) * (i + 1))), 5) AS total FROM r JOIN e p ON p.vec_id = partner""")
def mixup_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring in ranges of 100 rows is the ring over all rows."""
    mixed = manifest.mixup(frames(spark, sf_dir), "vec_id", F.lit(0.7), (F.col("vec_id") * 7919) % 104729, 104729, per_range=100)
    total = F.aggregate(F.transform("mixed", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return mixed.select("vec_id", "partner", F.round(total, 5).alias("total"))


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT vec_id, i // 8 AS b, i % 8 AS t, samples[CAST(i + 1 AS INTEGER)] AS v FROM e, (SELECT unnest(range(64)) AS i))
SELECT vec_id, round(sum(CASE WHEN b = vec_id % 8 OR (b >= 2 AND b < 2 + vec_id % 3) OR (t >= vec_id % 5 AND t < vec_id % 5 + 2) OR t = 7 THEN -1 ELSE v END * (b * 8 + t + 1)), 5) AS total FROM c GROUP BY vec_id""")
def spec_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks on each axis of an 8 by 8 grid."""
    k = F.col("vec_id")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.slice("samples", b * 8 + 1, F.lit(8)))
    masked = manifest.spec_augment(grid, [(k % 8, F.lit(1)), (F.lit(2), k % 3)], [(k % 5, F.lit(2)), (F.lit(7), F.lit(1))])
    flat = F.transform(F.flatten(masked), lambda v, i: v * (i + 1))
    return frames(spark, sf_dir).select("vec_id", F.round(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("""WITH p AS (SELECT page_id, 'C:\\Music\\' || (page_id % 5) || '\\' || page_id || '.flac' AS path, CASE WHEN page_id % 2 = 0 THEN 'D:\\Sets\\' || page_id ELSE 'e:/' END AS folder FROM pages)
SELECT page_id, (page_id % 5) || '/' || page_id || '.flac' AS relative, CASE WHEN page_id % 2 = 0 THEN '/d/Sets/' || page_id || '/' ELSE '/e/' END AS shell, '/out/mp3_128/' || (page_id % 5) || '/' || page_id || '.flac' AS target FROM p""")
def path_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("C:\\Music\\"), (k % 5).cast("string"), F.lit("\\"), k.cast("string"), F.lit(".flac"))
    folder = F.when(k % 2 == 0, F.concat(F.lit("D:\\Sets\\"), k.cast("string"))).otherwise("e:/")
    root = "c:/music"
    return table(spark, sf_dir, "pages").select(k, lookups.relative_path(path, root).alias("relative"), lookups.shell_path(folder).alias("shell"), lookups.target_path(path, root, "/out", F.lit("mp3_128")).alias("target"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
