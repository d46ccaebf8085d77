"""WARC archives: write them, turn whole-file gzip streams into one member a record, read them by offset.

An archive compressed as one gzip stream can only be read from its start. The normaliser inflates such a
stream once, piece by piece, cuts it into records, writes each as its own gzip member, and beside the
archive a sidecar with the offset and length of every member. A reader then takes any record alone.

Tasks write below a name of their own and rename it when complete, so a repeated task leaves no halves.
Paths are URIs of a folder that all executors reach (pyarrow.fs: file, hdfs, s3, gs).

Defined results: a null html is an empty payload and takes part in deduplication like any other; rows with
the smallest page_id of their payload are responses, so repeated rows of that id all are; a null page_id
counts as larger than any other, and is a response only if its payload has no other id. Empty files (zero bytes or zeros only
after the last member) have no records; a truncated archive raises ValueError. URLs keep no control
characters. An empty table gives no archives and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import qualified, remove_folder
from .common import SALTS, materialise, ready, repeated, salt, scratch_path

CHUNK = 1 << 20
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Compressed bytes that a task reads back.
SPLIT = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, record_type string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit without payload if refers_to is given. Its HTTP header holds the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, read once and piece by piece.

    Zeros between and after members are padding. Other bytes there, and a file that ends inside a member, raise ValueError.
    """
    z, first = None, True
    while raw := source.read(chunk):
        while raw:
            if z is None:
                raw = raw if first else raw.lstrip(b"\0")
                if not raw:
                    break
                z, first = zlib.decompressobj(31), False
            try:
                yield z.decompress(raw, chunk)
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from e
            raw, z = (z.unused_data, None) if z.eof else (z.unconsumed_tail, z)
    if z is not None:
        yield z.flush()
        if not z.eof:
            raise ValueError("an archive ends inside a gzip member")


def cut_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record in a stream of record bytes. Holds one record at a time."""
    held = bytearray()

    def more() -> bool:
        for p in parts:
            if p:
                held.extend(p)
                return True
        return False

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("an archive ends inside a record's header")
        fields = header_fields(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("an archive ends inside a record's block")
        yield fields, bytes(held[:size])
        del held[:size]


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_monolithic(pages: DataFrame, out_dir: str, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes whole-file gzip streams of about archive_bytes, one at least a partition that has rows; returns the archives written (archive, n_records).

    pages: page_id, url, html; payloads that occur more than once are written once, as a response. Payloads are dealt by
    digest and salt, so that a payload that many pages share does not meet in one task.
    """
    ready(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    named = own.select("page_id", "digest")
    cells = materialise(repeated(named, ["digest"], ["page_id"], least="page_id").select("digest", salt(SALTS, "page_id").alias("salt"), "least").distinct(), "warc-first")
    met = own.withColumn("salt", salt(SALTS, "page_id")).join(cells.withColumn("twice", F.lit(True)).hint("merge"), ["digest", "salt"], "left")
    rows = met.select("page_id", "url", "payload", "digest", F.when(F.col("twice"), F.col("least")).otherwise(F.col("page_id")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = place(out_dir)
        files.create_dir(folder, recursive=True)
        part, number, names, counts, out = TaskContext.get().partitionId(), 0, [], [], None

        def close() -> None:
            out.write(z.flush())
            out.close()
            files.move(temp, f"{folder}/{names[-1]}")

        for b in batches:
            for page_id, url, body, digest, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    names.append(f"part-{part:06d}-{number:05d}.warc.gz")
                    temp = f"{folder}/{names[-1]}.{uuid.uuid4().hex}.tmp"
                    z, out, size, number = zlib.compressobj(6, zlib.DEFLATED, 31), files.open_output_stream(temp, compression=None), 0, number + 1
                    counts.append(0)
                piece = z.compress(build_record(page_id, url, body, digest, None if page_id == least else least, date))
                out.write(piece)
                size += len(piece)
                counts[-1] += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "n_records"])

    return materialise(rows.mapInArrow(run, "archive string, n_records long"), "warc-written")


def normalise(archives: DataFrame, in_dir: str, out_dir: str) -> DataFrame:
    """Rewrites each archive (column archive, a name in in_dir) with one gzip member a record, and writes its
    sidecar `<archive>.index.json`, a JSON line of INDEX's fields for each member. Returns archive, n_records.

    There are as many tasks as archives: names are dealt by ranges, and a number of partitions that is asked for is never reduced.
    """
    ready(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                (source, src), (files, folder) = place(in_dir), place(out_dir)
                files.create_dir(folder, recursive=True)
                mark, at, count = uuid.uuid4().hex, 0, 0
                temp, side = f"{folder}/{name}.{mark}.tmp", f"{folder}/{name}.{mark}.index.tmp"
                with source.open_input_stream(f"{src}/{name}", compression=None) as f, files.open_output_stream(temp, compression=None) as out, files.open_output_stream(side, compression=None) as index:
                    for fields, raw in cut_records(inflate(f)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        page = fields.get("x-page-id")
                        index.write(json.dumps({"archive": name, "offset": at, "length": len(member), "page_id": None if page is None else int(page), "record_type": fields["warc-type"]}).encode() + b"\n")
                        at += len(member)
                        count += 1
                files.move(temp, f"{folder}/{name}")
                files.move(side, f"{folder}/{name}.index.json")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["archive", "n_records"])

    names = archives.select("archive").distinct()
    dealt = names.repartitionByRange(max(1, names.count()), "archive")
    return materialise(dealt.mapInArrow(run, "archive string, n_records long"), "warc-normalised")


def read_index(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(INDEX).json(f"{out_dir}/*.index.json")


def read_records(index: DataFrame, out_dir: str, payloads: bool = False) -> DataFrame:
    """Reads each indexed member alone and checks the digest of what it holds. payloads adds the column payload (null for revisits).

    Tasks get ranges of archive and offset, about SPLIT bytes each.
    """
    ready(index.sparkSession)
    schema = READ + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = place(out_dir)
        opened, f = None, None
        for b in batches:
            rows = []
            for name, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != opened:
                    if f:
                        f.close()
                    opened, f = name, files.open_input_file(f"{folder}/{name}")
                f.seek(offset)
                fields, raw = next(cut_records(iter([zlib.decompress(f.read(length), 31)])))
                block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
                head, _, body = block.partition(b"\r\n\r\n")
                digest, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"{name}: the payload at {offset} does not match its digest")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                row = (page and int(page), int(header_fields(head)["content-length"]), digest, kind, refers and int(refers), fields.get("warc-target-uri"), name, offset, length)
                rows.append((*row, body if kind == "response" else None) if payloads else row)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
        if f:
            f.close()

    wanted = index.select("archive", "offset", "length")
    size = wanted.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct("archive").alias("n")).first()
    parts = max(size.bytes // SPLIT + 1, min(size.n, wanted.sparkSession.sparkContext.defaultParallelism))
    return wanted.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, out_dir: str | None = None, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes pages as monolithic archives, normalises them, and reads the result back through the index."""
    spark = pages.sparkSession
    base = qualified(spark, out_dir) if out_dir else scratch_path(spark, "warc")
    written = write_monolithic(pages, f"{base}/monolithic", date)
    done = normalise(written, f"{base}/monolithic", f"{base}/members")
    if done.isEmpty():
        return spark.createDataFrame([], READ)
    remove_folder(spark, f"{base}/monolithic")
    return read_records(read_index(spark, f"{base}/members"), f"{base}/members")
