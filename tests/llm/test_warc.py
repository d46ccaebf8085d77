"""Archives against direct grouping, record by record, and the gzip forms."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from sonolake.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)] + [(60, None, None), (61, "http://x\r\nInjected: 1", ""), (62, "u", "é" * 70_000), (3, "http://h/3", "<p>3</p>" * 50), (None, "n", "<p>0</p>" * 50)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' payload", "1 digest", "2 first").repartition(4)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, pages, tmp_path):
    got = warc.archive_pages(pages, f"file://{tmp_path}").collect()
    first = {}
    for r in pages.collect():
        if r.page_id is not None:
            first[digest(r.html)] = min(first.get(digest(r.html), r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        least = first[digest(r.html)]
        want.append((r.page_id, len((r.html or "").encode()), digest(r.html), "response" if r.page_id == least else "revisit", None if r.page_id == least else least))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    archives = list((tmp_path / "members").glob("*.warc.gz"))
    assert archives and not list((tmp_path / "members").glob("*.tmp"))
    for r in got:
        raw = (tmp_path / "members" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        record = gzip.decompress(raw)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Type: {r.record_type}".encode() in record and b"\r\nInjected" not in record
    read = warc.read_records(warc.read_index(spark, f"file://{tmp_path}/members"), f"file://{tmp_path}/members", payloads=True).collect()
    assert all((r.payload is None) == (r.record_type == "revisit") for r in read)


def test_streams_are_cut_anywhere():
    records = [warc.build_record(i, f"u{i}", bytes([i]) * (i * 37), hashlib.sha1(bytes([i]) * (i * 37)).hexdigest(), None, "2020-01-01T00:00:00Z") for i in range(20)]
    whole, members = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for data in (whole, members):
        for chunk in (1, 13, 1 << 20):
            assert [raw for _, raw in warc.cut_records(warc.inflate(io.BytesIO(data), chunk))] == records
    with pytest.raises(ValueError):
        list(warc.cut_records(iter([records[0][:-10]])))


def test_large_members_padding_and_truncation():
    """Members longer than the production chunk, each of which inflates to several; zeros as padding; every kind of broken end."""
    bodies = [random.Random(i).randbytes(1_500_000) + b"<p>html</p>" * 300_000 for i in range(4)]
    members = [gzip.compress(b, 1) for b in bodies]
    assert b"".join(warc.inflate(io.BytesIO(b"".join(members)))) == b"".join(bodies)
    assert b"".join(warc.inflate(io.BytesIO(members[0] + b"\0" * 70 + members[1] + b"\0" * 3_000_000), 1 << 16)) == bodies[0] + bodies[1]
    for broken in (members[0][:-1], members[0] + members[1][:5], members[0] + b"junk", b"junk"):
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO(broken)))
    assert not b"".join(warc.inflate(io.BytesIO(b"")))


def test_archives_roll_and_tasks_spread(spark, pages, tmp_path):
    written = warc.write_monolithic(pages.repartition(2), f"file://{tmp_path}/in", archive_bytes=1)
    n = written.count()
    assert n > 4 and sum(r.n_records for r in written.collect()) == pages.count()
    done = warc.normalise(written, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert {r.archive: r.n_records for r in done.collect()} == {r.archive: r.n_records for r in written.collect()}
    assert warc.read_records(warc.read_index(spark, f"file://{tmp_path}/out"), f"file://{tmp_path}/out").count() == pages.count()


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
