import base64
import gzip
import hashlib

import pytest
from oracle import assert_same

from evidentia.llm import arc_to_warc as a
from evidentia.llm.common import new_path

SCHEMA = "page_id long, url string, html string, key int, payload string"


def test_query_against_duckdb(spark, sf):
    assert_same(a.op1_arc_to_warc(spark, sf), a.OP1_SQL, sf)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_arc_round_trip(version, zipped):
    rows = [("http://x/", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nhi"), ("dns:y", "0.0.0.0", "20200102", "text/dns", b""), ("http://z", "::1", "20200102030405", "a/b", b"\n\nfiledesc://x 1 2 3 4\n")]
    content = a.arc_file("f", rows, version)
    content = gzip.compress(content[:100]) + gzip.compress(content[100:]) if zipped else content
    got = [(f["url"], f["ip"], f["date"], f["mime"], body) for f, body, _ in a.arc_records(content)]
    assert got == rows


def test_urls_with_spaces_and_bad_files():
    content = a.arc_file("f", [("http://x/a b", "i", "20200101000000", "m", b"123456789")], 1)
    assert next(a.arc_records(content))[0]["url"] == "http://x/a%20b"
    with pytest.raises(ValueError, match="fewer are left"):
        list(a.arc_records(content[:-3]))
    with pytest.raises(ValueError, match="not known"):
        list(a.arc_records(content.replace(b"\n1 0 ", b"\n9 0 ")))


def digest(x: str) -> str:
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_revisits_and_edges(spark):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "u", nasty), (2, "u v", nasty), (3, None, None), (4, "a", ""), (None, "a", ""), (None, "b", "q"), (None, "b", "q"), (7, "b", "é" * 9000), (7, "b", "é" * 9000), (8, "b", "é" * 9000)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA)
    got = a.read_warc(spark, a.archive_pages(df, new_path(spark, "w"))).collect()
    found = sorted((r.key or -1, r.record_type, r.refers_to or 0, r.payload_digest, r.payload_bytes) for r in got)
    expected = [(1, "revisit", 2, nasty), (2, "response", 0, nasty), (3, "revisit", 4, ""), (4, "response", 0, ""), (-1, "revisit", 4, ""), (-1, "response", 0, "q"), (-1, "response", 0, "q"), (7, "revisit", 8, "é" * 9000), (7, "revisit", 8, "é" * 9000), (8, "response", 0, "é" * 9000)]
    assert found == sorted((k, t, to, digest(h), len(h.encode())) for k, t, to, h in expected)
    assert len({r.record_id for r in got}) >= 8


def test_short_payloads_may_be_left_alone(spark):
    df = spark.createDataFrame([(1, "u", "ab", 0, ""), (2, "u", "ab", 0, ""), (3, "u", "abc", 0, ""), (4, "u", "abc", 0, "")], SCHEMA)
    got = a.read_warc(spark, a.archive_pages(df, new_path(spark, "w"), min_revisit_bytes=3)).collect()
    assert {(r.key, r.record_type) for r in got} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert a.read_warc(spark, a.archive_pages(df, new_path(spark, "w"))).count() == 0


def test_files_are_what_readers_expect(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 3}</p>" * 50, 0, "") for k in range(9)]
    path = a.write_warc(*_typed(spark, rows), chunk_bytes=300, chunks_per_file=2)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) > 1
    records = []
    for content in files:
        inside = list(a.members(content))
        assert gzip.decompress(content) == b"".join(inside)  # nothing but members
        for one in inside:
            (found,) = a.warc_records(one)  # a member a record
            records.append(found)
    for f, block in records:
        assert f["WARC-Block-Digest"] == f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"
    assert [f for f, _ in records if f["WARC-Type"] == "warcinfo"]
    byid = {f["WARC-Record-ID"]: f for f, _ in records if f["WARC-Type"] == "response"}
    revisits = [f for f, _ in records if f["WARC-Type"] == "revisit"]
    assert len(byid) == 3 and len(revisits) == 6
    for f in revisits:
        to = byid[f["WARC-Refers-To"]]
        assert (to["WARC-Target-URI"], to["WARC-Date"], to["WARC-Payload-Digest"]) == (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"], f["WARC-Payload-Digest"])


def _typed(spark, rows):
    arcs = a.pages_to_arc(spark.createDataFrame(rows, SCHEMA))
    keys = a.convert(arcs, payloads=False).select("key", "payload_digest", "payload_bytes", "record_id", "uri", "date")
    return a.with_types(a.convert(arcs), a.decide(keys)), new_path(spark, "w")


def test_any_packing_is_read(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhi"
    record = a._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:x>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", "u"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", f"sha1:{digest('hi')}"), ("WARC-Payload-Length", 2)], block)
    for name, content in {"plain": record * 3, "one": gzip.compress(record * 3), "many": gzip.compress(record) * 3}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.warc").write_bytes(content)
        got = a.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert [(r.payload_digest, r.record_type) for r in got] == [(digest("hi"), "response")] * 3
