"""WARC: legacy archive converter. ARC files (versions 1 and 2) in, WARC files out, and a reader of both.

ARC: a file begins with a version block whose second line names the version and whose third the record line's fields:

    filedesc://NAME 0.0.0.0 20200101000000 text/plain LENGTH          (version 1)
    1 0 evidentia
    URL IP-address Archive-date Content-type Archive-length
    filedesc://NAME 0.0.0.0 20200101000000 text/plain 200 - - 0 NAME LENGTH   (version 2)
    2 0 evidentia
    URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

Each record is its line, exactly the declared number of bytes, and one newline. The body is an HTTP response.

The converter turns each record into a WARC one: WARC-Record-ID a version-5 UUID of file, offset and digest (the same on
every run), WARC-Date from the 14 digits, WARC-Type response or revisit, Content-Type application/http, payload digest the
base32 SHA-1 of the HTTP body and block digest that of the block written. Of the records with equal payloads of at least
min_revisit_bytes, that with the largest key is the response and the others revisit it (profile identical-payload-digest,
with the response's record id, target and date). Version blocks become warcinfo records.

WARC files have a gzip member a record, as readers of .warc.gz expect. They are written with Spark's committed text writer,
hence safe against lost executors and on any file system that Spark writes to. That writer ends each row with a separator,
so a row (records of about `chunk_bytes` of content) ends with a member that is always the same, a warcinfo record, and the
separator is that member's last 8 bytes: its text is chosen so that these are ASCII. A file holds a bounded number of rows;
a longer record is a row by itself. The reader takes any .warc or .warc.gz, one member or many.

Edge cases: a null html is an empty payload; a null url becomes "urn:none", white space in urls is percent-encoded; a
null key ranks below every number (a group of null keys only: all are responses); rows that repeat a key and payload are
each written, all with the type that their key has; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices, table

#: The record line's fields by version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = "X-Archive-Key"
RECORD_SCHEMA = "key long, uri string, ip string, date string, mime string, record_id string, http_header string, payload_bytes long, payload_digest string, payload binary"
_SPACE = re.compile(r"\s")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(name: str, rows: list[tuple[str, str, str, str, bytes]], version: int) -> bytes:
    """An ARC file of (url, ip, 14-digit date, mime, body) rows."""
    out = bytearray()

    def add(url: str, ip: str, date: str, mime: str, body: bytes) -> None:
        checksum = hashlib.md5(body).hexdigest()
        line = f"{url} {ip} {date} {mime} " + (f"200 {checksum} - {len(out)} {name} " if version == 2 else "") + f"{len(body)}\n"
        out.extend(line.encode())
        out.extend(body)
        out.extend(b"\n")

    add(f"filedesc://{name}", "0.0.0.0", "20200101000000", "text/plain", f"{version} 0 evidentia\n{TITLES[version]}\n".encode())
    for row in rows:
        add(*row)
    return bytes(out)


def members(content: bytes) -> Iterator[bytes]:
    """What each gzip member holds; content that is not gzip, as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("gzip member without end")
            parts.append(one.decompress(view[at : at + (1 << 16)]))
            at += 1 << 16
        at = min(at, len(view)) - len(one.unused_data)
        yield b"".join(parts)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Fields, body and offset of each record after the version block. The version rules how lines are read; the
    declared length rules where a body ends, whatever the body holds. Gzip members are undone first."""
    content = b"".join(members(content))
    at, version = 0, 0
    while at < len(content):
        stop = content.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC record line without end at byte {at}")
        words = content[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not version:
            length = int(words[-1])
            version = int(content[stop + 1 : stop + 1 + length].split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        else:
            names = FIELDS[version]
            extra = len(words) - len(names)
            if extra < 0:
                raise ValueError(f"ARC record line at byte {at} has {len(words)} of {len(names)} fields")
            fields = dict(zip(names, ["%20".join(words[: extra + 1]), *words[extra + 1 :]]))
            length = int(fields["length"])
            if stop + 1 + length > len(content):
                raise ValueError(f"ARC record at byte {at} declares {length} bytes; fewer are left")
            yield fields, content[stop + 1 : stop + 1 + length], at
        at = stop + 1 + length
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = 4 << 20) -> DataFrame:
    """ARC files (name, content) of a table of pages: versions 1 and 2 in turn, about file_bytes each."""
    narrow = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(slices(batches, "html", file_bytes)):
            rows = []
            for k, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                payload = (h or "").encode("utf-8", "surrogatepass")
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if k is None else f"{KEY_HEADER}: {k}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
                date = "20200101" + f"{(k or 0) % 86400 // 3600:02d}{(k or 0) % 3600 // 60:02d}{(k or 0) % 60:02d}"
                rows.append((_SPACE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u) if u else "urn:none", "0.0.0.0", date, "text/html", head.encode() + payload))
            name = f"pages-{part:05d}-{n:05d}.arc"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(name, rows, 1 + n % 2)], pa.binary())], ["name", "content"])

    return narrow.mapInArrow(build, "name string, content binary")


def convert(arcs: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ARC files (name, content: as read with Spark's binaryFile source, path as name), with synthesised WARC
    identifiers, timestamps and digests; types follow in with_types(). payloads=False leaves the payloads out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                cols: list[list] = [[] for _ in range(10)]
                for fields, body, offset in arc_records(content.as_buffer().to_pybytes()):
                    head, sep, payload = body.partition(b"\r\n\r\n")
                    if not sep or not head.startswith(b"HTTP/"):  # not HTTP: all of it is payload
                        head, payload = b"", body
                    http = head.decode("utf-8", "replace")
                    found = re.search(rf"^{KEY_HEADER}: (-?\d+)\r?$", http, re.M)
                    digest = base32_sha1(payload)
                    d = fields["date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}#{digest}')}>"
                    for c, v in zip(cols, (int(found[1]) if found else None, fields["url"], fields["ip"], date, fields["mime"], rid, http, len(payload), digest, payload if payloads else None)):
                        c.append(v)
                types = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "uri", "ip", "date", "mime", "record_id", "http_header", "payload_bytes", "payload_digest", "payload"])

    return arcs.select("name", "content").mapInArrow(parse, RECORD_SCHEMA)


def decide(keys: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """key, payload_digest -> refers_to and the response's refers_id, refers_uri, refers_date, null for responses. Without
    payloads; one digest may hold a third of the rows: the groups are reduced before the shuffle and joined by a join that
    Spark splits where it is skewed."""
    distinct = keys.groupBy("payload_digest", "key").agg(F.max("payload_bytes").alias("payload_bytes"), F.min(F.struct("record_id", "uri", "date")).alias("own"))
    top = distinct.groupBy("payload_digest").agg(F.max(F.struct("key", "own")).alias("top"))
    both = distinct.join(top, "payload_digest")
    revisits = (F.col("payload_bytes") >= min_revisit_bytes) & F.col("top.key").isNotNull() & ~F.col("key").eqNullSafe(F.col("top.key"))
    to = {"refers_to": "top.key", "refers_id": "top.own.record_id", "refers_uri": "top.own.uri", "refers_date": "top.own.date"}
    return both.select("key", "payload_digest", *[F.when(revisits, F.col(v)).alias(k) for k, v in to.items()])


def with_types(records: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.withColumnsRenamed({"key": "d_key", "payload_digest": "d_digest"})
    same = (F.coalesce(records.key, F.lit(-1 << 62)) == F.coalesce(d.d_key, F.lit(-1 << 62))) & (records.payload_digest == d.d_digest)
    return records.join(d, same, "left").drop("d_key", "d_digest").withColumn("record_type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")))


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}WARC-Block-Digest: sha1:{base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_bytes(r: dict) -> bytes:
    """A WARC record of a row of with_types(). The block of a revisit is the HTTP header alone."""
    revisit = r["record_type"] == "revisit"
    head = (r["http_header"] + "\r\n\r\n").encode() if r["http_header"] else b""
    fields = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]),
        ("Content-Type", "application/http; msgtype=response" if head else r["mime"]), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Payload-Length", r["payload_bytes"]), ("WARC-Source-Key", r["key"]),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", r["refers_id"]),
            ("WARC-Refers-To-Target-URI", r["refers_uri"]), ("WARC-Refers-To-Date", r["refers_date"]), ("WARC-Refers-To-Key", r["refers_to"]),
        ]
    return _record(fields, head if revisit else head + (r["payload"] or b""))


def gzip_member(data: bytes) -> bytes:
    """One member without time or name: the same bytes on every run."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@cache
def closing_member() -> bytes:
    """The member that ends each row: what the version blocks of the archives said, and a number by which the member's
    last 8 bytes, checksum and length, come out as ASCII."""
    for n in count():
        block = f"software: evidentia\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC versions 1 and 2\r\nvariant: {n}\r\n".encode()
        rid = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo#{n}")
        out = gzip_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], block))
        if all(0 < b < 128 and b not in b"\r\n" for b in out[-8:-4]) and max(out[-4:]) < 128:
            return out


def write_warc(typed: DataFrame, path: str, chunk_bytes: int = 4 << 20, chunks_per_file: int = 4) -> str:
    columns = ["record_type", "record_id", "date", "uri", "ip", "mime", "http_header", "payload_digest", "payload_bytes", "key", "refers_to", "refers_id", "refers_uri", "refers_date", "payload"]
    whole = closing_member()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", chunk_bytes):
            packed = b"".join(gzip_member(warc_bytes(r)) for r in batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([packed + whole[:-8]], pa.binary())], ["value"])

    raw = typed.select(*columns).mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", whole[-8:].decode("ascii")).option("maxRecordsPerFile", chunks_per_file).text(path)
    return path


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of uncompressed WARC content, by the declared lengths."""
    at = 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in content[at:stop].decode("utf-8", "replace").split("\r\n")[1:])
        length = int(fields["Content-Length"])
        if stop + 4 + length > len(content):
            raise ValueError(f"WARC record at byte {at} declares {length} bytes; fewer are left")
        yield fields, content[stop + 4 : stop + 4 + length]
        at = stop + 8 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: key, record_type, payload_bytes, payload_digest (checked against the payload of a response),
    refers_to (key), uri, date, record_id."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                cols: list[list] = [[] for _ in range(8)]
                for f, block in (x for one in members(cell.as_buffer().to_pybytes()) for x in warc_records(one)):
                    if "WARC-Block-Digest" in f and f["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"{f['WARC-Record-ID']}: block and digest differ")
                    if f["WARC-Type"] not in ("response", "revisit"):
                        continue
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["WARC-Payload-Length"])
                    if f["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if f["Content-Type"].startswith("application/http") else block
                        if base32_sha1(payload) != digest or len(payload) != size:
                            raise ValueError(f"{f['WARC-Record-ID']}: payload and digest differ")
                    key, to = f.get("WARC-Source-Key"), f.get("WARC-Refers-To-Key")
                    for c, v in zip(cols, (int(key) if key else None, size, digest, f["WARC-Type"], int(to) if to else None, f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Record-ID"])):
                        c.append(v)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date", "record_id"])

    return files.mapInArrow(parse, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, date string, record_id string")


def archive_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> str:
    """pages -> ARC -> WARC files under path."""
    arcs = pages_to_arc(pages)
    narrow = convert(arcs, payloads=False).select("key", "payload_digest", "payload_bytes", "record_id", "uri", "date")
    decisions = decide(narrow, min_revisit_bytes)
    return write_warc(with_types(convert(arcs), decisions), path)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A SHA-1 is eight groups of five hex digits, hence of four base-32 digits.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM h),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""
