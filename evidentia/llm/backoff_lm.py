"""LM scoring: stupid-backoff scores, computed relationally over the corpus's own n-gram counts.

Words are the maximal runs of other than ASCII white space. Of the word at a place, with what precedes it in its document:

    S(w | c) = count(c w) / count(c)        if count(c w) >= min_count, c the last order - 1 words,
             = alpha S(w | c less its first word)   otherwise;   S(w) = count(w) / N.

A document's score is the sum of ln S over its words (shorter contexts at its start).

The count tables are partitioned by ranges of the n-grams' 64-bit hashes, one bucket a task, the number of buckets in
proportion to the corpus. Documents are exploded to n-grams in chunks of about `chunk_bytes` of text. A chunk's distinct
n-grams (sorted, as differences) and their counts go to their buckets, where all chunks' counts are added, and the totals
come back to the chunk: two equi-joins, on bucket and on chunk, that move an n-gram once for each chunk that has it, rather
than once for each place. So an n-gram that every document has costs a row a chunk, not a row a document; a bucket holds its
even share of hashes whatever the words' frequencies, and a chunk its bounded text. The scores of a chunk's places are then
summed for each document.

Documents are read twice and must give the same rows in the same partitions both times, as a table of files does; any
other input is written as one first. A chunk that finds other totals than it asked for raises an error.

N-grams travel side by side in a row a chunk and bucket that has any, not in a row each: the README gives the figures of
rows each, which are several times the disk that the check tool allows.

Edge cases: null and empty texts have no words and score 0; a text longer than a chunk is a chunk by itself; null ids come
back null; rows that repeat are scored and counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table

ALPHA, MIN_COUNT, ORDER = 0.4, 2, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as their lowest bytes, then the next: the high planes are nearly empty and compress away."""
    x = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T
    used = 8
    while used and not x[used - 1].any():
        used -= 1
    return struct.pack("<IB", x.shape[1], used) + np.ascontiguousarray(x[:used]).tobytes()


def from_planes(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, used = struct.unpack_from("<IB", data, at)
    at += 5
    out = np.zeros((8, n), np.uint8)
    out[:used] = np.frombuffer(data, np.uint8, used * n, at).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8").reshape(n), at + used * n


class Chunk:
    """Word codes of a run of documents, and the hashes of their n-grams."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray):
        self.codes, self.lengths, self.vocabulary = codes, lengths, vocabulary

    @classmethod
    def of(cls, raw: list[bytes]) -> Chunk:
        from xxhash import xxh64_intdigest

        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        codes, lengths = [], []
        for r in raw:
            words = r.split()
            lengths.append(len(words))
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        vocabulary = np.array([xxh64_intdigest(w, 5) for w in number], np.uint64)
        return cls(np.concatenate(codes), np.array(lengths, np.int64), vocabulary)

    def hashes(self, order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For n = 1 to order, the hash of the n-gram that ends at each place (of places that have one), and each place's
        number of words before it in its document."""
        word = self.vocabulary[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.arange(len(word)) - np.repeat(starts, self.lengths)
        out, last = [word], word
        for n in range(2, order + 1):
            now = np.zeros_like(word)
            now[1:] = _mix(last[:-1] * _ODD + word[1:] + np.uint64(n))
            out.append(now)
            last = now
        return out, before

    def distinct(self, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1 to order: distinct hashes ascending, counts, and which of them each place's n-gram is."""
        hashes, before = self.hashes(order)
        out = []
        for n, h in enumerate(hashes, 1):
            u, inverse, counts = np.unique(h[before >= n - 1], return_inverse=True, return_counts=True)
            place = np.full(len(h), -1, np.int64)
            place[before >= n - 1] = inverse
            out.append((u, counts, place))
        return out

    def pack(self) -> bytes:
        body = planes(self.codes) + planes(self.lengths) + planes(self.vocabulary)
        return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def unpack(cls, data: bytes) -> Chunk:
        body = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
        codes, at = from_planes(body)
        lengths, at = from_planes(body, at)
        vocabulary, _ = from_planes(body, at)
        return cls(codes.astype(np.int64), lengths.astype(np.int64), vocabulary)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list, Chunk]]:
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(slices(batches, "text", chunk_bytes)):
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        yield part << 32 | k, batch.column(0).to_pylist(), Chunk.of(raw)


def _bucket(u: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each hash: its upper bits."""
    return (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)


def requests(docs: DataFrame, bits: int, order: int, chunk_bytes: int) -> DataFrame:
    """(bucket, chunk, body): a chunk's distinct n-grams of a bucket with their counts, orders one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, c in _chunks(batches, chunk_bytes):
            parts = [(u, counts, _bucket(u, bits)) for u, counts, _ in c.distinct(order)]
            # only buckets that the chunk has an n-gram of: rows are never more than n-grams, however many buckets
            held = np.unique(np.concatenate([bucket for _, _, bucket in parts]))
            ends = [(np.searchsorted(bucket, held).tolist(), np.searchsorted(bucket, held, side="right").tolist()) for _, _, bucket in parts]
            bodies = []
            for k in range(len(held)):
                body = b""
                for (u, counts, _), (start, stop) in zip(parts, ends):
                    own = slice(start[k], stop[k])
                    body += planes(np.diff(u[own], prepend=np.uint64(0))) + planes(counts[own])
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([chunk] * len(held), pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "chunk", "body"])

    return docs.mapInArrow(run, "bucket long, chunk long, body binary")


def totals(asked: DataFrame, order: int) -> DataFrame:
    """(bucket, chunk, body): for each request, the corpus's count of each of its n-grams, in the request's order."""

    def add(group: pa.Table) -> pa.Table:
        bodies = group["body"].to_pylist()
        replies = [b""] * len(bodies)
        at = [0] * len(bodies)
        for _ in range(order):
            hashes, counts = [], []
            for i, body in enumerate(bodies):
                steps, at[i] = from_planes(body, at[i])
                n, at[i] = from_planes(body, at[i])
                hashes.append(np.cumsum(steps, dtype=np.uint64))
                counts.append(n)
            sizes = np.cumsum([len(h) for h in hashes])[:-1]
            _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.zeros(int(inverse.max()) + 1 if len(inverse) else 0, np.uint64)
            np.add.at(total, inverse, np.concatenate(counts))
            for i, own in enumerate(np.split(inverse, sizes)):
                replies[i] += planes(total[own])
        return pa.table([group["bucket"], group["chunk"], pa.array(replies, pa.binary())], names=["bucket", "chunk", "body"])

    return asked.groupBy("bucket").applyInArrow(add, "bucket long, chunk long, body binary")


def score_chunk(c: Chunk, found: list[np.ndarray], order: int, alpha: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the sum of ln S without the ln N of unigrams, and the number of places that have that ln N.
    found: for n = 1 to order, the counts of the distinct n-grams."""
    parts = c.distinct(order)
    if any(len(u) != len(f) for (u, _, _), f in zip(parts, found)):
        raise ValueError("the documents were not read as before: a chunk's n-grams have changed")
    at = []
    for (_, _, place), f in zip(parts, found):
        counts = np.append(f.astype(np.float64), 0.0)
        at.append(counts[place])  # -1, for no n-gram, finds the 0
    _, before = c.hashes(1)
    n_places = len(before)
    value, base, open_, factor = np.zeros(n_places), np.zeros(n_places), np.ones(n_places, bool), np.zeros(n_places)
    for n in range(order, 1, -1):
        has = open_ & (before >= n - 1)
        hit = has & (at[n - 1] >= min_count)
        context = np.concatenate([[0.0], at[n - 2][:-1]]) if n_places else at[n - 2]
        value[hit] = factor[hit] + np.log(at[n - 1][hit]) - np.log(context[hit])
        open_ &= ~hit
        factor[has & ~hit] += np.log(alpha)
    value[open_] = factor[open_] + np.log(at[0][open_])
    base[open_] = 1
    doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
    return np.bincount(doc, value, len(c.lengths)), np.bincount(doc, base, len(c.lengths)).astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, chunk_bytes: int = 8 << 20, bucket_words: int = 2_000_000, stored: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, log_score, mean_score (0 without words). stored: docs is a table of files as
    it is, which gives the same partitions whenever it is read; any other input is written as one first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not stored:
        docs = materialise(docs, "lm-docs")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 6 / bucket_words)))))
    counted = totals(requests(docs, bits, order, chunk_bytes), order).withColumnRenamed("chunk", "of")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, c in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([c.pack()], pa.binary())], ["chunk", "ids", "body"])

    packed = docs.mapInArrow(pack, "chunk long, ids array<bigint>, body binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("part", pa.float64()), ("n_base", pa.int64())])
        if left.num_rows != 1:
            raise ValueError("the documents were not read as before: chunks have changed")
        c = Chunk.unpack(left["body"][0].as_py())
        found: list[list[np.ndarray]] = [[] for _ in range(order)]
        for i in np.argsort(np.asarray(right["bucket"])).tolist():
            body, at = right["body"][i].as_py(), 0
            for k in range(order):
                counts, at = from_planes(body, at)
                found[k].append(counts)
        value, base = score_chunk(c, [np.concatenate([np.zeros(0, np.uint64), *f]) for f in found], order, alpha, min_count)
        return pa.table([pa.array(left["ids"][0].as_py(), pa.int64()), pa.array(c.lengths), pa.array(value), pa.array(base)], schema=schema)

    parts = packed.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(finish, "doc_id long, n_words long, part double, n_base long")
    parts = materialise(parts, "lm")
    n = parts.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.col("part") - F.col("n_base") * F.log(F.lit(float(n)))
    return parts.select("doc_id", "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).otherwise(F.lit(0.0)).alias("mean_score"))


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"), stored=True)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS c FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
c2 AS (SELECT c, w, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c, w),
s AS (SELECT p.r, CASE WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n) - ln(pc.n)
  ELSE (CASE WHEN p.c IS NULL THEN 0 ELSE ln({ALPHA}) END) + ln(c1.n) - ln((SELECT count(*) FROM t)) END AS v
  FROM p JOIN c1 USING (w) LEFT JOIN c2 ON p.c = c2.c AND p.w = c2.w LEFT JOIN c1 pc ON p.c = pc.w),
g AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0), 4)::DOUBLE AS log_score, round(CASE WHEN len(w) > 0 THEN v / len(w) ELSE 0 END, 6)::DOUBLE AS mean_score
FROM d LEFT JOIN g USING (r)
"""
