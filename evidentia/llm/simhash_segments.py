"""SimHash near-dedup by segment-popcount embedding.

Fingerprint: A-Z in lower case, words [^\\x20\\x09-\\x0D]+, shingles of `shingle` words joined by spaces with repeats (fewer
words: the whole sequence; no word: fingerprint zero), XXH64 with seed 42 of each; a bit is set if it is in over half.

Links (at most `radius` = 3 differing bits): each distinct fingerprint becomes a point, the bit counts of its 32 two-bit
segments. The Manhattan distance of two points is a lower bound of their Hamming distance, so linked ones lie within 3 of
each other, and the six bands that the segments form can differ in three at most: two linked points share the counts of
some three of the six bands. Each point is put into its 20 grid cells (the counts of three bands each). Within a cell the
join is by range: points in order of their total count, each against those whose total is within the radius (totals differ
by no more than the Manhattan distance), by that distance first, and then exactly. A cell of more than `block` points is cut into blocks by hash and every pair
of blocks gets a task of its own, so no cell is too large for a task and none is capped. A task gives a spanning forest
of its links, not all pairs; components of the whole are found over these links.

One third of all rows may share one fingerprint: equal ones are reduced before the shuffle to one point, and results are
joined back on a join that Spark splits where it is skewed.

Edge cases: null and empty texts have fingerprint zero and link like any other; a null id counts as larger than any and
its component is that of its fingerprint; repeated rows are kept, each with its component; an empty table gives no rows;
extra columns are ignored by the operator and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, texts
from .components import components

SEGMENT_BITS = 2
#: Six bands of the 32 segments.
BANDS = [range(0, 6), range(6, 12), range(12, 17), range(17, 22), range(22, 27), range(27, 32)]
CELLS = list(combinations(range(6), 3))


def fingerprint(text: str, shingle: int = 3) -> int:
    return int(fingerprints([text], shingle)[0])


def fingerprints(batch: list[str], shingle: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(batch), np.uint64)
    for k, text in enumerate(batch):
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= shingle:
            out[k] = xxh64_intdigest(joined, 42)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
        hashes = np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64, n - shingle + 1)
        total = 0
        for s in range(0, len(hashes), 1 << 16):
            total = total + np.unpackbits(hashes[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the bits of fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts(batch, "text"), shingle).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _counts(fp: Column) -> Column:
    """The point as a long: each two-bit segment's count c written as c ones (00, 01 or 11), so that the Manhattan distance
    of two points is the number of bits in which they differ."""
    ones, high = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(ones).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(ones), 1))


def _mask(segments) -> int:
    m = sum(3 << (SEGMENT_BITS * s) for s in segments)
    return m - (1 << 64) if m >= 1 << 63 else m


def cells(points: DataFrame) -> DataFrame:
    """(fp) -> (cell number, counts of its bands, fp), 20 rows a point."""
    point = _counts(F.col("fp"))
    keys = [F.struct(F.lit(i).alias("cell"), point.bitwiseAND(F.lit(_mask([s for b in bands for s in BANDS[b]]))).alias("counts")) for i, bands in enumerate(CELLS)]
    return points.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.cell", "k.counts", "fp")


def _points(fp: np.ndarray) -> np.ndarray:
    """As _counts()."""
    ones, high = np.uint64(0x5555555555555555), fp >> np.uint64(1)
    return ((fp | high) & ones) | ((fp & high & ones) << np.uint64(1))


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each group's components. group: ascending. In order of total counts, each place is compared with those
    1, 2, ... behind it, as far as totals are within the radius."""
    n = len(fp)
    parent = np.arange(n)
    points = _points(fp)
    along = group * 128 + np.bitwise_count(points)
    order = np.argsort(along, kind="stable")
    fp, points, along = fp[order], points[order], along[order]
    last = np.searchsorted(along, along + radius, side="right")
    live = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = 1
    while True:
        live = live[live + step < last[live]]
        if not len(live):
            break
        other = live + step
        near = parent[live] != parent[other]
        a, b = live[near], other[near]
        near = np.bitwise_count(points[a] ^ points[b]) <= radius
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[near], b[near]
        if len(a):
            for i, j in zip(a.tolist(), b.tolist()):
                i, j = find(i), find(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        step += 1
    linked = np.nonzero(parent != np.arange(n))[0]
    return fp[linked], fp[parent[linked]]


def links(points: DataFrame, radius: int = 3, block: int = 2000) -> DataFrame:
    """(fp) distinct -> (a, b): links that span the components within each cell."""
    if radius > 3:
        raise ValueError("three bands of six are shared at a radius of 3 or less")
    rows = cells(points)
    sizes = rows.groupBy("cell", "counts").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["cell", "counts"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", "counts", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keys = ["cell", "counts", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            key, fp = part[:4], part[4].view(np.uint64)
            new = np.zeros(len(fp), bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            a, b = forest(np.cumsum(new), fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols
            same = np.ones(len(cols[0]), bool)
            for k in cols[:4]:
                same &= k == k[-1]
            at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group begins; it may go on
            if at:
                yield out([c[:at] for c in cols])
            held = [c[at:] for c in cols]
        if held and len(held[0]):
            yield out(held)

    return dealt.mapInArrow(run, "a long, b long")


def classes(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, root, component_id). root: the component's smallest fingerprint."""
    kept = materialise(fps, "fingerprints")
    first = materialise(kept.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = components(links(first.select("fp"), radius))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialise(named.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return kept.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id)."""
    return classes(fps, radius).drop("root")


def dedup(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs with one row of each component: that of its smallest id; of rows that repeat it one, and one of a component
    whose ids are all null."""
    found = classes(with_fingerprints(docs), radius)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays).alias("stays")).filter("stays")
    kept = materialise(kept, "kept")
    if not kept.filter("n > 1 or doc_id is null").isEmpty():
        return _one_each(docs, found)
    rows = docs.withColumn("_fp_id", F.col("doc_id").cast("long"))
    # ids that stay grow with the input: the same shuffle at every size, never a broadcast
    ids = kept.select(F.col("doc_id").alias("_kept")).hint("merge")
    return rows.join(ids, F.col("_fp_id") == F.col("_kept"), "left_semi").drop("_fp_id")


def _one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """dedup() where an id that stays repeats or is null: rows are told apart by a number given once and written down."""
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    fps = materialise(with_fingerprints(numbered, id_col="_row").withColumnRenamed("doc_id", "_row"), "rowprints")
    by_fp = found.select("fp", "root", "component_id").distinct()
    keyed = numbered.select("_row", F.col("doc_id").cast("long").alias("_id")).join(fps, "_row").join(by_fp, "fp")
    best = keyed.filter(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("_row"))
    return numbered.join(best.select("_row"), "_row", "left_semi").drop("_row")


def op10_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(with_fingerprints(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
