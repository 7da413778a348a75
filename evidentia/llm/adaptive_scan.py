"""Approximate nearest neighbours by adaptive dimension scan over an inverted file.

Index: vectors are normalised and turned by a seeded random rotation; centroids come from a bounded sample by k-means: about
the square root of the number of rows, `most_lists` at most, of max(`sample`, 16 a list) rows of smallest seeded hash. Every
row is put into the list of its nearest centroid. How many lists a query probes is chosen on the sample: as few as hold
`recall` of the sample's own nearest neighbours (a sample's neighbours lie farther off than the whole's, so this errs on the
safe side); where rows cluster that is few, where they do not it is many.

Lists are gathered into shards of about `shard_rows` rows (eight times the root of the rows, within 1,024 and 16,384), and a
list larger than that is cut into several by hash. A query
goes once to each shard that holds a list it probes; a task is a shard and at most `query_block` queries, and the rows of a
shard are repeated only for queries beyond that, counted shard by shard. Of rows with equal vectors those with the k + 1
smallest ids suffice: the others could only follow them. So a vector that a third of all rows share costs k + 1 rows.

Search: in a task, list by list, queries that probe a list meet its rotated vectors in column blocks of `step` dimensions.
After each, the partial squared distance s of d of D dimensions, scaled to s D / d, is an estimate of the whole; the
hypothesis that the whole is within the current k-th distance r is rejected, and the candidate abandoned, where
s D / d > r (1 + e / sqrt(d))^2. What is left after the last block is scored exactly: cosine in double precision of the
original vectors (scaled by a power of two, so that no square over- or underflows). A query begins with its k nearest of
`anchors` rows of the sample: they are candidates, and the k-th of all can only be nearer than theirs. Tasks give k rows a
query at most, of which, with those, the best are kept.

Edge cases: null vectors or ids, zero vectors, vectors that hold null or non-finite components, and vectors of another
dimension than most of the sample take no part; rows with the query's own id are its own; equal scores go to the smaller id;
an id that repeats with several vectors is a candidate with each, returned once, at its best score; as a query it has one
ranking, each neighbour at its best score to any of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table


@dataclasses.dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int  # lists that a query probes
    anchors: np.ndarray  # vectors of some of the sample, and their ids
    anchor_ids: np.ndarray
    counts: np.ndarray  # rows of each list
    shard_rows: int = 1024
    rows: DataFrame | None = None  # vec_id, v, list, shard

    def turn(self, v: np.ndarray) -> np.ndarray:
        return unit(v) @ self.rotation

    def shards(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each list: its first shard and how many it is cut into. Small lists share one."""
        first, parts, shard_rows = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64), self.shard_rows
        at, held = 0, 0
        for i, n in enumerate(self.counts.tolist()):
            if held and held + n > shard_rows:
                at, held = at + 1, 0
            first[i], parts[i] = at, max(1, -(-n // shard_rows))
            held += n
            if parts[i] > 1:
                at, held = at + int(parts[i]), 0
        return first, parts


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, its largest component below 1: exact, and squares neither over- nor underflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def fit(vectors: DataFrame, sample: int = 8192, most_lists: int = 4096, recall: float = 0.95, k: int = 5, anchors: int = 4096, seed: int = 3, rounds: int = 8) -> Index | None:
    """Rotation, centroids and the number of probes, of a sample of at most max(sample, 16 most_lists) rows; None for an
    empty table."""
    wanted = max(1, min(most_lists, int(vectors.count() ** 0.5)))
    h = F.xxhash64("vec_id", F.lit(seed))
    slots = vectors.groupBy(F.pmod(h, F.lit(max(sample, 16 * wanted))).alias("slot")).agg(F.min(h).alias("h"))
    picked = vectors.withColumn("h", h).join(F.broadcast(slots.select("h")), "h").groupBy("h", "vec_id").agg(F.min("v").alias("v"))
    found = sorted((r.h, r.v, r.vec_id) for r in picked.collect())
    if not found:
        return None
    dim = Counter(len(v) for _, v, _ in found).most_common(1)[0][0]
    x = np.array([v for _, v, _ in found if len(v) == dim])
    ids = np.array([i for _, v, i in found if len(v) == dim], np.int64)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    original, x = x, unit(x) @ rotation
    n_lists = max(1, min(wanted, len(x) // 16))
    centroids = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(1)
        order = np.argsort(near, kind="stable")
        met, start = np.unique(near[order], return_index=True)
        mean = np.add.reduceat(x[order], start, axis=0)
        centroids[met] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    _, once = np.unique(ids, return_index=True)
    kept = np.sort(rng.permutation(once)[:anchors])
    return Index(rotation, centroids, needed(x, centroids, k, recall, rng), original[kept], ids[kept], np.zeros(n_lists, np.int64))


def needed(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, rng: np.random.Generator, queries: int = 512) -> int:
    """The fewest nearest lists that hold `recall` of the k nearest neighbours, in the sample, of some of its rows."""
    q = rng.choice(len(x), min(queries, len(x)), replace=False)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    if not top.size:
        return len(centroids)
    place = np.argsort(np.argsort(-(x[q] @ centroids.T), axis=1, kind="stable"), axis=1)
    home = (x @ centroids.T).argmax(1)
    ranks = np.sort(np.take_along_axis(place, home[top], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def build(vectors: DataFrame, index: Index, k: int = 5, shard_rows: int | None = None) -> Index:
    """Put every row into its list and shard. Of rows with equal vectors the k + 1 smallest ids stand for all."""
    dim = len(index.rotation)
    equal = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    kept = vectors.filter(F.size("v") == dim).distinct().withColumn("n", equal).filter(F.col("n") <= k + 1).drop("n")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (index.turn(_matrix(batch.column(1), dim)) @ index.centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    rows = materialise(kept.mapInArrow(assign, "vec_id long, v array<double>, list int"), "lists")
    counts = np.zeros(len(index.centroids), np.int64)
    for r in rows.groupBy("list").count().collect():  # one row a list
        counts[r["list"]] = r["count"]
    index = dataclasses.replace(index, counts=counts, shard_rows=shard_rows or min(16384, max(1024, 8 * isqrt(int(counts.sum())))))
    first, parts = (F.element_at(F.lit(x), F.col("list") + 1) for x in index.shards())
    return dataclasses.replace(index, rows=rows.withColumn("shard", (first + F.pmod(F.xxhash64("vec_id", F.lit(1)), parts)).cast("int")))


def scan(queries: np.ndarray, rotated_q: np.ndarray, ids_q: np.ndarray, probes: np.ndarray, rows: np.ndarray, rotated: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, step: int = 16, error: float = 2.1, chunk: int = 512, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of one shard for each query: query number, row number, score. probes: for each query and list, whether it looks
    there; lists: each row's, ascending; radius: squared distances within which k rows are known to be."""
    dim = rotated.shape[1]
    nq = len(queries)
    queries, rows = scaled(queries), scaled(rows)
    norm_q, norm = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    radius = np.full(nq, np.inf) if radius is None else radius.copy()  # squared distance of the k-th best so far
    cuts = np.unique(np.concatenate([np.nonzero(np.diff(lists))[0] + 1, np.arange(0, len(rows), chunk), [len(rows)]]))
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part = rotated[start:stop]
        asking = np.nonzero(probes[:, lists[start]])[0]
        if not len(asking):
            continue
        partial = None
        for d0 in range(0, dim, step):
            d1 = min(dim, d0 + step)
            if partial is None:  # all pairs of the asking queries and this chunk, as a product of matrices
                own = rotated_q[asking, d0:d1]
                s = (own**2).sum(1)[:, None] + (part[:, d0:d1] ** 2).sum(1)[None, :] - 2 * own @ part[:, d0:d1].T
                q, r = np.nonzero(s * dim / d1 <= (radius[asking] * (1 + error / np.sqrt(d1)) ** 2)[:, None] + 1e-9)
                partial = s[q, r]
                q = asking[q]
            else:
                diff = rotated_q[q, d0:d1] - part[r, d0:d1]
                partial = partial + np.einsum("ij,ij->i", diff, diff)
                slack = (1 + error / np.sqrt(d1)) ** 2 if d1 < dim else 1.0
                go = partial * dim / d1 <= radius[q] * slack + 1e-9
                q, r, partial = q[go], r[go], partial[go]
        other = ids_q[q] != ids[start + r]
        q, r = q[other], r[other] + start
        if not len(q):
            continue
        score = np.empty(len(q))
        for a in range(0, len(q), 1 << 15):
            i, j = q[a : a + (1 << 15)], r[a : a + (1 << 15)]
            score[a : a + (1 << 15)] = (queries[i] * rows[j]).sum(1) / (norm_q[i] * norm[j])
        q, r, score = (np.concatenate(x) for x in zip(best, (q, r, score)))
        order = np.lexsort((-score, ids[r], q))  # an id counts once, at its best
        q, r, score = q[order], r[order], score[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (ids[r[1:]] != ids[r[:-1]])
        q, r, score = q[first], r[first], score[first]
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        best = (q[keep], r[keep], score[keep])
        full = keep & (rank == k - 1)
        radius[q[full]] = np.minimum(radius[q[full]], np.maximum(0, 2 - 2 * score[full]) + 1e-9)
    return best


def search(index: Index, queries: DataFrame, k: int = 5, query_block: int = 4096) -> DataFrame:
    """queries (vec_id, v) -> query_id, rank, vec_id, score."""
    dim, counts, least = len(index.rotation), index.counts, index.probes
    first, parts = index.shards()
    held, index = index.rows, dataclasses.replace(index, rows=None)  # tasks get the numbers only

    def probed(v: np.ndarray) -> np.ndarray:
        """For each query and list, whether it is probed: the nearest ones, and more where those hold too few rows."""
        order = np.argsort(-(index.turn(v) @ index.centroids.T), axis=1, kind="stable")
        need = np.maximum(least, (np.cumsum(counts[order], axis=1) < 2 * k + 2).sum(1) + 1)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None, :] < need[:, None], 1)
        return out & (counts > 0)

    def reached(v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's k nearest anchors and their cosines, nearest first; none where there are too few anchors."""
        if len(index.anchors) <= k:
            return np.zeros((len(v), 0), np.int64), np.zeros((len(v), 0))
        near = unit(v) @ unit(index.anchors).T
        near[own[:, None] == index.anchor_ids[None, :]] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        q, a = scaled(v), scaled(index.anchors)
        cosine = (q[:, None, :] * a[top]).sum(2) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(a, axis=1)[top])
        order = np.argsort(-cosine, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.take_along_axis(cosine, order, 1)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = np.asarray(batch.column(0))
                top, cosine = reached(_matrix(batch.column(1), dim), ids)
                q = np.repeat(ids, top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(index.anchor_ids[top.ravel()], pa.int64()), pa.array(cosine.ravel())], ["query_id", "vec_id", "score"])

    shard_of = np.concatenate([np.zeros(0, np.int64), *[f + np.arange(p) for f, p in zip(first, parts)]])
    list_of = np.repeat(np.arange(len(parts)), parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                asks = probed(_matrix(batch.column(1), dim))[:, list_of]
                met = np.unique(np.stack([(x := np.nonzero(asks))[0], shard_of[x[1]]], 1), axis=0)
                take = batch.take(pa.array(met[:, 0]))
                cosine = reached(_matrix(batch.column(1), dim), np.asarray(batch.column(0)))[1]
                within = np.maximum(0, 2 - 2 * cosine[:, -1]) + 1e-9 if cosine.shape[1] else np.full(len(cosine), np.inf)
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(within[met[:, 0]]), pa.array(met[:, 1].astype(np.int32))], ["vec_id", "v", "within", "shard"])

    queries = queries.filter(F.size("v") == dim).distinct()
    known = queries.mapInArrow(begin, "query_id long, vec_id long, score double")
    asked = materialise(queries.mapInArrow(route, "vec_id long, v array<double>, within double, shard int"), "asked")
    # a shard's rows are repeated for every query_block queries that come to it
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))  # one row a shard
    asked = asked.join(blocks, "shard").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int")).drop("blocks")
    held = held.join(blocks, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by([("list", "ascending"), ("vec_id", "ascending")])
        rv, ri, lists = _matrix(right["v"], dim), np.asarray(right["vec_id"]), np.asarray(right["list"])
        turned = index.turn(rv)
        out = []
        for at in range(0, left.num_rows, query_block):  # blocks are dealt by hash: about as many, not exactly
            own = left.slice(at, query_block)
            qv, qi = _matrix(own["v"], dim), np.asarray(own["vec_id"])
            q, r, score = scan(qv, index.turn(qv), qi, probed(qv), rv, turned, ri, lists, k, radius=np.asarray(own["within"]))
            out.append(pa.table([pa.array(qi[q]), pa.array(ri[r]), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    found = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(tile, "query_id long, vec_id long, score double")
    found = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    index = fit(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(build(vectors, index), vectors.filter(F.col("vec_id") % 50 == 0))
