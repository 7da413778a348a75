import dataclasses
import re

import numpy as np
import pytest
import xxhash
from oracle import assert_same

from evidentia.llm import adaptive_scan as ann
from evidentia.llm import imatch, mixing
from evidentia.llm import simhash_segments as sim

SIGNED = lambda x: x - (1 << 64) if x >= 1 << 63 else x


# ---- SimHash


def brute_print(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "a b c d", "É é\x0bx\x1fy", "w " * 3000, "a b c a b c a b c"])
def test_fingerprints(text):
    assert sim.fingerprint(text) == brute_print(text)


def brute_components(fp: np.ndarray) -> np.ndarray:
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def cloud(seed: int, centres: int = 25, each: int = 25) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = [0, 1, 3, 2**64 - 1]
    for base in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(base)
            for k in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("block", [2000, 6])
def test_components_against_brute_force(spark, block):
    fp = cloud(block)
    label = brute_components(fp)
    rows = [SIGNED(int(x)) for x in fp]
    found = {r.node: r.root for r in sim.components(sim.links(spark.createDataFrame([(x,) for x in rows], "fp long"), block=block)).collect()}
    roots = [found.get(x, x) for x in rows]
    groups = {}
    for root, x in zip(roots, label):
        assert groups.setdefault(root, x) == x
    assert len(set(roots)) == len(set(label))


def test_points_bound_the_distance():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**64, (2, 500), dtype=np.uint64)
    points = np.bitwise_count(sim._points(a) ^ sim._points(b))
    counts = lambda x: np.array([[bin(int(v) >> 2 * s & 3).count("1") for s in range(32)] for v in x])
    assert (points == np.abs(counts(a) - counts(b)).sum(1)).all() and (points <= np.bitwise_count(a ^ b)).all()


def test_simhash_query(spark, sf):
    got = sim.op10_simhash_segments(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{brute_print(v):016x}" for k, v in docs.items()}
    ids = sorted(docs)
    label = brute_components(np.array([brute_print(docs[i]) for i in ids], np.uint64))
    assert {r.doc_id: r.component_id for r in got} == {i: ids[k] for i, k in zip(ids, label)}


def test_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a b c d", 1), (1, "a b c d", 1), (2, "A b c d", 3), (None, "", 4), (None, None, 5), (9, "q r s", 7), (9, "zz y", 8)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.text or "") for r in sim.dedup(df).collect())
    # "", "a b c d" and its copies, "q r s" and "zz y" are four components; 9 is the smallest id of two
    assert got == [(-1, ""), (1, "a b c d"), (9, "q r s"), (9, "zz y")]
    assert sim.dedup(df).columns == df.columns and sim.dedup(df.limit(0)).count() == 0
    plain = spark.createDataFrame([(i, "same text in all of these") for i in range(50)] + [(99, "another text than the others here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in sim.dedup(plain).collect()) == [0, 99]


def _near_texts():
    """Two different texts whose fingerprints differ in 1 to 3 bits."""
    base = " ".join(f"w{i}" for i in range(400))
    for i in range(400):
        other = base.replace(f"w{i} ", f"v{i} ")
        if 1 <= bin(sim.fingerprint(base) ^ sim.fingerprint(other)).count("1") <= 3:
            return base, other
    raise AssertionError


def test_dedup_of_null_and_repeated_ids(spark):
    a, b = _near_texts()
    far = "some quite different text in here"
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    assert sim.dedup(rows((None, a), (None, b))).count() == 1
    assert sorted(r.text for r in sim.dedup(rows((None, a), (None, b), (None, far))).collect()) == sorted([far, min(r.text for r in sim.dedup(rows((None, a), (None, b), (None, far))).collect() if r.text != far)])
    # 5 repeats: the smallest of its first component, but not of its second
    got = sorted((r.doc_id, r.text) for r in sim.dedup(rows((5, a), (7, b), (5, far), (2, far))).collect())
    assert got == [(2, far), (5, a)]


# ---- I-Match


def test_imatch_against_duckdb(spark, sf):
    assert_same(imatch.op8_imatch(spark, sf), imatch.OP8_SQL, sf)


def test_imatch_over_many_ranges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert_same(imatch.fingerprints(docs, rows_per_range=7), imatch.OP8_SQL, sf)


def test_imatch_is_native(spark, sf):
    plan = imatch.op8_imatch(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_imatch_edges(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 1), (None, "z", 1), (3, "", 1), (4, "x " * 9000, 1)], "doc_id long, text string, range int")
    got = imatch.fingerprints(df, rows_per_range=2).collect()
    assert len(got) == 6 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = [r.fingerprint for r in got if r.doc_id == 1]
    assert one[0] == one[1]
    assert imatch.fingerprints(df.limit(0)).count() == 0
    alone = imatch.fingerprints(df.filter("doc_id = 3")).first()
    assert (alone.near_edited, alone.near_next) == (1.0, 1.0)


def test_imatch_tells_edits_from_neighbours(spark):
    got = imatch.op8_imatch(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.9


# ---- nearest neighbours


def brute_nearest(ids, x, k=5):
    ok = np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)
    n = np.linalg.norm(x, axis=1)
    out = {}
    for i in np.nonzero(ok & (ids % 50 == 0))[0]:
        s = (x * x[i]).sum(1) / np.where(ok, n * n[i], 1)
        s[~ok | (ids == ids[i])] = -9
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if s[j] > -9]
    return out


def test_recall_of_the_query(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
        truth = brute_nearest(rows.vec_id.values, np.stack(rows.embedding.values).astype(float))
        got = ann.op3_adaptive_scan(spark, f"/root/testdata/{sf}").toPandas()
        hits = sum(len({v for v, _ in truth[q]} & set(d.vec_id)) for q, d in got.groupby("query_id"))
        assert set(got.query_id) == set(truth) and (got.groupby("query_id").size() == 5).all()
        assert hits / sum(map(len, truth.values())) >= 0.9


def test_scan_is_exact_without_error_allowance():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((900, 32)), rng.standard_normal((7, 32))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    qi, ri, score = ann.scan(q, unit(q), np.arange(7) - 100, np.ones((7, 3), bool), x, unit(x), np.arange(900), np.arange(900) // 300, 5, error=50)
    full = unit(q) @ unit(x).T
    for i in range(7):
        assert sorted(ri[qi == i]) == sorted(np.argsort(-full[i])[:5])
    assert score == pytest.approx(full[qi, ri])


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (50, [float("inf"), 1.0, 0.0])]
    v = ann.usable(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int"))
    got = ann.search(ann.build(v, ann.fit(v)), v.filter("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 8)] and got[0].score == 1.0
    assert ann.fit(v.limit(0)) is None


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(9)
    base = np.tile(rng.standard_normal(16), (200, 1)) + rng.standard_normal((200, 16)) * 1e-3
    x = np.concatenate([base, rng.standard_normal((300, 16))])
    v = ann.usable(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    index = ann.fit(v)
    index = dataclasses.replace(index, probes=len(index.centroids))
    found = lambda rows, part: {(r.query_id, r["rank"]): r.vec_id for r in ann.search(ann.build(v, index, shard_rows=rows), v.filter("vec_id % 50 = 0"), query_block=part).collect()}
    whole = found(2048, 1024)
    assert whole == found(37, 3) and len(whole) > 5
    full = ann.unit(x) @ ann.unit(x).T
    for i in range(0, len(x), 50):
        full[i, i] = -2
        assert [whole[i, r] for r in range(1, 6)] == sorted(range(len(x)), key=lambda j: (-full[i, j], j))[:5]


def test_extreme_norms_take_part(spark):
    rows = [(0, [1e200, 1e-200, 0.0]), (1, [1e-200, 0.0, 0.0]), (2, [5e-324, 5e-324, 0.0]), (3, [0.0, 1e308, -1e308]), (4, [1.0, 0.0, 0.0])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(ann.build(v, ann.fit(v)), v.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in got] == [(1, 1.0), (4, 1.0), (2, round(0.5**0.5, 9)), (3, 0.0)]


def test_ids_and_vectors_that_repeat(spark):
    same = [(i, [1.0, 0.0]) for i in range(40)]  # one vector of many ids
    rows = [*same, (50, [1.0, 0.0]), (60, [0.6, 0.8]), (60, [0.8, 0.6]), (60, [0.8, 0.6]), (100, [0.0, 1.0]), (100, [0.6, 0.8])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(ann.build(v, ann.fit(v)), v.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    of = lambda q: [r.vec_id for r in got if r.query_id == q]
    assert of(0) == [1, 2, 3, 4, 5] and of(50) == [0, 1, 2, 3, 4]
    # 60 comes once, at its best score to either vector of 100
    assert of(100) == [60, 0, 1, 2, 3] and [round(r.score, 9) for r in got if r.query_id == 100] == [1.0, 0.6, 0.6, 0.6, 0.6]


# ---- mixing


def test_mix_against_duckdb(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert_same(mixing.op6_mixing(spark, sf), mixing.OP6_SQL, sf)


def test_mix_buckets_change_nothing(spark, sf):
    rows = mixing.narrow(spark.read.parquet(f"{sf}/documents.parquet"))
    out = mixing.select(rows, mixing.plan(rows, bucket_rows=3)).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")
    assert_same(out, mixing.OP6_SQL, sf)


def test_shortages_stay_with_siblings(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 5), ("b", "y", "1", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    from pyspark.sql import functions as F

    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, F.lit(800), {}, 1).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 5, ("b", "y", "1"): 395}
    everything = {r.budget for r in mixing.budgets(leaves, F.lit(10**9), {}, 1).collect()}
    assert everything == {10, 1000, 5}


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None, "a b c", 1), (1, None, None, "a b c", 1), (None, "en", "s", None, 1), (2, "en", "s", "", 1), (3, "en", "s", "x y", 1)], "doc_id long, lang string, source string, text string, epoch int")
    rows = mixing.narrow(df)
    out = mixing.select(rows, mixing.plan(rows, share=(9, 1), max_epochs=3))
    assert out.count() == 15
    empty = mixing.narrow(df.limit(0))
    assert mixing.select(empty, mixing.plan(empty)).count() == 0


def test_ranges_of_ids(spark):
    bounds = [-5, 0, 3, 7, 8, 100]
    ids = [None, -9, -5, -4, 0, 1, 3, 6, 7, 8, 9, 99, 100, 101]
    for some in ([], bounds[:1], bounds[:2], bounds[:5], bounds):
        df = spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1)
        got = [r.x for r in df.select(imatch.range_of(df.doc_id, some).alias("x")).collect()]
        assert got == [0 if i is None else sum(b <= i for b in some) for i in ids]
