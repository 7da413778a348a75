import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from oracle import assert_same

from evidentia.llm import backoff_lm as lm
from evidentia.llm import byte_gru as g
from evidentia.llm import quality_qda as q


# ---- language ID


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = g.fit([("a", "xyzzy plugh " * 9), ("b", "éàü ßñ " * 9), ("c", "0123 " * 9)], hidden=3, steps=2, batch=4)
    m = g.ByteGru(m.langs, m.window, *(x.astype(float) for x in (m.x, m.u, m.o, m.b)))
    wins, doc, length = g.windows([rng.bytes(n) for n in (70, 5, 64)], m.window)
    target = doc % 3
    _, grads = g.gradients(m, wins, length, target)
    for p, d in zip((m.x, m.u, m.o, m.b), grads):
        for at in np.argsort(-np.abs(d).ravel())[:4]:
            i = np.unravel_index(at, p.shape)
            old = p[i]
            p[i] = old + 1e-4
            up = g.gradients(m, wins, length, target)[0]
            p[i] = old - 1e-4
            down = g.gradients(m, wins, length, target)[0]
            p[i] = old
            assert d[i] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-7)


def test_fast_and_plain_forward_agree():
    m = g.fit([("a", "xyzzy plugh " * 30), ("b", "éàü ßñ " * 30)], steps=5, batch=16)
    texts = ["hello é", "", "x" * 200, "plugh ß " * 50]
    fast = m.pooled(texts)
    for t, p in zip(texts, fast):
        raw = t.encode()
        wins, _, length = g.windows([raw], m.window)
        post = g._forward(m, wins, length)["p"]
        plain = sum((post[: n, w].sum(0) for w, n in enumerate(length)), np.zeros(2)) / max(1, len(raw))
        assert p == pytest.approx(plain, abs=1e-4)
    assert len(m.labels("plugh é")) == len("plugh é".encode())


def test_language_query(spark, sf):
    got = {r.doc_id: r for r in g.op7_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    m = g.fit([("a", "xyzzy plugh " * 30), ("b", "éàü ßñ " * 30)], steps=5, batch=16)
    df = spark.createDataFrame([(1, None, "old"), (None, "", "old"), (2, "12 !?", "old"), (3, "éàü " * 4000, "old"), (3, "éàü " * 4000, "old")], "doc_id long, text string, lang_pred string")
    got = g.predict(df, m).collect()
    assert [r.lang_pred for r in got if not r.text or r.doc_id == 2] == ["und"] * 3 and len({(r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 1
    assert {r.lang_pred for r in g.predict(df, None).collect()} == {"und"} and g.predict(df.limit(0), m).count() == 0
    none = spark.createDataFrame([(1, None, "x"), (2, "en", None), (None, "en", "x")], "doc_id long, lang string, text string")
    assert g.sample(none) == [] and g.fit([]) is None


def test_sample_is_bounded_and_blind_to_held_out(spark):
    df = spark.createDataFrame([(i, "en" if i % 3 else "fr", f"text {i}") for i in range(400)] * 2, "doc_id long, lang string, text string")
    rows = g.sample(df, docs_per_lang=20)
    assert 0 < len(rows) <= 40
    assert all(zlib.crc32(t.split()[1]) % 5 != 0 for _, t in rows)


def test_every_part_of_a_text_may_be_learned_from(spark):
    text = "".join(f"{i:063d} " for i in range(500))
    one, two = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5][:2]
    df = spark.createDataFrame([(one, "en", text), (two, "en", "short é" * 3)], "doc_id long, lang string, text string")
    rows = g.sample(df, windows_per_lang=100_000)
    assert sorted(x for _, x in rows) == sorted([*(text[k : k + 64].encode() for k in range(0, len(text), 64)), ("short é" * 3).encode()])
    few = g.sample(df, windows_per_lang=50)
    assert 25 < len(few) <= 50 and any(int(x) > 400 for _, x in few if x[:1] == b"0") and any(int(x) < 100 for _, x in few if x[:1] == b"0")


def test_large_logits(spark):
    m = g.fit([("a", "xyzzy plugh " * 30), ("b", "éàü ßñ " * 30)], steps=5, batch=16)
    m.b = np.array([300.0, 0.0], np.float32)
    assert m.pooled(["plugh", "é"]) == pytest.approx(np.array([[1.0, 0.0]] * 2))


def test_language_query_against_each_text_by_itself(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = g.fit(g.sample(docs.select("doc_id", "lang", "text")))
    got = {r.doc_id: r for r in g.op7_language_id(spark, sf).collect()}
    for d in docs.limit(60).collect():
        raw = d.text.encode()
        wins, _, length = g.windows([raw], m.window)
        post = g._forward(m, wins, length)["p"]
        mean = sum((post[:n, w].sum(0) for w, n in enumerate(length)), np.zeros(len(m.langs))) / max(1, len(raw))
        letters = any(c.isalpha() for c in d.text)
        assert got[d.doc_id].lang_pred == (m.langs[int(mean.argmax())] if letters else "und")
        assert got[d.doc_id].score == pytest.approx(float(mean.max()) if letters else 0.0, abs=1e-4)


# ---- quality


def test_quality_query(spark, sf):
    got = {r.doc_id: r for r in q.op9_quality_qda(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert np.mean([got[x.doc_id].predicted == x.quality for x in held]) >= 0.85
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_quality_on_held_out_documents(spark):
    got = {r.doc_id: r for r in q.op9_quality_qda(spark, "/root/testdata/sf0.1").filter("held_out").collect()}
    labels = [x for x in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if x.doc_id in got]
    good = [got[x.doc_id].predicted for x in labels if x.quality == 1]
    assert np.mean(good) >= 0.99 and np.mean([got[x.doc_id].predicted == 0 for x in labels if x.quality == 0]) >= 0.97


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (400, 3))])
    y = np.repeat([0, 1], 400)
    m = q.fit(x, y, np.array([1.0, 3.0]))
    for p in x[:5]:
        logs = []
        for c in (0, 1):
            sigma = m.factor[c] @ m.factor[c].T
            d = p - m.mean[c]
            logs.append(np.log([0.25, 0.75][c]) - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * d @ np.linalg.solve(sigma, d))
        assert m.score(p[None])[0] == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_query_against_each_text_by_itself(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    m = q.train(docs, labels)
    got = {r.doc_id: r for r in q.op9_quality_qda(spark, sf).collect()}
    for d in docs.collect():
        p = q.statistics([d.text])[0]
        logs = []
        for c in (0, 1):
            sigma, off = m.factor[c] @ m.factor[c].T, p - m.mean[c]
            logs.append(m.log_prior[c] - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * off @ np.linalg.solve(sigma, off))
        expected = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        assert got[d.doc_id].score == pytest.approx(expected, abs=1e-9) and got[d.doc_id].predicted == (got[d.doc_id].score >= 0.7)


def test_a_document_with_two_labels_counts_for_both(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:20]
    docs = spark.createDataFrame([(i, "Some words here." if k % 2 else "@@ ## 12") for k, i in enumerate(ids)], "doc_id long, text string")
    labels = [(i, k % 2) for k, i in enumerate(ids)] + [(ids[0], 1), (ids[0], 1)]
    m = q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert m.log_prior == pytest.approx(np.log([10 / 22, 12 / 22]))
    assert {round(r.score) for r in q.score(docs, m).collect()} == {0, 1}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "Some words here.", 5), (1, "Some words here.", 5), (None, None, 5), (2, "", 5), (3, "x" * 200_000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, none)
    assert {(r.score, r.predicted) for r in q.score(docs, model).collect()} == {(1.0, 1)}
    assert q.score(docs.limit(0), model).count() == 0
    two = q.fit(q.statistics(["Good words in a line.", "Other good words.", "BAD!! BAD!! BAD!!", "@@@ ### $$$"]), np.array([1, 1, 0, 0]), np.array([1.0, 1.0]))
    got = q.score(docs, two).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1


# ---- language model


def test_scores_against_duckdb(spark, sf):
    assert_same(lm.op5_backoff_lm(spark, sf), lm.OP5_SQL, sf)


def brute(texts: list[str], order: int) -> list[float]:
    from collections import Counter
    from math import log

    words = [t.split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words)) or 1
    out = []
    for w in words:
        s = 0.0
        for i in range(len(w)):
            back = 0.0
            for n in range(min(order, i + 1), 1, -1):
                g_ = tuple(w[i - n + 1 : i + 1])
                if counts[g_] >= lm.MIN_COUNT:
                    s += back + log(counts[g_] / counts[g_[:-1]])
                    break
                back += log(lm.ALPHA)
            else:
                s += back + log(counts[(w[i],)] / total)
        out.append(s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcdef"), rng.integers(0, 60))) for _ in range(30)] + ["a b a b", "a b a b", "", "solo"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    for chunk_bytes, bucket_words in ((1 << 20, 10**6), (60, 20)):
        got = {r.doc_id: r.log_score for r in lm.scores(df, order, chunk_bytes=chunk_bytes, bucket_words=bucket_words).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(brute(texts, order))


def test_input_that_is_no_table_of_files(spark):
    texts = ["a b c a b", "b c a", "a b"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).orderBy(F.rand(1)).limit(100)
    got = {r.doc_id: r.log_score for r in lm.scores(df, 3, chunk_bytes=20, bucket_words=1).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute(texts, 3))


def test_rows_on_the_way_are_never_more_than_n_grams(spark):
    df = spark.createDataFrame([(i, f"w{i} x") for i in range(10)], "doc_id long, text string").coalesce(1)
    asked = lm.requests(df, 12, 2, 1).collect()
    assert len(asked) <= 30 and len({r.chunk for r in asked}) == 10


def test_scores_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "z"), (3, "")], "doc_id long, text string")
    got = lm.scores(df).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 1, 2, 2] and all(r.log_score == 0 == r.mean_score for r in got if r.n_words == 0)
    assert lm.scores(df.limit(0)).count() == 0


def test_planes():
    for x in ([], [0], [2**64 - 1, 0, 5], list(range(300))):
        a = np.array(x, np.uint64)
        assert (lm.from_planes(lm.planes(a))[0] == a).all()
