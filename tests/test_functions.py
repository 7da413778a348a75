import base64
import hashlib
from posixpath import normpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import digest, paths, rules


def short(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()[:32]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_frames_count_bytes(spark):
    r = one(spark, x=digest.framed(F.lit("é"), F.lit(None).cast("string"), F.lit("ab")))
    assert r.x == "2:é0:2:ab"


def test_fold_is_sorted_distinct_and_empty_is_unknown(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b")], "g string, l string")
    assert df.groupBy("g").agg(digest.fold(F.col("l")).alias("h")).first().h == short(b"a\nb")
    assert df.filter("false").agg(digest.fold(F.col("l")).alias("h")).first().h is None


def test_base64url_round_trip(spark):
    for raw in (b"", b"\xff\xfe\xfd", b"a", b"ab?>", bytes(range(200))):
        r = one(spark, e=digest.base64url(F.lit(raw)))
        assert r.e == base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
        assert bytes(one(spark, d=digest.from_base64url(F.lit(r.e))).d) == raw
    assert one(spark, d=digest.from_base64url(F.lit("a"))).d is None
    assert one(spark, d=digest.from_base64url(F.lit("+/=="))).d is None


def test_environment_entries_tell_absence_from_emptiness(spark):
    r = one(spark, a=digest.env_entry(F.lit(None).cast("string")), b=digest.env_entry(F.lit("")))
    empty = hashlib.sha256(b"").hexdigest()
    assert (r.a, r.b) == (short(f"false {empty}".encode()), short(f"true {empty}".encode()))


def test_build_config(spark):
    env = F.create_map(F.lit("GOOS"), F.lit("linux"), F.lit("CC"), F.lit("gcc"))
    keys = {k: "" for k in digest.BUILD_ENV_KEYS + digest.BUILD_OS_KEYS} | {"GOOS": "linux", "CC": "gcc"}
    expected = "".join(f"env {len(k)}:{k} {len(v)}:{v}\n" for k, v in sorted(keys.items())) + "buildinput 2:-x\n"
    assert one(spark, d=digest.build_config(env, F.array(F.lit("-x")))).d == short(expected.encode())


def test_method_mask_covers_subsets(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "b"), ("i", "a")], "k string, m string")
    got = {r.k: r.x for r in df.groupBy("k").agg(digest.method_mask(F.col("m")).alias("x")).collect()}
    assert got["i"] & ~got["t"] == 0


CASES = ["", ".", "/", "//", "a//b", "a/./b", "a/../b", "../a", "a/../../b", "/../a", "/a/b/../..", "a/b/..", "./..", "/a/./b//c/"]


def test_clean_is_lexical_cleaning(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "p string").select("p", paths.clean(F.col("p")).alias("c"))
    for r in df.collect():
        expected = normpath(r.p) if r.p else "."
        assert r.c == (expected[1:] if expected.startswith("//") else expected), r.p


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", ""]), max_size=6), min_size=20, max_size=20))
def test_clean_property(spark, many):
    texts = ["/" + "/".join(x) for x in many]
    for r in spark.createDataFrame([(x,) for x in texts], "p string").select("p", paths.clean(F.col("p")).alias("c")).collect():
        expected = normpath(r.p)
        assert r.c == (expected[1:] if expected.startswith("//") else expected)


@pytest.mark.parametrize(("root", "p", "expected"), [("/m", "/m", "."), ("/m", "/m/a/b", "a/b"), ("/m", "/mm/a", None), ("/", "/a", "a"), ("/m", None, None)])
def test_rel_under(spark, root, p, expected):
    assert one(spark, r=paths.rel_under(F.lit(root), F.lit(p).cast("string"))).r == expected


def test_namespace_is_strict_inside(spark):
    f = lambda p: one(spark, x=paths.in_namespace(F.lit(p), F.lit("/t"), F.lit("go-"), F.lit(".tmp"))).x
    assert f("/t/go-1.tmp") and f("/t/go-1.tmp/deep")
    assert not f("/t/go-.tmp") and not f("/t") and not f("/u/go-1.tmp") and not f("/t/x/go-1.tmp")


def test_prefixes(spark):
    assert set(one(spark, x=paths.prefixes(F.lit("/a/b/c"))).x) == {"/", "/a", "/a/b", "/a/b/c"}


def test_volatile_roots_spare_machine_facts(spark):
    r = one(spark, a=paths.volatile(F.lit("/proc/self/maps")), b=paths.volatile(F.lit("/proc/cpuinfo")), c=paths.volatile(F.lit("/process/x")), d=paths.volatile(F.lit("/sys")))
    assert (r.a, r.b, r.c, r.d) == (True, False, False, True)


def test_harness_roots(spark):
    f = lambda n: one(spark, x=rules.harness_root(F.lit(n))).x
    assert f("Test") and f("TestX") and f("Benchmark_a") and f("FuzzÉ") and not f("Testa") and not f("Testé") and not f("test")


def test_cause_rank(spark):
    rank = lambda kind, p="os", o=False: one(spark, r=rules.cause_rank(F.lit(rules.KIND[kind]), F.lit(p), F.lit(o))).r
    assert [rank("test_runtime", "testing", True), rank("test_runtime", "testing"), rank("test_runtime", ""), rank("environment"), rank("file_io"), rank("opaque")] == [-1, 0, 4, 1, 3, 4]
