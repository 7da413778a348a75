import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.operators import ledger

D = "package string, file string, pkg_clause string, kind string, receiver string, name string, hash string"
H = "package string, file string, hash string, embedded boolean"


def diffs(spark, before, after):
    key = ["package", *ledger.IDENTITY]
    return ledger.diff(spark.createDataFrame(before, D), spark.createDataFrame(after, D), key)


def row(name, h, kind="func", receiver="", file="a_test.go", clause="p"):
    return ("p", file, clause, kind, receiver, name, h)


def test_equal_hashes_cancel_and_the_rest_pair_up(spark):
    got = diffs(spark, [row("init", "1", "init"), row("init", "2", "init"), row("init", "2", "init")], [row("init", "2", "init"), row("init", "3", "init")]).collect()
    assert Counter((r.op, r.before_hash, r.after_hash) for r in got) == Counter([("changed", "1", "3"), ("removed", "2", None)])


def test_package_clause_is_identity_even_when_missing(spark):
    got = diffs(spark, [row("F", "1", clause=None)], [row("F", "1")]).collect()
    assert {r.op for r in got} == {"added", "removed"}


def test_diff_against_plain_multisets(spark):
    rng = random.Random(1)
    make = lambda: [row(rng.choice("AB"), rng.choice("123"), rng.choice(["func", "init"])) for _ in range(rng.randrange(1, 12))]
    for _ in range(4):
        before, after = make(), make()
        got = diffs(spark, before, after).collect()
        sizes = Counter(r.op for r in got)
        changed = added = removed = 0
        for identity in {x[:-1] for x in before + after}:
            b, a = (Counter(x[-1] for x in side if x[:-1] == identity) for side in (before, after))
            nb, na = (b - a).total(), (a - b).total()
            changed, added, removed = changed + min(nb, na), added + max(0, na - nb), removed + max(0, nb - na)
        assert (sizes["changed"], sizes["added"], sizes["removed"]) == (changed, added, removed)


INERT = [
    ([row("F", "1")], [], True), ([row("F", "1", "const")], [], True), ([row("F", "1", "type")], [], True), ([], [], True),
    ([row("F", "1", "var")], [], False), ([row("init", "1", "init")], [], False), ([row("TestMain", "1")], [], False), ([row("M", "1", "method", "T")], [], False),
    ([row("F", "1", "directive")], [], False), ([row("F", "1", None)], [], False),
    ([], [("p", "a_test.go", "h", False)], True), ([], [("p", "x.txt", "h", True)], False),
]


@pytest.mark.parametrize(("added", "headers", "expected"), INERT)
def test_inert(spark, added, headers, expected):
    none = spark.createDataFrame([], H)
    changes = ledger.headers(none, spark.createDataFrame(headers, H))
    got = ledger.inert(diffs(spark, [], added), changes, spark.createDataFrame([("p",)], "package string")).first()
    assert got.inert is expected


def test_changes_and_removals_are_not_inert(spark):
    none = ledger.headers(spark.createDataFrame([], H), spark.createDataFrame([], H))
    p = spark.createDataFrame([("p",)], "package string")
    assert not ledger.inert(diffs(spark, [row("F", "1")], [row("F", "2")]), none, p).first().inert
    assert not ledger.inert(diffs(spark, [row("F", "1")], []), none, p).first().inert


def test_moved_files(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, digest string")
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "1")], "path string, digest string")
    assert {(r.path, r.op) for r in ledger.moved_files(b, a).collect()} == {("b", "changed"), ("d", "removed"), ("e", "added")}


def test_positional_and_governing(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, None), ("g", 3, "b")], "g string, ord int, v string")
    got = df.withColumn("x", ledger.governing("v", ["g"], ["ord"])).withColumn("n", ledger.ordinal(["g"], ["ord"])).orderBy("ord").collect()
    assert [r.x for r in got] == ["a", "a", "b"] and [r.n for r in got] == [0, 1, 2]
    two = spark.range(1).select(ledger.positional(F.lit("x"), F.lit(0)).alias("a"), ledger.positional(F.lit("x"), F.lit(1)).alias("b")).first()
    assert two.a != two.b
