import json

import pytest
from metrics import joined
from oracle import assert_same
from pyspark.sql import functions as F

from evidentia.functions import rules
from evidentia.operators import attribution, closure, effects, explain, snapshot
from evidentia.plans.catalogue import QUERIES, SQL
from evidentia.schemas import DDL, schema
from evidentia.sources import listings
from evidentia.sources.memo import Memo


def test_all_schemas_parse():
    assert all(len(schema(n)) for n in DDL)


def package(path, **k):
    base = dict.fromkeys([f.name for f in schema("packages")]) | {"generation": "g", "import_path": path, "pkg_path": path, "dir": f"/src/{path}", "standard": False}
    return base | k


LOCAL = {"path": "m", "version": "", "dir": "/src", "main": True}
DEP = {"path": "d", "version": "v1", "dir": "/cache/d@v1", "main": False}


def test_listing_fails_as_a_whole(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"import_path": "a"}) + "\n")
    assert listings.listing(spark, str(good)).count() == 1
    (tmp_path / "bad.json").write_text('{"import_path": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        listings.listing(spark, str(tmp_path / "bad.json")).count()
    (tmp_path / "err.json").write_text(json.dumps({"import_path": "a", "error": "x"}) + "\n")
    with pytest.raises(ValueError, match="a: x"):
        listings.listing(spark, str(tmp_path / "err.json"))


def test_closures(spark):
    rows = [package("a", module=LOCAL), package("d/x", module=DEP, dir="/cache/d@v1/x"), package("fmt", standard=True), package("a.test", module=LOCAL), package("C")]
    nodes = closure.classes(spark.createDataFrame(rows, schema("packages")), "/cache")
    assert {(r.import_path, r["class"], r.pin) for r in nodes.collect()} == {("a", "mutable_local", None), ("d/x", "pinned", "d@v1"), ("fmt", "standard", None), ("a.test", "mutable_local", None), ("C", "standard", None)}
    files = lambda text: closure.file_sets(spark.createDataFrame([("g", "/src/a", "a.go", "go", text)], schema("package_files")))
    deps = spark.createDataFrame([("g", "a", x) for x in ("a", "d/x", "fmt", "a.test")] + [("g", "b", "d/x")], "generation string, root string, import_path string")
    hashes = lambda text: {r.root: r.hash for r in closure.maximal(deps, closure.contributions(nodes, files(text))).collect()}
    one, two = hashes(b"1"), hashes(b"2")
    assert one["a"] != two["a"] and one["b"] == two["b"] and all(one.values())
    unread = closure.contributions(nodes, closure.file_sets(spark.createDataFrame([], schema("package_files"))))
    assert {r.root: r.hash for r in closure.maximal(deps, unread).collect()}["a"] is None
    # a file that can't be read takes its folder's digest with it, a dependency that no listing knows its root's
    some = spark.createDataFrame([("g", "/src/a", "a.go", "go", b"1"), ("g", "/src/a", "b.go", "go", None)], schema("package_files"))
    assert [r.files_hash for r in closure.file_sets(some).collect()] == [None]
    lost = deps.unionByName(spark.createDataFrame([("g", "b", "nowhere")], deps.schema))
    after = {r.root: r.hash for r in closure.maximal(lost, closure.contributions(nodes, files(b"1"))).collect()}
    assert after["a"] == one["a"] and after["b"] is None


def test_pinned_is_by_the_packages_folder(spark):
    rows = [package("d/x", module=DEP, dir="/c+ache/d@v1/x"), package("e/x", module=DEP, dir="/elsewhere/x")]
    found = {r.import_path: r["class"] for r in closure.classes(spark.createDataFrame(rows, schema("packages")), "/c+ache").collect()}
    assert found == {"d/x": "pinned", "e/x": "mutable_local"}


def test_file_sets_are_the_documented_digest(spark):
    import hashlib

    files_ = {"b.go": b"2", "a.go": b"1"}
    rows = [("g", "/src/a", k, "go", v) for k, v in files_.items()]
    frame = b"".join(k.encode() + b"\0" + hashlib.sha256(files_[k]).hexdigest().encode() + b"\n" for k in sorted(files_))
    got = closure.file_sets(spark.createDataFrame(rows, schema("package_files"))).first().files_hash
    assert got == hashlib.sha256(frame).hexdigest()[:32]


def test_compartments_hold_what_only_tests_have(spark):
    s = "generation string, root string, file string, content_sha string"
    c = lambda extra: closure.compartment(spark.createDataFrame([("g", "a", "a.go", "1"), ("g", "a", "a_test.go", extra)], s), spark.createDataFrame([("g", "a", "a.go", "1")], s)).first().test_variants
    assert c("1") != c("2")


def test_source_files_and_native_parts(spark):
    df = spark.createDataFrame([package("a", go_files=["a.go"], s_files=["a.s"], cgo_files=[], embed_files=["a.go", "d"])], schema("packages"))
    r = df.select(closure.source_files().alias("f"), closure.native_effects().alias("n")).first()
    assert (r.f, r.n) == (["a.go", "a.s", "d"], ["assembly"])


def test_classification(spark):
    calls = [("f", "os", "Getenv", True, False), ("f", "fmt", "Fprintf", True, True), ("f", "fmt", "Sprintf", True, False), ("f", "strings", "Cut", True, False), ("f", "reflect", "ValueOf", True, False), ("f", "testing", "Log", True, False), ("f", "github.com/x", "Y", False, False), ("f", "fmt", "Fprint", True, None)]
    got = {r.symbol: (rules.KINDS[r.kind], r.observable) for r in effects.classify(spark.createDataFrame(calls, "fn string, pkg string, symbol string, std boolean, writer_in_memory boolean")).collect()}
    assert got == {"Getenv": ("environment", False), "ValueOf": ("unaudited_standard", False), "Log": ("test_runtime", True), "Fprint": ("formatted_output", False)}


def test_audited_reflection_and_subtest_drivers(spark):
    calls = [("f", "reflect", "TypeOf", None), ("f", "reflect", "DeepEqual", None), ("f", "reflect", "Copy", None), ("f", "testing", "Run", "T"), ("g", "testing", "Run", "M")]
    rows = spark.createDataFrame([(fn, p, s, r, True, False) for fn, p, s, r in calls], "fn string, pkg string, symbol string, receiver string, std boolean, writer_in_memory boolean")
    got = {(r.fn, r.symbol): (r.observable, r.reason) for r in effects.classify(rows).collect()}
    assert got == {
        ("f", "Copy"): (False, "reaches unaudited standard operation reflect.Copy"), ("f", "Run"): (True, "reaches testing.Run (test harness subtest execution)"),
        ("g", "Run"): (False, "reaches testing.Run (test runtime execution)"),
    }


EFFECT = "kind int, package_path string, symbol string, detail string, reason string, unrefinable boolean, observable boolean"


def effect(kind, reason, symbol="S", pkg="os", observable=False):
    return (rules.KIND[kind], pkg, symbol, "", reason, False, observable)


LADDER = [
    ({}, True, ""),
    ({"own": [effect("environment", "env")]}, False, "env"),
    ({"own": [effect("environment", "env"), effect("file_io", "io")]}, False, "io"),
    ({"own": [effect("network", "zz", "B"), effect("path_mutation", "aa", "A")]}, False, "aa"),
    ({"own": [effect("file_io", "seen", observable=True)]}, True, ""),
    ({"own": [effect("file_io", "io")], "scan": [effect("network", "net", "Dial", "net")]}, False, "package scan: net"),
    ({"scan": [effect("environment", "x", "Getenv"), effect("opaque", rules.RECEIVER_ESCAPE)]}, True, ""),
    ({"scan": [effect("network", "net", "Dial", "net")], "open": True}, False, "subject reachability is not closed: open subject world"),
    ({"open": True, "main": [effect("file_io", "m")]}, False, "m"),
    ({"main": [effect("file_io", "m")], "widen": [("testmain", "")]}, False, "test-main dispatch is not closed"),
    ({"widen": [("testmain", ""), ("startup", "w")]}, False, "startup effect: w"),
    ({"widen": [("startup", "w")], "startup": [effect("file_io", "s")]}, False, "startup effect: s"),
    ({"poison": "bad", "own": [effect("file_io", "io")]}, False, "bad"),
]


def test_observability_ladder(spark):
    tier = lambda name: spark.createDataFrame([(i, *e) for i, (c, *_) in enumerate(LADDER) for e in c.get(name, [])], "subject int, " + EFFECT)
    subjects = spark.createDataFrame([(i, f"p{i}", c.get("open", False)) for i, (c, *_) in enumerate(LADDER)], "subject int, package string, open_world boolean")
    scan = tier("scan").withColumn("package", F.concat(F.lit("p"), F.col("subject"))).drop("subject")
    widens = spark.createDataFrame([(i, *w) for i, (c, *_) in enumerate(LADDER) for w in c.get("widen", [])], "subject int, tier string, reason string")
    poison = spark.createDataFrame([(f"p{i}", "x", c["poison"]) for i, (c, *_) in enumerate(LADDER) if "poison" in c], "package string, path string, reason string")
    got = {r.subject: (r.observable, r.reason) for r in effects.observability(subjects, tier("startup"), tier("main"), tier("own"), widens, scan, poison).collect()}
    assert got == {i: (ok, why) for i, (_, ok, why) in enumerate(LADDER)}


def test_attributed_effects(spark):
    reached = spark.createDataFrame([("A", "f"), ("A", "std"), ("B", "g")], "subject string, fn string")
    fx = spark.createDataFrame([("f", 1), ("g", 2), ("std", 3)], "fn string, kind int")
    fns = spark.createDataFrame([("f", False), ("g", False), ("std", True)], "fn string, std boolean")
    assert {(r.subject, r.kind) for r in effects.attributed(reached, fx, fns).collect()} == {("A", 1), ("B", 2)}


def test_tally_of_effects(spark):
    reached = spark.createDataFrame([("A", "f"), ("A", "g"), ("A", "std"), ("B", "g"), ("C", "std"), ("D", "bare"), ("E", None)], "subject string, fn string")
    fx = spark.createDataFrame([("f", *effect("file_io", "r")), ("f", *effect("file_io", "r")), ("g", *effect("environment", "s")), ("std", *effect("network", "t")), (None, *effect("network", "t"))], "fn string, " + EFFECT)
    fns = spark.createDataFrame([("f", False), ("g", None), ("std", True), ("bare", False)], "fn string, std boolean")
    assert {tuple(r) for r in effects.tally(reached, fx, fns).collect()} == {("A", 3, 3), ("B", 1, 1)}
    assert {tuple(r) for r in effects.tally(reached, fx).collect()} == {("A", 4, 4), ("B", 1, 1), ("C", 1, 4)}


def test_subject_effects_meet_functions_not_effects(spark, tmp_path):
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 500 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(200).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6000).selectExpr("id AS event_id", "id % 7 AS user_id", "element_at(array('error', 'purchase', 'signup', 'click', 'view'), cast(1 + id % 5 AS int)) AS event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    _, made = joined(spark, lambda: assert_same(QUERIES["subject_effects"](spark, str(tmp_path)), SQL["subject_effects"], str(tmp_path)))
    assert made < 6000


def test_snapshots(spark):
    table = lambda v: spark.createDataFrame([("k", v)], "key string, v int")
    subjects = spark.createDataFrame([("p", "A"), ("p", "B")], "package string, symbol string")
    s = snapshot.Snapshot.observe(lambda: {"t": table(1)}, subjects)
    assert s.missing(subjects.limit(1)).count() == 1
    assert s.sibling(subjects.filter("symbol = 'A'")).subjects.count() == 1
    s.attach(("p", "A"), "M")
    with pytest.raises(snapshot.Sealed):
        s.attach(("p", "A"), "M")
    with pytest.raises(snapshot.SnapshotChanged):
        s.validate(lambda: {"t": table(2)})
    s.validate(lambda: {"t": table(1)})
    with pytest.raises(snapshot.Sealed):
        s.attach(("p", "B"), "M")
    values = iter([1, 2])
    with pytest.raises(snapshot.SnapshotChanged, match="t"):
        snapshot.Snapshot.observe(lambda: {"t": table(next(values))}, subjects)


def test_one_failure_denies_no_other():
    def batch(xs):
        if "bad" in xs:
            raise RuntimeError("no")
        return {x: (True, "") for x in xs}

    assert snapshot.isolated(["a", "bad"], batch) == {"a": (True, ""), "bad": (False, "observation analysis unavailable: no")}


def test_bounded_chains_keep_the_protected_link(spark):
    links = spark.createDataFrame([("c", i, i == 40) for i in range(50)] + [("d", 0, False)], "culprit string, seq int, protect boolean")
    got = explain.bounded(links).collect()
    c = sorted(r.seq for r in got if r.culprit == "c")
    assert c == [*range(23), 40] and {r.omitted for r in got if r.culprit == "c"} == {26}
    assert [r.omitted for r in got if r.culprit == "d"] == [0]


def test_bounded_chains_keep_the_last_link_where_none_is_protected_late(spark):
    links = spark.createDataFrame([("c", i, i == 4) for i in range(30)] + [("d", i, i == 23) for i in range(30)], "culprit string, seq int, protect boolean")
    got = explain.bounded(links).collect()
    assert sorted(r.seq for r in got if r.culprit == "c") == [*range(23), 29] and {r.omitted for r in got} == {6}
    assert sorted(r.seq for r in got if r.culprit == "d") == [*range(24)]


def test_parameters_and_movers_as_text(spark):
    df = spark.createDataFrame([("p\0f\x002",), ("p\0f",)], "k string").coalesce(1)
    assert [r.x for r in df.select(explain.param_display(F.col("k")).alias("x")).collect()] == ["p.f parameter 2", "p.f"]
    from evidentia.operators import verdict

    many = spark.createDataFrame([("a", x) for x in "vwxyz"] + [("b", x) for x in "xyz"], "k string, v string")
    assert {r.k: r.summary for r in verdict.first_three(many, "k", "v").collect()} == {"a": "v, w, x, and 2 more", "b": "x, y, z"}


def test_trail(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "x")], "own string, dep string")
    assert explain.trail(edges, "a", {"x"}) == ["a", "c", "x"] and explain.trail(edges, "a", {"z"}) == []


def test_callers_and_provenance(spark):
    edges = spark.createDataFrame([("r", "1", "f"), ("f", "2", "g"), ("i", "3", "g")], "caller string, site string, callee string")
    taken = spark.createDataFrame([("g", "i")], "fn string, by_fn string")
    got = {(r.caller, r.how) for r in attribution.callers(spark.createDataFrame([("g",)], "fn string"), edges, taken).collect()}
    assert got == {("f", "call"), ("i", "call"), ("i", "value")}
    roots = spark.createDataFrame([("A", "r", "subject"), ("A", "i", "startup")], "subject string, fn string, kind string")
    reached = spark.createDataFrame([("A", x) for x in "rfgi"], "subject string, fn string")
    cut = spark.createDataFrame([("f",)], "fn string")
    assert {(r.fn, r.provenance) for r in attribution.provenance(reached, roots, edges, cut).collect()} == {("r", "subject"), ("f", "subject"), ("i", "startup"), ("g", "startup")}


CPUINFO = "".join(f"processor\t: {i}\nmodel name\t: X 1\nphysical id\t: {i // 2}\ncore id\t: {i % 2 // 2}\n\n" for i in range(4))


def test_machine_facts(spark):
    r = spark.range(1).select(listings.cpu(F.lit(CPUINFO)).alias("c"), listings.memory_bytes(F.lit("MemTotal:   16 kB\n")).alias("m"), listings.cpu(F.lit("processor : 0\nmodel name : Y\n")).alias("d")).first()
    assert (tuple(r.c), r.m, tuple(r.d)) == (("X 1", 2, 4), 16384, ("Y", 1, 1))


def test_environment_entries_are_checked(spark):
    assert listings.env_snapshot(spark, "g", {"A": "1", "B": None}).count() == 2
    for bad in ({"": "x"}, {"a\nb": "x"}, {"a": "\0"}):
        with pytest.raises(ValueError):
            listings.env_snapshot(spark, "g", bad)


def test_files_are_hashed_in_place(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_bytes(b"x")
    r = listings.files(spark, str(tmp_path)).first()
    import hashlib

    assert (r.file, r.content_sha) == ("f.txt", hashlib.sha256(b"x").hexdigest())


def test_memo(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("v", F.col("k") * 2)

    memo = Memo(spark, str(tmp_path))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    assert {r.v for r in memo.split("proof", "s", keys(1, 2), ["k"], compute).collect()} == {2, 4}
    assert {r.v for r in memo.split("proof", "s", keys(2, 3), ["k"], compute).collect()} == {4, 6}
    assert calls == [2, 1] and memo.load("proof", "s").count() == 3 and memo.load("proof", "other") is None
    assert Memo(spark, None).load("proof", "s") is None


def test_streamed_logs_carry_their_directory(spark, tmp_path):
    from evidentia.streaming.testlogs import follow

    ops = "process string, seq bigint, op string, name string"
    batches = [[("p", 0, "open", "a"), ("p", 1, "chdir", "sub"), ("q", 0, "open", "b")], [("p", 2, "open", "c"), ("p", 3, "chdir", "/x"), ("p", 4, "open", "d")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, ops).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ops).parquet(str(tmp_path / "in"))
        q = follow(stream, "/pkg").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.process, r.seq): (r.cwd, r.after_chdir) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("p", 0): ("/pkg", False), ("p", 1): ("/pkg", False), ("q", 0): ("/pkg", False), ("p", 2): ("/pkg/sub", True), ("p", 3): ("/pkg/sub", True), ("p", 4): ("/x", True)}
