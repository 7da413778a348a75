import pytest
from pyspark.sql import functions as F

from evidentia.engine import Engine, OptionError, Options, normalise_env
from evidentia.functions import rules
from evidentia.operators import verdict
from evidentia.schemas import DDL

GUARDS = {"toolchain": "t", "build_config": "b", "machine": "", "runtime_config": ""}


@pytest.mark.parametrize("bad", [{"build_inputs": ("-race",)}, {"build_flags": ("race",)}, {"exclusions": ("/",)}, {"env": {"A=B": "x"}}, {"env": {"GOOS": "linux"}, "producer_env": {"GOOS": "js"}}])
def test_options_are_checked(bad):
    with pytest.raises(OptionError):
        Options(**bad)


def test_environments():
    assert normalise_env(["B=2", "A=1=1"]) == {"A": "1=1", "B": "2"}
    for bad in (["A"], ["A=1", "A=2"], ["=x"], ["A=\0"]):
        with pytest.raises(OptionError):
            normalise_env(bad)
    assert Options(env={"X": "1"}, producer_env={"X": "2"}).scope != Options(single_subject=True).scope


def test_generators_directives_and_includes(spark):
    f = lambda x: spark.range(1).select(rules.generated_by(F.lit(x)).alias("g")).first().g
    assert f("// Code generated by protoc-gen-go. DO NOT EDIT.") == "protoc-gen-go"
    assert f("// Code generated by protoc-gen-go-grpc v1. DO NOT EDIT. ") == "protoc-gen-go-grpc"
    assert f("// Code generated by protoc-gen-gogo. DO NOT EDIT.") == f("// Code generated by protoc-gen-go. EDIT.") == f("// Code generated by protoc-gen-go") == ""
    r = spark.range(1).select(rules.has_directive(F.array(F.lit("//x:pure")), "//x:pure").alias("a"), rules.has_directive(F.array(F.lit("//x:pure ")), "//x:pure").alias("b"), rules.includes(F.lit('#include "a.h"\n  # include <b.h>\n// #include "c.h"\n/* #include "d.h" */\n#inc\\\nlude "e.h"\n')).alias("i")).first()
    assert (r.a, r.b, r.i) == (True, False, ['"a.h"', "<b.h>", '"e.h"'])


def test_transactions(spark):
    subjects = spark.createDataFrame([("p", "A"), ("p", "B")], "package string, symbol string")
    tables = lambda: {"closures": spark.createDataFrame([("p", "A", "C", "T"), ("p", "B", "C", "T")], "package string, symbol string, hash string, test_variants string"), "guards": spark.createDataFrame([("t", "b", "m", "r")], "toolchain string, build_config string, machine string, runtime_config string")}
    phases = []
    engine = Engine(Options(progress=lambda phase, _: phases.append(phase), assume_pure=lambda p, s: s == "A"))
    rec = engine.capture(tables, subjects, 1)
    assert {(r.subject.symbol, r.maximal_closure, r.guards.machine) for r in rec.collect()} == {("A", "C", ""), ("B", "C", "")}
    full = [{"subject": ("p", s), "maximal_closure": "C", "test_variant_closure": "T", "observation_assertion": "", "proof": None, "guards": GUARDS, "purity_assertion": "", "vouches": [], "single_subject": [], "package_process": [], "dynamic_state_strategy": verdict.STRATEGY, "runtime_inputs": m, "runtime_digest": d, "result_kind": 1} for s, m, d in (("A", "", ""), ("B", "M", "D"))]
    recordings = spark.createDataFrame(full, DDL["recordings"])
    current = lambda: {"current": spark.createDataFrame([(("p", s), "C", "T", GUARDS, "", False, "", False) for s in "AB"], "subject struct<package:string,symbol:string>, hash string, test_variants string, guards struct<toolchain:string,build_config:string,machine:string,runtime_config:string>, purity string, unverifiable boolean, reason string, external boolean")}
    looks = iter(["D", "E"])

    def runtime(manifests):
        return manifests.select("manifest", F.lit(True).alias("ok"), F.lit(next(looks)).alias("digest"), F.lit(False).alias("unverifiable"), F.lit("").alias("reason"))

    verdicts, errors = engine.check(current, recordings, runtime)
    assert {(r.subject.symbol, r.verdict.status) for r in verdicts.collect()} == {("A", "valid"), ("B", "stale")} and errors.count() == 0
    assert phases == ["observe", "observe", "runtime", "runtime"]
    facts = spark.createDataFrame([("p", "A", "pure", False, ""), ("p", "B", "pure", False, ""), ("p", "C", "", True, ""), ("p", "A2", None, False, "")], "package string, symbol string, directive string, external boolean, ambiguous string")
    assert {r.symbol: r.purity for r in engine.purity(facts).collect()} == {"A": "caller assertion and source directive", "B": "source directive", "C": "", "A2": ""}


def test_options_reach_the_operators(spark, tmp_path):
    from evidentia.operators.fixpoint import BudgetExhausted, reach

    e = Engine(Options(vouches=("v1",), single_subject=True, exclusions=("/a/b",), env={"CC": "cc", "GOGC": "1"}, producer_env={"CC": "cc", "GOGC": "2"}, build_inputs=("x",), memo_root=f"file://{tmp_path}", budget=0))
    paths = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",)], "path string")
    assert [r.path for r in e.observed(paths).collect()] == ["/a/bc"] and Engine().observed(paths).count() == 3
    candidates = spark.createDataFrame([("p", "pinned", "m", "v1", "escape"), ("p", "pinned", "m", "v2", "escape"), ("q", "mutable_local", None, "v3", "escape")], "pkg string, package_class string, pin string, var_key string, class string")
    none, said = spark.createDataFrame([], "pin string, var_key string"), spark.createDataFrame([("v3",)], "var_key string")
    assert {(r.var_key, r.channel) for r in e.discharges(candidates, none, said).collect()} == {("v1", "vouch"), ("v3", "directive")}
    assert Engine().discharges(candidates, none, said).count() == 0
    frame = lambda **env: spark.range(1).select(Engine(Options(**env)).build_config().alias("b"), Engine(Options(**env)).runtime_config().alias("r")).first()
    one, two = frame(env={"CC": "cc"}), frame(env={"CC": "gcc"})
    assert one.b != two.b and one.r == two.r and frame(env={"GOGC": "1"}).r != frame(env={"GOGC": "1"}, producer_env={"GOGC": "2"}).r != frame().r
    asked = []

    def compute(rows):
        asked.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("v", rows.k * 2)

    keep = Engine(Options(memo_root=f"file://{tmp_path}/memo"))
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    assert {(r.k, r.v) for r in keep.remembered(rows(1, 2), "double", ["k"], compute).collect()} == {(1, 2), (2, 4)}
    assert {(r.k, r.v) for r in keep.remembered(rows(2, 3), "double", ["k"], compute).collect()} == {(2, 4), (3, 6)} and asked == [[1, 2], [3]]
    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    with pytest.raises(BudgetExhausted):
        e.remembered(rows(1), "reach", ["node"], lambda r: reach(edges, r.withColumnRenamed("k", "node")))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from evidentia.session import shared_dir

    named = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId="x", getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}))
    assert shared_dir(named("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://h"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(named(master, None))
    assert shared_dir(named("local[4]", None)).startswith("file://")


def test_only_absence_of_the_subpackage_is_passed_over(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "evidentia.llm.queries", None)
    assert not set(__spark_entry__.queries()) & {"pipeline", "op1_arc_to_warc"}
