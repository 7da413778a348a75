import hashlib

import pytest
from pyspark.sql import functions as F

from evidentia.operators import guards, verdict

GUARDS = {"toolchain": "t", "build_config": "b", "machine": "", "runtime_config": ""}
BASE = {
    "rc": "C", "cc": "C", "rt": "T", "ct": "T", "strategy": verdict.STRATEGY, "manifest": "M", "digest": "D", "ok": True, "now": "D", "kind": 1, "rg": GUARDS, "cg": GUARDS,
    "external": False, "pure": False, "rtu": False, "rtr": "", "unv": False, "reason": "", "observed": False,
}
SCHEMA = "rc string, cc string, rt string, ct string, strategy string, manifest string, digest string, ok boolean, now string, kind int, rg struct<toolchain:string,build_config:string,machine:string,runtime_config:string>, cg struct<toolchain:string,build_config:string,machine:string,runtime_config:string>, external boolean, pure boolean, rtu boolean, rtr string, unv boolean, reason string, observed boolean"
MACHINE = GUARDS | {"machine": "m", "runtime_config": "r"}
GOLDEN = [
    ({}, "valid", ""),
    ({"rc": ""}, "stale", "closure"),
    ({"rc": None}, "stale", "closure"),
    ({"rt": ""}, "stale", "test variants"),
    ({"rt": None}, "stale", "test variants"),
    ({"ct": "U"}, "stale", "test variants"),
    ({"cc": "X"}, "stale", "closure"),
    ({"cc": None}, "stale", "closure"),
    ({"cc": "X", "ct": "U"}, "stale", "closure"),
    ({"strategy": "other"}, "stale", "dynamic-state strategy"),
    ({"strategy": None}, "stale", "dynamic-state strategy"),
    ({"rt": "", "strategy": "other"}, "stale", "test variants"),
    ({"manifest": ""}, "stale", "runtimeinputs"),
    ({"manifest": "", "digest": ""}, "valid", ""),
    ({"ok": False}, "stale", "runtimeinputs"),
    ({"ok": None}, "stale", "runtimeinputs"),
    ({"now": None}, "stale", "runtimeinputs"),
    ({"digest": "", "now": ""}, "stale", "runtimeinputs"),
    ({"cg": GUARDS | {"toolchain": "x", "build_config": "x"}}, "stale", "toolchain"),
    ({"rg": GUARDS | {"toolchain": ""}, "cg": GUARDS | {"toolchain": ""}}, "stale", "toolchain"),
    ({"cg": GUARDS | {"build_config": None}}, "stale", "buildconfig"),
    ({"cg": GUARDS | {"machine": "y"}}, "valid", ""),
    ({"kind": 2, "rg": MACHINE, "cg": MACHINE | {"machine": "y"}}, "stale", "machine"),
    ({"kind": 2, "rg": MACHINE, "cg": MACHINE | {"runtime_config": "y"}}, "stale", "runtimeconfig"),
    ({"kind": 2, "rg": MACHINE, "cg": MACHINE}, "valid", ""),
    ({"kind": 0}, "stale", "kind"),
    ({"external": True, "pure": True}, "unverifiable", "external directive"),
    ({"external": None}, "unverifiable", "external directive"),
    ({"external": True, "cg": GUARDS | {"toolchain": "x"}}, "stale", "toolchain"),
    ({"rtu": True}, "unverifiable", "runtime inputs"),
    ({"rtu": True, "rtr": "why"}, "unverifiable", "why"),
    ({"rtu": True, "pure": True}, "valid", ""),
    ({"unv": True}, "unverifiable", "external dependence"),
    ({"unv": None}, "unverifiable", "external dependence"),
    ({"unv": True, "pure": None, "reason": "net"}, "unverifiable", "net"),
    ({"unv": True, "observed": True, "reason": "net"}, "valid", ""),
    ({"unv": True, "observed": True, "reason": verdict.SHARED_STATE + ": v"}, "unverifiable", verdict.SHARED_STATE + ": v"),
    ({"unv": True, "observed": True, "manifest": "", "digest": "", "reason": "net"}, "unverifiable", "net"),
]


def test_golden_rows(spark):
    rows = [tuple((BASE | change).values()) for change, _, _ in GOLDEN]
    c = F.col
    v = F.coalesce(
        verdict.evidence(c("rc"), c("cc"), c("rt"), c("ct"), c("strategy")),
        verdict.known_guards(c("manifest"), c("digest"), c("ok"), c("now"), c("rg"), c("cg"), c("kind")),
        verdict.after_guards(c("external"), c("pure"), c("manifest"), c("rtu"), c("rtr"), c("unv"), c("reason"), c("observed")),
    )
    got = spark.createDataFrame(rows, SCHEMA).coalesce(1).select(v.alias("v")).collect()
    for (change, status, reason), r in zip(GOLDEN, got):
        assert (r.v.status, r.v.reason) == (status, reason), change


def test_a_code_result_with_machine_guards_is_an_error(spark):
    df = spark.createDataFrame([(1, GUARDS), (1, MACHINE), (2, MACHINE), (3, GUARDS), (None, GUARDS)], "k int, g struct<toolchain:string,build_config:string,machine:string,runtime_config:string>")
    assert [r.x for r in df.coalesce(1).select(guards.valid_kind(F.col("k"), F.col("g")).alias("x")).collect()] == [True, False, True, False, False]


def test_purity_needs_both_attributions(spark):
    df = spark.createDataFrame([("caller assertion", "source directive"), ("caller assertion", ""), (None, "caller assertion"), ("other", "caller assertion")], "r string, c string")
    assert [r.x for r in df.coalesce(1).select(verdict.pure_applies(F.col("r"), F.col("c")).alias("x")).collect()] == [True, False, False, False]


def test_proofs_are_sealed(spark):
    frame = lambda *p: "".join(f"{len(x)}:{x}" for x in p)
    seal = lambda ok, why: hashlib.sha256((frame("C", "caller assertion", verdict.PROOF_STRATEGY, "p", "S") + ok + frame(why)).encode()).hexdigest()[:32]
    proof = "struct<strategy:string,subject:struct<package:string,symbol:string>,observable:boolean,reason:string,evidence:string>"
    me = ("p", "S")
    rows = [
        ((verdict.PROOF_STRATEGY, me, True, "", seal("true", "")), me, True),
        ((verdict.PROOF_STRATEGY, me, False, "why", seal("false", "why")), me, True),
        ((verdict.PROOF_STRATEGY, me, True, "why", seal("true", "why")), me, False),
        ((verdict.PROOF_STRATEGY, me, True, "", "0" * 32), me, False),
        (("old", me, True, "", seal("true", "")), me, False),
        ((verdict.PROOF_STRATEGY, ("p", "T"), True, "", seal("true", "")), me, False),
        (None, me, False),
    ]
    df = spark.createDataFrame([(p, s) for p, s, _ in rows], f"proof {proof}, subject struct<package:string,symbol:string>").coalesce(1)
    assert [r.x for r in df.select(verdict.compatible_proof(F.col("proof"), F.lit("caller assertion"), F.col("subject"), F.lit("C")).alias("x")).collect()] == [x for *_, x in rows]
    # a proof made under another closure or another assertion proves nothing
    for assertion, closure in (("caller assertion", "D"), ("source directive", "C"), ("", "C"), (None, "C"), ("caller assertion", ""), ("caller assertion", None)):
        x = verdict.compatible_proof(F.col("proof"), F.lit(assertion).cast("string"), F.col("subject"), F.lit(closure).cast("string")).alias("x")
        assert not any(r.x for r in df.select(x).collect())


@pytest.mark.parametrize(("flags", "expected"), [((True, "a", "d", True, "b"), "external directive"), ((False, "a", "d", True, "b"), "a"), ((False, "", "d", True, "b"), "d"), ((False, "", "", True, "b"), "open subject world"), ((False, "", "", False, "b"), "b")])
def test_later_observations_override(spark, flags, expected):
    cols = [F.lit(x) for x in flags]
    assert spark.range(1).select(verdict.observed_reason(*cols).alias("x")).first().x == expected


def test_batch_check(spark):
    from evidentia.schemas import DDL

    rec = lambda s, **k: {"subject": ("p", s), "maximal_closure": "C", "test_variant_closure": "T", "observation_assertion": "", "proof": None, "guards": GUARDS, "purity_assertion": "", "vouches": [], "single_subject": [], "package_process": [], "dynamic_state_strategy": verdict.STRATEGY, "runtime_inputs": "", "runtime_digest": "", "result_kind": 1} | k
    rows = [rec("ok"), rec("gone"), rec("moved", maximal_closure="X"), rec("bad", guards=MACHINE), rec("in", runtime_inputs="M", runtime_digest="D"), rec("drift", runtime_inputs="N", runtime_digest="D")]
    recordings = spark.createDataFrame(rows, DDL["recordings"])
    current = spark.createDataFrame([(("p", s), "C", "T", GUARDS, "", False, "", False) for s in ("ok", "moved", "bad", "in", "drift")], "subject struct<package:string,symbol:string>, hash string, test_variants string, guards struct<toolchain:string,build_config:string,machine:string,runtime_config:string>, purity string, unverifiable boolean, reason string, external boolean")
    runtime = spark.createDataFrame([("M", True, "D", False, ""), ("N", True, "E", False, "")], "manifest string, ok boolean, digest string, unverifiable boolean, reason string")
    verdicts, errors = verdict.check(recordings, current, runtime)
    got = {r.subject.symbol: (r.verdict.status, r.verdict.reason) for r in verdicts.collect()}
    assert got == {"ok": ("valid", ""), "gone": ("stale", "closure"), "moved": ("stale", "closure"), "in": ("valid", ""), "drift": ("stale", "runtimeinputs")}
    assert [r.subject.symbol for r in errors.collect()] == ["bad"]
    assert {r.manifest for r in verdict.distinct_manifests(recordings).collect()} == {"M", "N"}
    closing = runtime.withColumn("digest", F.lit("Z")).filter("manifest = 'M'").unionByName(runtime.filter("manifest = 'N'"))
    after = verdict.demote_moved(verdicts, runtime, closing, recordings.select("subject", F.col("runtime_inputs").alias("manifest")))
    assert {r.subject.symbol for r in after.filter("verdict.status = 'stale'").collect()} == {"gone", "moved", "in", "drift"}
