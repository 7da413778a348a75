"""Attributed reachability over a call graph: static, dynamic, interface and runtime-type edges, one row a subject and
function. A subject's function values and call sites meet only with each other: every join carries the subject."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .fixpoint import gather, reach, rounds


def implements(type_methods: DataFrame, iface_methods: DataFrame) -> DataFrame:
    """(type, iface): relational division. The pairs considered share a method; those that lack one of the interface's are
    taken out; an interface without methods has no site that could call through it."""
    shared = type_methods.select("type", "method").distinct().join(iface_methods.select("iface", "method").distinct(), "method").groupBy("type", "iface").agg(F.count("*").alias("n"))
    whole = iface_methods.select("iface", "method").distinct().groupBy("iface").agg(F.count("*").alias("n"))
    return shared.join(whole, ["iface", "n"]).select("type", "iface")


def mask_conjunct(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(site, fn, mask): dynamic call sites and address-taken functions of one signature that share a subject's bit."""
    joined = sites.select("site", "sig", F.col("mask").alias("m1")).join(functions.select("fn", "sig", F.col("mask").alias("m2")), "sig")
    return joined.select("site", "fn", F.col("m1").bitwiseAND(F.col("m2")).alias("mask")).filter("mask <> 0")


def subject_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


@dataclasses.dataclass(frozen=True)
class Attributed:
    """reachable (subject, fn); targets (subject, site, fn): what each dynamic or interface call site resolves to, under the
    subjects that reach both the site and the function value or type."""

    reachable: DataFrame
    targets: DataFrame

    @property
    def resolved(self) -> DataFrame:
        """(subject, site) with a target."""
        return self.targets.select("subject", "site").distinct()


def analyze(roots: DataFrame, static_edges: DataFrame, address_taken: DataFrame, functions: DataFrame, dyn_sites: DataFrame, invoke_sites: DataFrame, make_iface: DataFrame, type_methods: DataFrame, type_components: DataFrame, iface_methods: DataFrame, max_rounds: int | None = None, **seeds) -> DataFrame:
    """(subject, fn) of attributed()."""
    return attributed(roots, static_edges, address_taken, functions, dyn_sites, invoke_sites, make_iface, type_methods, type_components, iface_methods, max_rounds, **seeds).reachable


def attributed(
    roots: DataFrame, static_edges: DataFrame, address_taken: DataFrame, functions: DataFrame, dyn_sites: DataFrame, invoke_sites: DataFrame, make_iface: DataFrame,
    type_methods: DataFrame, type_components: DataFrame, iface_methods: DataFrame, max_rounds: int | None = None,
    seed_values: DataFrame | None = None, seed_types: DataFrame | None = None, reflective: bool = False,
) -> Attributed:
    """What each subject reaches. roots: subject, fn. Facts come of reached functions, each once a subject: function values
    with their signature, signatures called, types made interface values (with all that they are made of), interface calls.
    A round joins new facts with all, and all with new ones, always by subject; rounds ask for signatures, not sites, so that
    a common signature costs a row a subject, and sites meet their targets once, at the end.

    seed_values (subject, fn), seed_types (subject, type): candidates established elsewhere; they reach nothing by
    themselves. reflective: the program can call any function value by reflection."""
    calls = pin(static_edges.select(F.col("caller").alias("fn"), F.col("callee").alias("to")).distinct(), "calls")
    signature = functions.select(F.col("fn").alias("value"), "sig")
    parts = type_components.select(F.col("type").alias("src"), F.col("component").alias("dst"))
    made_types = make_iface.select("type") if seed_types is None else make_iface.select("type").unionByName(seed_types.select("type"))
    whole = pin(reach(parts, made_types.select("type", F.col("type").alias("node")).distinct(), ["type"]), "whole")
    # what a function brings along, all kinds in one table: a round joins and writes facts once
    of_function = {
        "values": address_taken.select(F.col("by_fn").alias("fn"), F.col("fn").alias("value")).join(signature, "value").select("fn", "value", "sig"),
        "sigs": dyn_sites.select("fn", "sig"),
        "types": make_iface.join(whole, "type").select("fn", F.col("node").alias("type")),
        "calls": invoke_sites.select("fn", "iface", "method"),
    }
    kinds = {c: t for df in of_function.values() for c, t in df.dtypes if c != "fn"}

    def padded(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(key, F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.filter(F.col("kind") == kind).select("subject", *[c for c in of_function[kind].columns if c != "fn"])

    facts = pin(reduce(DataFrame.unionByName, [padded(v, k, "fn") for k, v in of_function.items()]).distinct(), "facts")
    bridge = pin(implements(type_methods, iface_methods), "implements")
    methods = pin(type_methods.select("type", "method", F.col("impl_fn").alias("to"), "exported").distinct(), "methods")

    def through(calls_: DataFrame, types_: DataFrame) -> DataFrame:
        return calls_.join(bridge, "iface").join(types_, ["subject", "type"]).join(methods.drop("exported"), ["type", "method"])

    delta = pin(roots.select("subject", "fn").distinct(), "reach")
    reached = delta
    known = delta.join(facts, "fn").drop("fn").limit(0)
    seeds = []
    if seed_values is not None:
        seeds.append(padded(seed_values.select("subject", F.col("fn").alias("value")).join(signature, "value"), "values", "subject"))
    if seed_types is not None:
        seeds.append(padded(seed_types.join(whole, "type").select("subject", F.col("node").alias("type")), "types", "subject"))
    for n in rounds("attributed", max_rounds):
        came = reduce(DataFrame.unionByName, [delta.join(facts, "fn").drop("fn"), *([] if n else seeds)]).distinct()
        held = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in known.columns])
        new = pin(came.join(held, same, "left_anti") if n else came, "new")
        both = gather(known, new, n) if n else new
        ways = [
            delta.join(calls, "fn").select("subject", "to"),
            of(new, "values").join(of(both, "sigs"), ["subject", "sig"]).select("subject", F.col("value").alias("to")),
            of(known, "values").join(of(new, "sigs"), ["subject", "sig"]).select("subject", F.col("value").alias("to")),
            through(of(new, "calls"), of(both, "types")).select("subject", "to"),
            through(of(known, "calls"), of(new, "types")).select("subject", "to"),
            # what reflection may call: exported methods of types that became interface values
            of(new, "types").join(methods.filter("exported"), "type").select("subject", "to"),
        ]
        if reflective:
            ways.append(of(new, "values").select("subject", F.col("value").alias("to")))
        came = reduce(DataFrame.unionByName, ways).select("subject", F.col("to").alias("fn")).distinct()
        delta = pin(came.join(reached, ["subject", "fn"], "left_anti"), "reach")
        known = both
        if delta.isEmpty():
            break
        reached = gather(reached, delta, n)
    at = lambda sites: reached.join(sites, "fn").drop("fn").distinct()
    dynamic = at(dyn_sites.select("fn", "site", "sig")).join(of(known, "values"), ["subject", "sig"]).select("subject", "site", F.col("value").alias("fn"))
    dispatched = through(at(invoke_sites.select("fn", "site", "iface", "method")), of(known, "types")).select("subject", "site", F.col("to").alias("fn"))
    return Attributed(reached, pin(dynamic.unionByName(dispatched).distinct(), "targets"))


def provenance(reached: DataFrame, roots: DataFrame, static_edges: DataFrame, cut: DataFrame | None = None, targets: DataFrame | None = None, sites: DataFrame | None = None, functions: DataFrame | None = None) -> DataFrame:
    """(subject, fn, provenance): which of a subject's kinds of root leads to each function, by static calls and by the targets
    (subject, site, fn) that attributed() resolved for the subject at its sites (site, fn: the function around it).

    functions (fn, harness, user, std, runner): a frame of the test harness is passed through but is not in the result; from
    it only harness functions are called, and of targets those that are harness, user code or not standard; a call from
    outside into the harness goes there alone; a test runner is not entered. A function in cut (fn) is reached but not
    passed through."""
    here = reached.select("subject", "fn").distinct()
    flags = {k: F.lit(False) for k in ("harness", "user", "std", "runner")}
    if functions is not None:
        kinds = functions.select("fn", *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in flags]).distinct()
    else:
        kinds = here.select("fn").distinct().select("fn", *[v.alias(k) for k, v in flags.items()])
    of = lambda side, *names: kinds.select(F.col("fn").alias(side), *[F.col(k).alias(f"{side}_{k}") for k in names])
    steps = here.join(static_edges.select(F.col("caller").alias("fn"), F.col("callee").alias("dst")).distinct(), "fn").withColumnRenamed("fn", "src").withColumn("open", F.lit(False))
    if targets is not None:
        by_site = sites.select("site", F.col("fn").alias("src")).distinct()
        entered = static_edges.select("site", F.col("callee").alias("callee")).join(of("callee", "harness").filter("callee_harness"), "callee").select("site").distinct()
        found = targets.select("subject", "site", F.col("fn").alias("dst")).join(by_site, "site").join(of("src", "harness"), "src", "left")
        # a site that calls the harness from outside goes nowhere else
        found = found.join(entered.withColumn("into", F.lit(True)), "site", "left").filter("into is null or coalesce(src_harness, false)")
        steps = steps.unionByName(found.select("subject", "src", "dst").withColumn("open", F.lit(True)))
    steps = steps.join(of("src", "harness"), "src", "left").join(of("dst", "harness", "user", "std", "runner"), "dst", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    go = ~yes("src_harness") | yes("dst_harness") | (F.col("open") & (yes("dst_user") | ~yes("dst_std")))
    steps = steps.filter(go & ~yes("dst_runner")).select("subject", "src", "dst").distinct()
    steps = steps.join(here.withColumnRenamed("fn", "dst"), ["subject", "dst"], "left_semi")
    if cut is not None:
        steps = steps.join(cut.select(F.col("fn").alias("src")), "src", "left_anti")
    begun = roots.select("subject", F.col("kind").alias("provenance"), F.col("fn").alias("node")).join(here.withColumnRenamed("fn", "node"), ["subject", "node"], "left_semi")
    walked = reach(steps, begun, ["subject", "provenance"], edge_keys=["subject"]).withColumnRenamed("node", "fn")
    return walked.join(kinds.filter("harness").select("fn"), "fn", "left_anti").select("subject", "fn", "provenance")


def rooted_package(rooted: DataFrame, complete: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of a package's rooted functions, and whether all of its roots are complete: true of none."""
    functions = rooted.select("package", "fn").distinct()
    done = complete.groupBy("package").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))
    return functions, subjects.select("package").distinct().join(done, "package", "left").select("package", F.coalesce("complete", F.lit(True)).alias("complete"))


def callers(candidates: DataFrame, static_edges: DataFrame, address_taken: DataFrame) -> DataFrame:
    """(fn, caller, how): every reference to the candidate functions (fn)."""
    called = static_edges.select(F.col("callee").alias("fn"), "caller", F.lit("call").alias("how"))
    valued = address_taken.select("fn", F.col("by_fn").alias("caller"), F.lit("value").alias("how"))
    return candidates.select("fn").distinct().join(called.unionByName(valued).distinct(), "fn")
