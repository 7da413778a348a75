import random

import pytest
from metrics import joined
from pyspark.sql import functions as F

from evidentia.operators import attribution, dynstate, fixpoint


def pairs(spark, rows, names="own string, dep string"):
    return spark.createDataFrame(rows, names)


def nodes(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "node string")


def got(df, col="node"):
    return {r[col] for r in df.collect()}


def test_least_proof(spark):
    deps = pairs(spark, [("a", "x"), ("b", "a"), ("c1", "c2"), ("c2", "c1"), ("d", "absent"), ("e", "x"), ("e", "d")])
    assert got(fixpoint.least_proof(nodes(spark, ["x"]), deps)) == {"x", "a", "b"}
    listed = fixpoint.least_proof(nodes(spark, []), deps, nodes(spark, ["x", "a", "free"]))
    assert got(listed) == {"x", "a", "free"}


def test_either_grade_satisfies(spark):
    facts = spark.createDataFrame(
        [("p", "paramLeakFree", "x", None), ("p", "paramRetentionFreeDeps", "r", "x"), ("p", "paramRetentionFree", "y", None), ("p", "paramRetentionFreeDeps", "r2", "y"), ("p", "paramRetentionFreeDeps", "r3", "r4")],
        "pkg string, kind string, var_key string, dep_key string",
    ).withColumn("malformed", F.lit(False))
    assert got(dynstate.retention_free(facts, dynstate.leak_free(facts))) == {"y", "r", "r2"}


def test_breaks_fell_chains_and_spare_cycles(spark):
    deps = pairs(spark, [("a", "b"), ("b", "c"), ("l1", "l2"), ("l2", "l1"), ("u", "nowhere"), ("v", "u")])
    declared = nodes(spark, ["a", "b", "c", "l1", "l2", "u", "v"])
    assert got(fixpoint.fallen(nodes(spark, ["c"]), deps, declared)) == {"a", "b", "c", "u", "v"}


def test_opacity_needs_every_fact(spark):
    rows = [("p", "v1", "declares", "x", None), ("p", "v1", "opaque", "x", None), ("p", "v2", "declares", "x", None), ("p", "v1", "declares", "y", None), ("p", "v1", "opaque", "y", None), ("q", "v1", "declares", "z", None), ("q", "v1", "opaque", "z", None), ("q", "v1", "opaqueDeps", "z", "x")]
    facts = spark.createDataFrame(rows, "pkg string, variant string, kind string, var_key string, dep_key string").withColumn("malformed", F.lit(False))
    assert got(dynstate.opaque(facts), "var_key") == {"y"}


def test_init_flow(spark):
    refs = spark.createDataFrame([("f", "init"), ("g", "f"), ("h", "g"), ("h", "prog"), ("k", "lit:h"), ("s", "s"), ("m", "lit:nobody")], "callee string, region string")
    assert got(fixpoint.init_only(refs)) == {"f", "g"}
    assert got(fixpoint.init_reach(refs)) == {"f", "g", "h", "k"}


def test_reach_in_rows_and_masks(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
    seeds = [(s, rng.randrange(40)) for s in range(5)]
    expected = set()
    for s, n in seeds:
        todo = [n]
        while todo:
            x = todo.pop()
            if (s, x) not in expected:
                expected.add((s, x))
                todo += [b for a, b in edges if a == x]
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    seed = spark.createDataFrame(seeds, "subject int, node int")
    assert {(r.subject, r.node) for r in fixpoint.reach(e, seed, ["subject"]).collect()} == expected
    masks = fixpoint.reach_masks(e, seed.select("node", attribution.subject_bit(F.col("subject") + 59).alias("mask")))
    assert {r.node for r in masks.collect()} == {n for _, n in expected}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 20)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(15)]
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.root for r in fixpoint.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == label


def graph(spark, **tables):
    ddl = {"roots": "subject string, fn string", "static_edges": "caller string, site string, callee string", "address_taken": "fn string, by_fn string", "functions": "fn string, sig string", "dyn_sites": "site string, fn string, sig string", "invoke_sites": "site string, fn string, iface string, method string", "make_iface": "fn string, type string", "type_methods": "type string, method string, impl_fn string, exported boolean", "type_components": "type string, component string", "iface_methods": "iface string, method string"}
    seeds = {"seed_values": "subject string, fn string", "seed_types": "subject string, type string"}
    given = {k: spark.createDataFrame(tables.get(k, []), v) for k, v in ddl.items()} | {k: spark.createDataFrame(tables[k], v) for k, v in seeds.items() if k in tables}
    found = attribution.attributed(**given, reflective=tables.get("reflective", False))
    if tables.get("targets"):
        return {(r.subject, r.site, r.fn) for r in found.targets.collect()}
    return {(r.subject, r.fn) for r in found.reachable.collect()}


def test_function_values_and_sites_of_different_subjects_do_not_meet(spark):
    found = graph(spark, roots=[("A", "a"), ("B", "b"), ("C", "a"), ("C", "b")], functions=[("v", "func()")], address_taken=[("v", "a")], dyn_sites=[("s", "b", "func()")])
    assert found == {("A", "a"), ("B", "b"), ("C", "a"), ("C", "b"), ("C", "v")}


def test_targets_are_kept_by_subject_and_site(spark):
    facts = {
        "roots": [("A", "a"), ("B", "b")], "static_edges": [("a", "1", "h"), ("b", "2", "h")], "functions": [("v", "f"), ("w", "f"), ("x", "g")],
        "address_taken": [("v", "a"), ("w", "b"), ("x", "a")], "dyn_sites": [("s", "h", "f"), ("t", "nowhere", "f")], "invoke_sites": [("i", "h", "I", "Do")],
        "make_iface": [("b", "T")], "type_methods": [("T", "Do", "T.Do", False)], "iface_methods": [("I", "Do")],
    }
    assert graph(spark, **facts, targets=True) == {("A", "s", "v"), ("B", "s", "w"), ("B", "i", "T.Do")}
    assert graph(spark, **facts) == {("A", "a"), ("A", "h"), ("A", "v"), ("B", "b"), ("B", "h"), ("B", "w"), ("B", "T.Do")}
    # a program that calls by reflection can call every function value
    assert ("A", "x") in graph(spark, **facts, reflective=True)


def test_seeds_reach_nothing_by_themselves(spark):
    facts = {"roots": [("A", "a"), ("B", "b")], "functions": [("v", "f"), ("u", "g")], "dyn_sites": [("s", "a", "f")], "invoke_sites": [("i", "a", "I", "Do")], "type_methods": [("T", "Do", "T.Do", False), ("E", "Do", "E.Do", False)], "type_components": [("T", "E")], "iface_methods": [("I", "Do")]}
    assert graph(spark, **facts) == {("A", "a"), ("B", "b")}
    seeded = facts | {"seed_values": [("A", "v"), ("A", "u"), ("B", "v")], "seed_types": [("A", "T"), ("B", "T")]}
    assert graph(spark, **seeded) == {("A", "a"), ("A", "v"), ("A", "T.Do"), ("A", "E.Do"), ("B", "b")}


def test_provenance_passes_through_targets_and_the_harness(spark):
    roots = spark.createDataFrame([("A", "init", "startup"), ("A", "Test", "subject")], "subject string, fn string, kind string")
    reached = spark.createDataFrame([("A", x) for x in ("init", "Test", "Run", "callback", "inner", "fmt.p", "v", "M.Run", "after")], "subject string, fn string")
    edges = spark.createDataFrame([("Test", "1", "Run"), ("Run", "2", "inner"), ("Run", "3", "fmt.p"), ("init", "4", "M.Run"), ("M.Run", "5", "after")], "caller string, site string, callee string")
    targets = spark.createDataFrame([("A", "6", "callback"), ("A", "6", "fmt.p"), ("A", "7", "v"), ("B", "7", "after")], "subject string, site string, fn string")
    sites = spark.createDataFrame([("6", "Run"), ("7", "init")], "site string, fn string")
    kinds = [("Test", False, True, False, False), ("Run", True, False, True, False), ("inner", True, False, True, False), ("callback", False, True, False, False), ("fmt.p", False, False, True, False), ("M.Run", True, False, True, True)]
    functions = spark.createDataFrame(kinds, "fn string, harness boolean, user boolean, std boolean, runner boolean")
    got = {(r.fn, r.provenance) for r in attribution.provenance(reached, roots, edges, targets=targets, sites=sites, functions=functions).collect()}
    # the harness itself is left out, its callback is not, its own standard calls are; a runner is not entered
    assert got == {("init", "startup"), ("v", "startup"), ("Test", "subject"), ("callback", "subject")}


def test_a_budget_in_time(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    seed = spark.createDataFrame([(0,)], "node int")
    with fixpoint.budget(0), pytest.raises(fixpoint.BudgetExhausted):
        fixpoint.reach(e, seed)
    with fixpoint.budget(600):
        assert fixpoint.reach(e, seed).count() == 7


def test_interfaces_dispatch_by_methods(spark):
    found = graph(
        spark, roots=[("A", "main")], static_edges=[("main", "1", "use")], make_iface=[("main", "T"), ("main", "U")], invoke_sites=[("2", "use", "I", "Do")],
        type_methods=[("T", "Do", "T.Do", False), ("T", "Undo", "T.Undo", False), ("U", "Do", "U.Do", False), ("E", "Show", "E.Show", True)], iface_methods=[("I", "Do"), ("I", "Undo")], type_components=[("T", "E")],
    )
    assert found == {("A", "main"), ("A", "use"), ("A", "T.Do"), ("A", "E.Show")}


def test_vacuous_completeness(spark):
    done = spark.createDataFrame([("p", True), ("p", False), ("q", True)], "package string, complete boolean")
    _, c = attribution.rooted_package(spark.createDataFrame([], "package string, fn string"), done, spark.createDataFrame([("p",), ("q",), ("r",)], "package string"))
    assert {r.package: r.complete for r in c.collect()} == {"p": False, "q": True, "r": True}


def test_rounds_are_bounded(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    with pytest.raises(fixpoint.BudgetExhausted):
        fixpoint.reach(e, spark.createDataFrame([(0,)], "node int"), max_rounds=2)


def test_buckets_need_pinned_cones(spark):
    import hashlib

    rows = [("a", "pinned", "m@1"), ("b", "pinned", "n@1"), ("c", "mutable_local", None), ("d", "pinned", "o@1"), ("e", "pinned", "o@1")]
    nodes_ = spark.createDataFrame(rows, "import_path string, class string, pin string")
    imports = spark.createDataFrame([("a", "b"), ("d", "c"), ("e", "b")], "import_path string, imported string")
    found = {r.pin: r.bucket for r in dynstate.buckets(nodes_, imports).collect()}
    # e alone would have a key, but its module's other package reaches local code
    signature = lambda *pins: hashlib.sha256(f"[{' '.join(chr(34) + p + chr(34) for p in pins)}]".encode()).hexdigest()[:16]
    assert found == {"m@1": f"m@1|{signature('m@1', 'n@1')}", "n@1": f"n@1|{signature('n@1')}"}


def test_populations(spark):
    defer = spark.createDataFrame([("T", "0", "p1"), ("T", "1", "p2"), ("U", "0", "p1"), ("V", "0", "p1")], "carrier string, position string, dep_key string")
    poison = spark.createDataFrame([("U", None)], "carrier string, position string")
    made_by = spark.createDataFrame([("V", "U")], "carrier string, by string")
    assert {(r.carrier, r.position) for r in dynstate.populations(defer, poison, made_by, nodes(spark, ["p1"])).collect()} == {("T", "0")}


def test_long_paths_are_flattened_and_swept(spark):
    from evidentia.session import sweep

    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    found = fixpoint.reach(e, spark.createDataFrame([(0,)], "node int"))
    assert found.count() == 41 and found.explain is not None
    assert found._jdf.queryExecution().analyzed().toString().count("Relation") <= fixpoint.FLATTEN + 2
    assert sweep(spark) > 40 and sweep(spark) == 0


def unreachable(spark, found, sites, rooted, complete):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    return dynstate.unreachable_discharges(frame(found, "subject int, var_key string"), frame(sites, "var_key string, fn int"), frame(rooted, "subject int, fn int"), frame(complete, "subject int, complete boolean"))


def test_unreachable_discharges_by_plain_loops(spark):
    rng = random.Random(5)
    for _ in range(3):
        few = rng.choice([3, 30])
        found = [(rng.choice([None, *range(20)]), rng.choice([None, *"abcdef"])) for _ in range(80)]
        sites = [(rng.choice([None, *"abcde"]), rng.choice([None, *range(60)])) for _ in range(60)] + [("c", None), ("d", 77)]
        rooted = [(rng.choice([None, *range(18)]), rng.choice([None, *range(60)])) for _ in range(few * 18)] + [(3, None)] * 2
        complete = [(i, rng.choice([True, True, False, None])) for i in range(20)]
        at = {v: {f for w, f in sites if w == v} for v, _ in sites if v is not None}
        own = {s: {f for r, f in rooted if r == s and f is not None} for s in range(20)}
        want = {(s, v) for s, v in found if s is not None and dict(complete)[s] and v in at and not at[v] & own[s]}
        rows = [tuple(r) for r in unreachable(spark, found, sites, rooted, complete).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_unreachable_discharges_multiply_neither_sites_nor_functions(spark):
    # 300 subjects of 3 functions and a variable of 2,000 sites; a subject of 2,000 functions and 300 variables of 3 sites
    found = [(s, "wide") for s in range(300)] + [(999, f"v{i}") for i in range(300)]
    sites = [("wide", f) for f in range(2000)] + [(f"v{i}", 50_000 + 3 * i + j) for i in range(300) for j in range(3)]
    rooted = [(s, 10_000 + 3 * s + j) for s in range(300) for j in range(3)] + [(999, 50_000 + 7 * f) for f in range(-1000, 1000)]
    rows, made = joined(spark, lambda: unreachable(spark, found, sites, rooted, [(s, True) for s in (*range(300), 999)]).collect())
    hit = {f"v{i}" for i in range(300) if any((3 * i + j) % 7 == 0 for j in range(3))}
    assert {tuple(r) for r in rows} == {(s, v) for s, v in found if v not in hit}
    assert made < 20_000
