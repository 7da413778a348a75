"""More queries of the catalogue: operators of closures, proofs, manifests, brackets, shared state, effects and verdicts, each
over the driver's tables in the shape that it takes, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine, Options
from ..functions import digest, paths, rules
from ..operators import attribution, bracket, closure, dynstate, effects, explain, fixpoint, guards, inputs, ledger, manifest, snapshot, verdict
from .catalogue import query, t, text




def _pick(key, *values):
    """The value of the key's remainder."""
    out = F.when(key % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key % len(values) == i, v)
    return out


# ---- functions


@query("""SELECT page_id, resolved, page_id % 4 IN (0, 2) AS parent, len(string_split(resolved, '/')) - 1 AS n_parts,
  CASE WHEN starts_with(resolved, '/cwd/z/') THEN resolved[8:] END AS rel, page_id % 4 = 0 AS scratch, page_id % 3 = 0 AS std,
  CASE page_id % 4 WHEN 1 THEN '/abs/p' || page_id WHEN 2 THEN NULL WHEN 0 THEN '/cwd/z/y' || page_id ELSE '/cwd/z/q/r' || page_id END AS placed
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/cwd/z/y' || page_id WHEN 1 THEN '/abs/p' || page_id WHEN 2 THEN '/cwd/up' || page_id ELSE '/cwd/z/q/r' || page_id END AS resolved FROM pages)""")
def path_functions(spark, d):
    k, n = F.col("page_id"), text("page_id")
    name = _pick(k, F.concat(F.lit("x/../y"), n), F.concat(F.lit("/abs//p"), n, F.lit("/.")), F.concat(F.lit("../up"), n), F.concat(F.lit("./q/./r"), n))
    rows = t(spark, d, "pages").select("page_id", name.alias("name"), paths.resolve(F.lit("/cwd/z"), name).alias("resolved"))
    package = F.when(k % 3 == 0, F.lit("encoding/json")).otherwise(F.lit("a.example/x"))
    return rows.select(
        "page_id", "resolved", paths.has_parent(F.col("name")).alias("parent"), F.size(paths.components(F.col("resolved"))).alias("n_parts"),
        paths.rel_under(F.lit("/cwd/z"), F.col("resolved")).alias("rel"), paths.in_namespace(F.col("resolved"), F.lit("/cwd/z"), F.lit("y"), F.lit("")).alias("scratch"),
        paths.std_import(package).alias("std"), paths.materialize(F.lit("/cwd/z"), F.when(paths.is_abs(F.col("name")), "abs").otherwise("rel"), F.col("name")).alias("placed"),
    )


@query("""SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 2 AS root, CASE p_partkey % 3 WHEN 0 THEN 'protoc-gen-go' WHEN 1 THEN 'protoc-gen-go-grpc' ELSE '' END AS generator,
  p_partkey % 5 = 1 AS pure, p_partkey % 4 = 1 AS source_only, p_partkey % 4 = 2 AS external, CASE p_partkey % 3 WHEN 0 THEN 'cgo' WHEN 1 THEN 'syso objects,assembly' ELSE '' END AS native,
  CASE p_partkey % 2 WHEN 0 THEN '"a.h",<b.h>' ELSE '' END AS included FROM part""")
def symbol_rules(spark, d):
    k, n = F.col("p_partkey"), text("p_partkey")
    name = _pick(k, F.concat(F.lit("Test"), n), F.lit("Testing"), F.lit("Fuzz"), F.lit("helper"))
    line = _pick(k, F.lit("// Code generated by protoc-gen-go. DO NOT EDIT."), F.lit("// Code generated by protoc-gen-go-grpc. DO NOT EDIT."), F.lit("// Code generated by protoc-gen-gofast. DO NOT EDIT."))
    documented = F.array(F.lit("// about"), F.when(k % 5 == 1, F.lit("//pure")).when(k % 5 == 2, F.lit("// pure")).otherwise(F.lit("//purest")))
    package = _pick(k, F.lit("os"), F.lit("strings"), F.lit("net/http"), F.lit("a.example/x"))
    none, one = F.array().cast("array<string>"), F.array(F.lit("f"))
    kinds = {"cgo_files": F.when(k % 3 == 0, one).otherwise(none), "syso_files": F.when(k % 3 == 1, one), "s_files": F.when(k % 3 == 1, one).otherwise(none)}
    c = F.when(k % 2 == 0, F.lit('/* #include "no.h" */\n#include "a.h"\n# \\\ninclude <b.h> // x\n')).otherwise(F.lit("// #include <c.h>\nint x;"))
    return t(spark, d, "part").withColumns(kinds).select(
        "p_partkey", rules.harness_root(name).alias("root"), rules.generated_by(line).alias("generator"), rules.has_directive(documented, "//pure").alias("pure"),
        rules.source_only(package).alias("source_only"), rules.always_external(package).alias("external"), F.array_join(closure.native_effects(), ",").alias("native"),
        F.array_join(rules.includes(c), ",").alias("included"),
    )


_BUILD = ("CC", "CGO_CFLAGS", "CGO_CPPFLAGS", "CGO_CXXFLAGS", "CGO_ENABLED", "CGO_FFLAGS", "CGO_LDFLAGS", "CXX", "GO386", "GOAMD64", "GOARCH", "GOARM", "GOARM64", "GOEXPERIMENT", "GOFLAGS", "GOOS", "PKG_CONFIG", "PKG_CONFIG_LIBDIR", "PKG_CONFIG_PATH", "PKG_CONFIG_SYSROOT_DIR")
_BUILD_SQL = " || ".join(f"'env {len(k)}:{k} ' || octet_length(encode({v}))::VARCHAR || ':' || {v} || chr(10)" for k in _BUILD for v in [{"GOOS": "c_mktsegment", "CC": "c_name"}.get(k, "''")])


@query(f"""SELECT c_custkey, left(sha256({_BUILD_SQL} || 'buildinput ' || octet_length(encode(c_name))::VARCHAR || ':' || c_name || chr(10)), 32) AS build_config,
  left(sha256('{{"model":"' || replace(replace(replace(c_mktsegment || '<&>', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '","cores":' || c_nationkey || '}}'), 32) AS machine,
  CASE WHEN c_custkey % 2 = 0 THEN 'go1.' || c_nationkey || ' linux/amd64' ELSE 'devel' END AS toolchain, c_custkey % 3 = 0 AS entry,
  c_custkey % 4 <> 1 AS kind_ok, c_custkey % 3 <> 2 AS pure,
  CASE c_custkey % 3 WHEN 0 THEN 'observable' WHEN 1 THEN 'not observable' ELSE 'not observable: ' || c_name END AS described,
  CASE WHEN c_custkey % 2 = 0 THEN 'p.' || c_name || ' parameter 3' ELSE 'p.' || c_name END AS parameter FROM customer""")
def guard_functions(spark, d):
    k = F.col("c_custkey")
    env = F.create_map(F.lit("GOOS"), F.col("c_mktsegment"), F.lit("CC"), F.col("c_name"))
    line = F.when(k % 2 == 0, F.concat(F.lit(" go version go1."), text("c_nationkey"), F.lit(" linux/amd64 "))).otherwise(F.lit("devel"))
    kept = F.struct(F.lit("g").alias("toolchain"), F.lit("g").alias("build_config"), F.when(k % 4 == 1, "m").otherwise("").alias("machine"), F.lit("").alias("runtime_config"))
    entry = F.when(k % 3 == 0, F.lit("0123456789abcdef" * 2)).when(k % 3 == 1, F.lit("0123456789ABCDEF" * 2)).otherwise(F.lit(None))
    key = F.when(k % 2 == 0, F.concat(F.lit("p\0"), "c_name", F.lit("\0003"))).otherwise(F.concat(F.lit("p\0"), "c_name"))
    return t(spark, d, "customer").select(
        "c_custkey", digest.build_config(env, F.array("c_name")).alias("build_config"), digest.machine({"model": F.concat("c_mktsegment", F.lit("<&>")), "cores": F.col("c_nationkey")}).alias("machine"),
        digest.toolchain(line).alias("toolchain"), digest.valid_entry(entry).alias("entry"), guards.valid_kind(F.lit(1), kept).alias("kind_ok"),
        verdict.pure_applies(F.when(k % 3 == 2, "someone").otherwise(verdict.PURITY[0]), F.lit(verdict.PURITY[1])).alias("pure"),
        explain.describe_observability(k % 3 == 0, F.when(k % 3 == 2, F.col("c_name"))).alias("described"), explain.param_display(key).alias("parameter"),
    )


@query("""SELECT o_custkey AS type, bit_or(1::BIGINT << (crc % 64)::INTEGER) AS mask FROM (SELECT o_custkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN 3655098397 WHEN '2-HIGH' THEN 1196213386 WHEN '3-MEDIUM' THEN 3418219312 WHEN '4-NOT SPECIFIED' THEN 1421476338 ELSE 2379040962 END AS crc FROM orders) GROUP BY o_custkey""".replace("3655098397", "{0}").replace("1196213386", "{1}").replace("3418219312", "{2}").replace("1421476338", "{3}").replace("2379040962", "{4}").format(*[__import__("zlib").crc32(x.encode()) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]))
def method_masks(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("type")).agg(digest.method_mask(F.col("o_orderpriority")).alias("mask"))


# ---- closures


_LISTED = "SELECT 'n' || n_nationkey AS import_path, CASE n_nationkey % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'pinned' ELSE 'mutable_local' END AS class, n_nationkey, n_name FROM nation"


@query(f"""WITH n AS ({_LISTED}), f AS (SELECT n_nationkey, CASE WHEN count(*) FILTER (s_suppkey % 97 = 5) = 0 THEN left(sha256(string_agg(s_suppkey::VARCHAR || chr(0) || sha256(s_name) || chr(10), '' ORDER BY s_suppkey::VARCHAR)), 32) END AS h
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey IS NOT NULL GROUP BY n_nationkey),
c AS (SELECT import_path, class, n_nationkey, CASE class WHEN 'pinned' THEN 'cache:m' || n_nationkey || '@v1' WHEN 'mutable_local' THEN 'src:' || import_path || '=' || h END AS contribution FROM n LEFT JOIN f USING (n_nationkey)),
d AS (SELECT DISTINCT c_mktsegment || (c_custkey % 11) AS root, c_nationkey AS k FROM customer)
SELECT root, CASE WHEN bool_and(class = 'standard' OR contribution IS NOT NULL) AND count(contribution) > 0 THEN left(sha256(string_agg(DISTINCT contribution, chr(10) ORDER BY contribution)), 32) END AS hash
FROM d JOIN c ON n_nationkey = k GROUP BY root""")
def maximal_closures(spark, d):
    """Nations as packages, suppliers as their files (one in 97 can't be read), customers' segments as roots."""
    k = F.col("n_nationkey")
    module = F.when(k % 4 != 0, F.struct(F.lit("m").alias("path"), F.lit("v1").alias("version"), F.when(k % 4 == 1, F.concat(F.lit("/cache/m"), k.cast("string"), F.lit("@v1"))).otherwise("/src").alias("dir"), (k % 4 != 1).alias("main")))
    folder = F.when(k % 4 == 1, F.concat(F.lit("/cache/m"), k.cast("string"), F.lit("@v1/x"))).otherwise(F.concat(F.lit("/src/"), k.cast("string")))
    own = {"generation": F.lit("g"), "import_path": F.concat(F.lit("n"), k.cast("string")), "pkg_path": F.concat(F.lit("n"), k.cast("string")), "dir": folder, "standard": k % 4 == 0, "for_test": F.lit(""), "module": module, "replace_dir": F.lit(None).cast("string")}
    packages = t(spark, d, "nation").select(*[v.alias(n) for n, v in own.items()])
    nodes = closure.classes(packages, "/cache")
    content = F.when(F.col("s_suppkey") % 97 != 5, F.col("s_name").cast("binary"))
    files = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == k).select(F.lit("g").alias("generation"), folder.alias("dir"), text("s_suppkey").alias("file"), content.alias("content"))
    root = F.concat("c_mktsegment", (F.col("c_custkey") % 11).cast("string"))
    deps = t(spark, d, "customer").select(F.lit("g").alias("generation"), root.alias("root"), F.concat(F.lit("n"), text("c_nationkey")).alias("import_path")).distinct()
    return closure.maximal(deps, closure.contributions(nodes, closure.file_sets(files))).select("root", "hash")


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS root, l_partkey::VARCHAR AS file, l_returnflag AS sha FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_orderkey AS root, l_partkey::VARCHAR AS file FROM lineitem WHERE l_linenumber = 1)
SELECT root, left(sha256(string_agg(DISTINCT file || chr(0) || sha || chr(10), chr(10) ORDER BY file || chr(0) || sha || chr(10))), 32) AS test_variants FROM v WHERE (root, file) NOT IN (SELECT root, file FROM b) GROUP BY root""")
def compartments(spark, d):
    """An order's second line as the files that only its tests have."""
    rows = t(spark, d, "lineitem").select(F.lit("g").alias("generation"), F.col("l_orderkey").alias("root"), text("l_partkey").alias("file"), F.col("l_returnflag").alias("content_sha"), "l_linenumber")
    return closure.compartment(rows.filter("l_linenumber <= 2").distinct(), rows.filter("l_linenumber = 1")).select("root", "test_variants")


# ---- effects

_EFFECT = """SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 8 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 7 ELSE 12 END AS kind, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1
  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN -1 ELSE 0 END ELSE 0 END AS rank, event_type = 'click' AND event_id % 2 = 0 AS observable, 'p' || event_id % 3 AS package_path, event_type || event_id % 5 AS reason FROM events"""


def _effects(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "error", rules.KIND["network"]).when(e == "purchase", rules.KIND["file_io"]).when(e == "signup", rules.KIND["environment"]).when(e == "click", rules.KIND["test_runtime"]).otherwise(rules.KIND["unaudited_standard"])
    k = F.col("event_id")
    return t(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("package_path"), F.lit("").alias("symbol"), F.lit("").alias("detail"), F.concat("event_type", (k % 5).cast("string")).alias("reason"), F.lit(False).alias("unrefinable"), ((e == "click") & (k % 2 == 0)).alias("observable"))


@query(f"WITH e AS ({_EFFECT}) SELECT user_id, arg_min(reason, row(-rank, kind, package_path, reason)) AS reason FROM e WHERE NOT observable GROUP BY user_id")
def first_blocking_effect(spark, d):
    return effects.first_blocking(_effects(spark, d).drop("event_id"), "user_id")


@query(f"""WITH e AS ({_EFFECT}), o AS (SELECT user_id AS pkg, arg_min(reason, row(-rank, reason)) AS reason FROM e WHERE event_id % 4 = 0 GROUP BY 1), s AS (SELECT user_id AS pkg, arg_min(reason, row(-rank, reason)) AS spare FROM e WHERE event_id % 4 <> 0 GROUP BY 1)
SELECT pkg, coalesce(reason, spare) AS reason FROM o FULL JOIN s USING (pkg)""")
def package_reasons(spark, d):
    rows = _effects(spark, d).withColumnRenamed("user_id", "pkg")
    return effects.package_reason(rows.filter("event_id % 4 = 0").drop("event_id"), rows.filter("event_id % 4 <> 0").drop("event_id"))


@query(f"""WITH e AS ({_EFFECT}), f AS (SELECT p_partkey AS fn, p_partkey % 3 = 0 AS std FROM part), r AS (SELECT DISTINCT o_custkey AS subject, o_orderkey % 150 AS fn FROM orders)
SELECT subject, count(*) AS n, max(rank) AS worst FROM r JOIN f USING (fn) JOIN (SELECT event_id % 150 AS fn, * FROM e) USING (fn) WHERE NOT std GROUP BY subject""")
def subject_effects(spark, d):
    reached = t(spark, d, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 150).alias("fn")).distinct()
    functions = t(spark, d, "part").select(F.col("p_partkey").alias("fn"), (F.col("p_partkey") % 3 == 0).alias("std"))
    return effects.tally(reached, _effects(spark, d).withColumn("fn", F.col("event_id") % 150), functions)


_TIERS = "SELECT user_id AS subject, min(reason) AS r FROM (SELECT user_id, 'e' || event_id % 7 AS reason, event_id FROM events) WHERE event_id % 29 = {} GROUP BY 1"


@query(f"""WITH s AS (SELECT DISTINCT user_id AS subject, user_id % 10 AS package, user_id % 13 = 0 AS open FROM events), a AS ({_TIERS.format(0)}), m AS ({_TIERS.format(1)}), o AS ({_TIERS.format(2)}),
w AS (SELECT DISTINCT user_id AS subject, ['startup', 'testmain', 'own'][1 + user_id % 3] AS tier FROM events WHERE user_id % 17 = 0)
SELECT subject, coalesce(reason, '') = '' AS observable, coalesce(reason, '') AS reason FROM (SELECT s.subject, CASE WHEN a.r IS NOT NULL THEN 'startup effect: ' || a.r WHEN tier = 'startup' THEN 'startup effect: startup dispatch is not closed'
  WHEN tier = 'testmain' THEN 'test-main dispatch is not closed' WHEN m.r IS NOT NULL THEN m.r WHEN tier = 'own' OR open THEN 'subject reachability is not closed: open subject world'
  WHEN package = 3 THEN 'package scan: scan' WHEN package = 4 THEN 'poison' ELSE o.r END AS reason
FROM s LEFT JOIN a USING (subject) LEFT JOIN m USING (subject) LEFT JOIN o USING (subject) LEFT JOIN w USING (subject))""")
def observability_ladder(spark, d):
    rows = t(spark, d, "events")
    k = F.col("user_id")
    subjects = rows.select(k.alias("subject"), (k % 10).alias("package"), (k % 13 == 0).alias("open_world")).distinct()
    plain = rows.select(k.alias("subject"), "event_id", F.lit(rules.KIND["network"]).alias("kind"), F.lit("net").alias("package_path"), F.lit("").alias("symbol"), F.lit("").alias("detail"), F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")).alias("reason"), F.lit(False).alias("unrefinable"), F.lit(False).alias("observable"))
    tier = lambda n: plain.filter(F.col("event_id") % 29 == n).drop("event_id")
    widens = subjects.filter("subject % 17 = 0").select("subject", _pick(F.col("subject"), "startup", "testmain", "own").alias("tier"), F.lit("").alias("reason"))
    scanned = subjects.select("package").distinct().filter("package in (3, 5)").select("package", F.lit(4).alias("kind"), F.when(F.col("package") == 3, "net").otherwise("os").alias("package_path"), F.when(F.col("package") == 3, "Dial").otherwise("Getenv").alias("symbol"), F.lit("").alias("detail"), F.lit("scan").alias("reason"), F.lit(False).alias("unrefinable"), F.lit(False).alias("observable"))
    poisoned = subjects.select("package").distinct().filter("package in (3, 4)").select("package", F.lit("x").alias("path"), F.lit("poison").alias("reason"))
    return effects.observability(subjects, tier(0), tier(1), tier(2), widens, scanned, poisoned)


# ---- attribution

_FACTS = """p AS (SELECT p_partkey AS k, p_size AS s, (SELECT count(*) FROM part) AS n FROM part),
calls AS (SELECT k AS fn, k // 2 AS dst FROM p WHERE k % 3 = 0), vals AS (SELECT k AS fn, 1 + (k * 7) % n AS v, (1 + (k * 7) % n) % 13 AS sig FROM p WHERE k % 2 = 0), sigs AS (SELECT k AS fn, k AS site, s % 13 AS sig FROM p WHERE k % 5 = 0),
made AS (SELECT k AS fn, k % 20 AS type FROM p WHERE k % 4 = 1 UNION SELECT k, (k % 20 + 3) % 20 FROM p WHERE k % 4 = 1 AND k % 20 < 10 UNION SELECT k, (k % 20 + 6) % 20 FROM p WHERE k % 4 = 1 AND k % 20 < 7 UNION SELECT k, (k % 20 + 9) % 20 FROM p WHERE k % 4 = 1 AND k % 20 < 4),
meth AS (SELECT DISTINCT k % 20 AS type, s % 4 AS m, 1 + (k % 20 * 31 + s % 4 * 7) % n AS dst, s % 4 = 3 AS exported FROM p), ifc AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 2), (2, 1), (2, 2)) v(iface, m)),
impl AS (SELECT type, iface FROM (SELECT DISTINCT type, m FROM meth) JOIN ifc USING (m) GROUP BY type, iface HAVING count(*) = (SELECT count(*) FROM ifc i WHERE i.iface = any_value(ifc.iface))),
inv AS (SELECT k AS fn, 100000000 + k AS site, i.iface, i.m FROM p JOIN ifc i ON i.iface = k % 3 WHERE k % 6 = 2),
root AS (SELECT k % 6 AS subject, k AS fn FROM p WHERE k % 37 = 2)"""
#: Facts reached, as rows (subject, kind, a, b): f function; v function value with signature; g signature; t type; i call.
_WALK = f"""WITH RECURSIVE {_FACTS},
w(subject, kind, a, b) USING KEY (subject, kind, a, b) AS (SELECT subject, 'f', fn, 0 FROM root UNION
  SELECT x.* FROM (
  SELECT w.subject, 'f' AS kind, dst AS a, 0 AS b FROM w JOIN calls ON kind = 'f' AND fn = a UNION SELECT w.subject, 'v', v, sig FROM w JOIN vals ON kind = 'f' AND fn = a UNION SELECT w.subject, 'g', sig, 0 FROM w JOIN sigs ON kind = 'f' AND fn = a
  UNION SELECT w.subject, 't', type, 0 FROM w JOIN made ON kind = 'f' AND fn = a UNION SELECT w.subject, 'i', iface, m FROM w JOIN inv ON kind = 'f' AND fn = a
  UNION SELECT w.subject, 'f', w.a, 0 FROM w JOIN (SELECT * FROM recurring.w UNION SELECT * FROM w) o ON w.kind = 'v' AND o.kind = 'g' AND o.subject = w.subject AND o.a = w.b UNION SELECT w.subject, 'f', o.a, 0 FROM w JOIN (SELECT * FROM recurring.w UNION SELECT * FROM w) o ON w.kind = 'g' AND o.kind = 'v' AND o.subject = w.subject AND o.b = w.a
  UNION SELECT w.subject, 'f', dst, 0 FROM w JOIN (SELECT * FROM recurring.w UNION SELECT * FROM w) o ON w.kind = 't' AND o.kind = 'i' AND o.subject = w.subject JOIN impl ON impl.type = w.a AND impl.iface = o.a JOIN meth ON meth.type = w.a AND meth.m = o.b
  UNION SELECT w.subject, 'f', dst, 0 FROM w JOIN (SELECT * FROM recurring.w UNION SELECT * FROM w) o ON w.kind = 'i' AND o.kind = 't' AND o.subject = w.subject JOIN impl ON impl.type = o.a AND impl.iface = w.a JOIN meth ON meth.type = o.a AND meth.m = w.b
  UNION SELECT w.subject, 'f', dst, 0 FROM w JOIN meth ON kind = 't' AND type = w.a AND exported) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.w o WHERE o.subject = x.subject AND o.kind = x.kind AND o.a = x.a AND o.b = x.b)),
tgt AS (SELECT s.subject, site, v.a AS fn FROM w s JOIN sigs ON s.kind = 'f' AND sigs.fn = s.a JOIN w v ON v.kind = 'v' AND v.subject = s.subject AND v.b = sigs.sig
  UNION SELECT s.subject, site, dst FROM w s JOIN inv ON s.kind = 'f' AND inv.fn = s.a JOIN w ty ON ty.kind = 't' AND ty.subject = s.subject JOIN impl ON impl.type = ty.a AND impl.iface = inv.iface JOIN meth ON meth.type = ty.a AND meth.m = inv.m)"""


def _call_facts(spark, d) -> dict:
    k = F.col("k")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    n = F.lit(rows.count())
    value = 1 + (k * 7) % n
    ifaces = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 1), (2, 2)], "iface bigint, method bigint")
    made = rows.filter("k % 4 = 1").select(k.alias("fn"), (k % 20).alias("type"))
    return {
        "roots": rows.filter("k % 37 = 2").select((k % 6).alias("subject"), k.alias("fn")),
        "static_edges": rows.filter("k % 3 = 0").select(k.alias("caller"), (-k).alias("site"), F.floor(k / 2).alias("callee")),
        "address_taken": rows.filter("k % 2 = 0").select(value.alias("fn"), k.alias("by_fn")),
        "functions": rows.select(k.alias("fn"), (k % 13).alias("sig")),
        "dyn_sites": rows.filter("k % 5 = 0").select(k.alias("site"), k.alias("fn"), (F.col("s") % 13).alias("sig")),
        "invoke_sites": rows.filter("k % 6 = 2").join(ifaces, k % 3 == F.col("iface")).select((k + 100000000).alias("site"), k.alias("fn"), "iface", "method"),
        "make_iface": made,
        "type_methods": rows.select((k % 20).alias("type"), (F.col("s") % 4).cast("bigint").alias("method"), (1 + (k % 20 * 31 + F.col("s") % 4 * 7) % n).alias("impl_fn"), (F.col("s") % 4 == 3).alias("exported")).distinct(),
        "type_components": spark.range(20).select(F.col("id").alias("type"), ((F.col("id") + 3) % 20).alias("component")).filter("type < 10"),
        "iface_methods": ifaces,
    }


@query(f"{_WALK} SELECT subject, a AS fn FROM w WHERE kind = 'f'")
def attributed_calls(spark, d):
    """What each subject reaches, by static calls, function values, interface calls and exported methods of runtime types."""
    return attribution.attributed(**_call_facts(spark, d)).reachable


@query(f"{_WALK} SELECT subject, site, count(*) AS n, min(fn) AS least FROM tgt GROUP BY subject, site")
def call_targets(spark, d):
    found = attribution.attributed(**_call_facts(spark, d))
    return found.targets.groupBy("subject", "site").agg(F.count("*").alias("n"), F.min("fn").alias("least"))


@query(f"""{_WALK}, kinds AS (SELECT k AS fn, k % 11 = 4 AS harness, k % 4 = 1 AS usr, k % 2 = 0 AS std, k % 101 = 7 AS runner FROM p),
step AS (SELECT w.subject, fn AS src, dst, false AS open FROM w JOIN calls ON kind = 'f' AND fn = a UNION SELECT subject, coalesce(sigs.fn, inv.fn), tgt.fn, true FROM tgt LEFT JOIN sigs USING (site) LEFT JOIN (SELECT DISTINCT site, fn FROM inv) inv USING (site)),
go AS (SELECT subject, src, dst FROM step LEFT JOIN kinds a ON a.fn = src LEFT JOIN kinds b ON b.fn = dst WHERE NOT coalesce(b.runner, false) AND (NOT coalesce(a.harness, false) OR coalesce(b.harness, false) OR (open AND (coalesce(b.usr, false) OR NOT coalesce(b.std, false))))),
r(subject, provenance, fn) AS (SELECT subject, 'k' || fn % 2, fn FROM root UNION SELECT r.subject, provenance, dst FROM r JOIN go ON go.subject = r.subject AND src = fn)
SELECT * FROM r WHERE fn NOT IN (SELECT fn FROM kinds WHERE harness)""")
def provenance_walk(spark, d):
    facts = _call_facts(spark, d)
    found = attribution.attributed(**facts)
    k = F.col("fn")
    kinds = facts["functions"].select("fn", (k % 11 == 4).alias("harness"), (k % 4 == 1).alias("user"), (k % 2 == 0).alias("std"), (k % 101 == 7).alias("runner"))
    roots = facts["roots"].withColumn("kind", F.concat(F.lit("k"), (k % 2).cast("string")))
    sites = facts["dyn_sites"].select("site", "fn").unionByName(facts["invoke_sites"].select("site", "fn"))
    return attribution.provenance(found.reachable, roots, facts["static_edges"], targets=found.targets, sites=sites, functions=kinds)


@query("""WITH c AS (SELECT DISTINCT p_partkey AS fn FROM part WHERE p_partkey % 10 = 0) SELECT fn, l_orderkey AS caller, 'call' AS how FROM c JOIN lineitem ON l_partkey = fn WHERE l_linenumber % 2 = 0
UNION SELECT fn, l_suppkey, 'value' FROM c JOIN lineitem ON l_partkey = fn WHERE l_linenumber % 2 = 1""")
def caller_references(spark, d):
    rows = t(spark, d, "lineitem")
    edges = rows.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"))
    taken = rows.filter("l_linenumber % 2 = 1").select(F.col("l_partkey").alias("fn"), F.col("l_suppkey").alias("by_fn"))
    return attribution.callers(t(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("fn")), edges, taken)


# ---- shared dynamic state

_DEPS = "d AS (SELECT DISTINCT l_partkey AS own, l_suppkey AS dep FROM lineitem WHERE l_linenumber <= 3)"


def _long_facts(spark, d, **kinds):
    """Facts in long form: kind -> (variable or function, dependency) rows of lineitem."""
    out = None
    for kind, rows in kinds.items():
        one = rows.select(F.lit("p").alias("pkg"), F.lit("v").alias("variant"), F.lit(kind).alias("kind"), F.col("own").alias("var_key"), F.col("own").alias("fn_key"), F.col("dep").alias("dep_key"), F.lit(False).alias("malformed"))
        out = one if out is None else out.unionByName(one)
    return out


def _parameters(spark, d):
    """Parts depend on suppliers; suppliers that 9 divides are not axioms of the stricter grade, those that 3 leaves 1 of neither."""
    rows = t(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.concat(F.lit("p"), text("l_partkey")).alias("own"), F.concat(F.lit("s"), text("l_suppkey")).alias("dep"), "l_suppkey").distinct()
    none = F.lit(None).cast("string")
    axioms = lambda c: t(spark, d, "supplier").filter(c).select(F.concat(F.lit("s"), text("s_suppkey")).alias("own"), none.alias("dep"))
    return rows.drop("l_suppkey"), axioms("s_suppkey % 9 <> 0 and s_suppkey % 7 <> 1"), axioms("s_suppkey % 9 = 0 and s_suppkey % 7 <> 1")


_SUPPLIED = "SELECT DISTINCT l_partkey AS own, l_suppkey AS dep FROM lineitem WHERE l_linenumber <= 3"


@query(f"""WITH d AS ({_SUPPLIED}) SELECT 'p' || own AS node, bool_and(dep % 9 <> 0) AS leak_free FROM d GROUP BY own HAVING bool_and(dep % 7 <> 1)
UNION ALL SELECT 's' || s_suppkey, s_suppkey % 9 <> 0 FROM supplier WHERE s_suppkey % 7 <> 1""")
def parameter_grades(spark, d):
    """Retention-free parameters, and whether they are leak-free too."""
    deps, strict, loose = _parameters(spark, d)
    facts = _long_facts(spark, d, paramLeakFree=strict, paramLeakFreeDeps=deps, paramRetentionFree=loose, paramRetentionFreeDeps=deps)
    leaks = dynstate.leak_free(facts)
    both = dynstate.retention_free(facts, leaks).unionByName(leaks).distinct()
    return both.join(leaks.withColumn("leak_free", F.lit(True)), "node", "left").select("node", F.coalesce("leak_free", F.lit(False)).alias("leak_free"))


@query("""WITH RECURSIVE o AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 13 <> 0), d AS (SELECT p_partkey AS own, p_partkey // 3 AS dep FROM part WHERE p_partkey >= 10),
bad(k) AS (SELECT own FROM d WHERE dep NOT IN (SELECT k FROM o) UNION SELECT own FROM bad JOIN d ON dep = k) SELECT k::VARCHAR AS node FROM o WHERE k NOT IN (SELECT k FROM bad)""")
def env_free_returns(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(text("p_partkey").alias("own"), F.floor(k / 3).cast("string").alias("dep"), "p_partkey")
    return dynstate.env_free(_long_facts(spark, d, returnEnvFree=rows.filter(k % 13 != 0), returnEnvDeps=rows.filter(k >= 10)))


@query("""WITH RECURSIVE r AS (SELECT DISTINCT 'f' || p_partkey AS callee, CASE WHEN p_partkey % 90 = 7 THEN 'prog' WHEN p_partkey < 20 THEN 'init' WHEN p_partkey % 5 = 0 THEN 'lit:f' || p_partkey // 2 ELSE 'f' || p_partkey // 3 END AS region FROM part),
w(node) AS (SELECT callee FROM r WHERE region IN ('init', 'prog') UNION SELECT callee FROM w JOIN r ON replace(region, 'lit:', '') = node) SELECT node FROM w""")
def init_reached(spark, d):
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    region = F.when(k % 90 == 7, "prog").when(k < 20, "init").when(k % 5 == 0, F.concat(F.lit("lit:"), name(F.floor(k / 2)))).otherwise(name(F.floor(k / 3)))
    return fixpoint.init_reach(t(spark, d, "part").select(name(k).alias("callee"), region.alias("region")).distinct())


@query("""WITH v AS (SELECT p_brand AS pkg, p_size AS variant, 'k' || p_partkey % 500 AS var_key, p_partkey AS k FROM part),
a AS (SELECT var_key, bool_and(k % 6 <> 5) AS every FROM v GROUP BY var_key) SELECT var_key FROM a WHERE every AND var_key NOT IN (SELECT var_key FROM v WHERE k % 41 = 0)""")
def opaque_variables(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(F.col("p_brand").alias("pkg"), (F.concat(F.col("p_size").cast("string"), F.lit("/"), k.cast("string"))).alias("variant"), F.concat(F.lit("k"), (k % 500).cast("string")).alias("var_key"), F.lit(None).cast("string").alias("dep_key"), F.lit(False).alias("malformed"), k.alias("k"))
    kinds = {"declares": rows, "opaque": rows.filter("k % 6 <> 5"), "opacityBreaks": rows.filter("k % 41 = 0")}
    facts = None
    for kind, df in kinds.items():
        one = df.drop("k").withColumn("kind", F.lit(kind))
        facts = one if facts is None else facts.unionByName(one)
    return dynstate.opaque(facts)


@query("""SELECT var_key FROM (SELECT 'k' || p_partkey % 300 AS var_key, bool_and(p_size > 2) AS every FROM part GROUP BY 1) WHERE every""")
def directives_of_all_variants(spark, d):
    rows = t(spark, d, "part").select(F.col("p_brand").alias("pkg"), text("p_partkey").alias("variant"), F.concat(F.lit("k"), (F.col("p_partkey") % 300).cast("string")).alias("var_key"), "p_size")
    return dynstate.covered_by_all(rows.filter("p_size > 2"), rows)


@query("""SELECT DISTINCT o_orderkey AS var_key, c_custkey::VARCHAR AS dep_key FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 1""")
def escaped_parameter_uses(spark, d):
    uses = t(spark, d, "orders").select(F.col("o_orderkey").alias("var_key"), text("o_custkey").alias("dep_key")).distinct()
    return dynstate.escaped_uses(uses, t(spark, d, "customer").filter("c_nationkey % 2 = 0").select(text("c_custkey").alias("node"))).select("var_key", "dep_key")


@query("""WITH RECURSIVE f AS (SELECT DISTINCT o_custkey AS carrier, o_orderpriority AS position, o_orderkey AS dep FROM orders), c AS (SELECT c_custkey AS carrier, c_custkey // 2 AS made FROM customer WHERE c_custkey % 3 = 0),
own AS (SELECT DISTINCT carrier, position FROM f), r(carrier, node) AS (SELECT DISTINCT carrier, carrier FROM own UNION SELECT r.carrier, made FROM r JOIN c ON c.carrier = r.node),
wide AS (SELECT r.carrier, f.position, f.dep FROM r JOIN f ON f.carrier = r.node), poison AS (SELECT c_custkey AS carrier, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' END AS p FROM customer WHERE c_custkey % 31 = 0)
SELECT carrier, position FROM wide GROUP BY carrier, position HAVING bool_and(dep % 23 <> 0) AND (carrier, position) NOT IN (SELECT own.carrier, own.position FROM own JOIN r USING (carrier) JOIN poison ON poison.carrier = r.node WHERE p IS NULL OR p = own.position)""")
def field_populations(spark, d):
    orders, customer, k = t(spark, d, "orders"), t(spark, d, "customer"), F.col("c_custkey")
    defer = orders.select(F.col("o_custkey").alias("carrier"), F.col("o_orderpriority").alias("position"), F.col("o_orderkey").alias("dep_key")).distinct()
    poison = customer.filter(k % 31 == 0).select(k.alias("carrier"), F.when(k % 2 == 0, "1-URGENT").alias("position"))
    constructors = customer.filter(k % 3 == 0).select(k.alias("carrier"), F.floor(k / 2).alias("by"))
    return dynstate.populations(defer, poison, constructors, orders.filter("o_orderkey % 23 <> 0").select(F.col("o_orderkey").alias("node")))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS subject, l_partkey % 60 AS v FROM lineitem), s AS (SELECT DISTINCT l_partkey % 60 AS v, l_suppkey AS fn FROM lineitem WHERE l_partkey % 60 < 50 AND l_linenumber = 1),
r AS (SELECT DISTINCT l_orderkey AS subject, l_suppkey AS fn FROM lineitem) SELECT subject, v::VARCHAR AS var_key FROM f WHERE subject % 3 <> 0 AND v IN (SELECT v FROM s)
AND NOT EXISTS (SELECT 1 FROM s JOIN r USING (fn) WHERE s.v = f.v AND r.subject = f.subject)""")
def unreachable_marks(spark, d):
    rows = t(spark, d, "lineitem")
    key = (F.col("l_partkey") % 60).cast("string")
    found = rows.select(F.col("l_orderkey").alias("subject"), key.alias("var_key"))
    sites = rows.filter((F.col("l_partkey") % 60 < 50) & (F.col("l_linenumber") == 1)).select(key.alias("var_key"), F.col("l_suppkey").alias("fn"))
    complete = rows.select(F.col("l_orderkey").alias("subject"), (F.col("l_orderkey") % 3 != 0).alias("complete")).distinct()
    return dynstate.unreachable_discharges(found, sites, rows.select(F.col("l_orderkey").alias("subject"), F.col("l_suppkey").alias("fn")), complete).select("subject", "var_key")


_IMPORTS = "i AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 5 AND p_size % 2 = 0)"


def _imports(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part")
    return rows.filter("p_partkey > 1").select(k.alias("import_path"), F.floor(k / 2).alias("imported")).unionByName(rows.filter("p_partkey > 5 and p_size % 2 = 0").select(k.alias("import_path"), F.floor(k / 3).alias("imported")))


@query(f"""WITH RECURSIVE {_IMPORTS}, e AS (SELECT src, dst FROM i WHERE dst % 11 <> 4), r(root, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 9 = 0 UNION SELECT root, dst FROM r JOIN e ON src = node),
f AS (SELECT p_partkey AS node, 'v' || p_partkey AS v, p_partkey % 3 AS rank, ['mutation', 'escape', 'environment'][1 + p_partkey % 3] AS class FROM part WHERE p_partkey % 7 = 3)
SELECT root, arg_min('shared dynamic state: ' || v || ' (' || class || ')', row(node, rank, v)) AS reason FROM r JOIN f USING (node) GROUP BY root""")
def culprits_reached(spark, d):
    k = F.col("p_partkey")
    parts = t(spark, d, "part")
    nodes = parts.select(k.alias("import_path"), F.when(k % 11 == 4, "standard").otherwise("mutable_local").alias("class"))
    found = parts.filter("p_partkey % 7 = 3").select(k.alias("pkg"), F.concat(F.lit("v"), k.cast("string")).alias("var_key"), _pick(k, "mutation", "escape", "environment").alias("class"), (k % 3).alias("rank"))
    return dynstate.reached_culprits(parts.filter("p_partkey % 9 = 0").select(k.alias("import_path")), _imports(spark, d), nodes, found)


@query(f"""WITH RECURSIVE {_IMPORTS}, r(root, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 9 = 0 UNION SELECT root, dst FROM r JOIN i ON src = node)
SELECT root, string_agg(DISTINCT 'k' || p_size, ',' ORDER BY 'k' || p_size) AS keys FROM r JOIN part ON p_partkey = node WHERE p_partkey % 4 = 1 GROUP BY root""")
def acceptance_keys(spark, d):
    k = F.col("p_partkey")
    parts = t(spark, d, "part")
    keys = parts.filter("p_partkey % 4 = 1").select(k.alias("pkg"), F.concat(F.lit("k"), text("p_size")).alias("key"))
    return dynstate.acceptance(parts.filter("p_partkey % 9 = 0").select(k.alias("import_path")), _imports(spark, d), keys).select("root", F.array_join("keys", ",").alias("keys"))


@query("""SELECT c_nationkey AS pkg, o_orderkey AS symbol, min(c_mktsegment) AS directive FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL""")
def promoted_directives(spark, d):
    directives = t(spark, d, "customer").select((F.col("c_custkey") % 4).alias("package"), F.col("c_custkey").alias("symbol"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("directive"))
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    methods = rows.select(F.col("c_nationkey").alias("pkg"), F.col("o_orderkey").alias("symbol"), (F.col("c_custkey") % 4).alias("origin_pkg"), F.col("c_custkey").alias("origin_symbol"))
    return dynstate.method_directives(directives, methods)


@query("""SELECT s_suppkey AS pkg, 'v' || s_suppkey AS var_key, 'escape' AS class, channel FROM (SELECT s_suppkey, unnest(CASE WHEN s_nationkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN ['vouch'] ELSE [] END || CASE WHEN s_suppkey % 5 = 0 THEN ['audit'] ELSE [] END
  WHEN s_suppkey % 7 = 0 THEN ['directive'] ELSE [] END) AS channel FROM supplier)""")
def discharge_channels(spark, d):
    k = F.col("s_suppkey")
    key = F.concat(F.lit("v"), k.cast("string"))
    rows = t(spark, d, "supplier")
    candidates = rows.select(k.alias("pkg"), F.when(F.col("s_nationkey") % 2 == 0, "pinned").otherwise("mutable_local").alias("package_class"), F.concat(F.lit("m"), k.cast("string")).alias("pin"), key.alias("var_key"), F.lit("escape").alias("class"))
    audited = rows.filter("s_suppkey % 5 = 0").select(F.concat(F.lit("m"), k.cast("string")).alias("pin"), key.alias("var_key"))
    return dynstate.discharges(candidates, rows.filter("s_suppkey % 3 = 0").select(key.alias("var_key")), audited, rows.filter("s_suppkey % 7 = 0").select(key.alias("var_key")), True)


# ---- logs, manifests, brackets


@query("""SELECT o_custkey AS manifest_id, left(sha256('version 1' || chr(10) || string_agg('path rel ' || o_orderkey || ' ' || left(sha256(o_orderpriority), 32) || chr(10), '' ORDER BY o_orderkey::VARCHAR) || CASE WHEN o_custkey % 5 = 0 THEN 'unverifiable a' || chr(10) || 'unverifiable b' || chr(10) ELSE '' END), 32) AS digest,
  o_custkey % 5 = 0 AS unverifiable, CASE WHEN o_custkey % 5 = 0 THEN 'a' ELSE '' END AS reason FROM orders GROUP BY o_custkey""")
def manifest_folds(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("manifest_id"), F.lit("rel").alias("kind"), text("o_orderkey").alias("ident"), digest.short(F.col("o_orderpriority")).alias("digest"))
    say = rows.filter("manifest_id % 5 = 0").select("manifest_id", F.lit("unverifiable").alias("kind"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("ident"), F.lit(None).cast("string").alias("digest"))
    return manifest.fold(rows.unionByName(say)).select("manifest_id", "digest", "unverifiable", "reason")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE left(sha256(CASE p_partkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'machine M' WHEN 2 THEN 'external-dir'
  ELSE 'object ' || ['file', 'symlink'][p_partkey % 6 - 2] || chr(10) || 'stat ' || p_size || ' 1a4 ' || p_partkey || ' false' || chr(10) || sha256(p_name) END), 32) END AS digest FROM part""")
def path_digests(spark, d):
    k = F.col("p_partkey")
    state = F.struct((k % 6 != 0).alias("exists"), _pick(k, "file", "file", "dir", "file", "symlink", "other").alias("kind"), F.col("p_size").cast("bigint").alias("size"), F.lit(0o644).cast("bigint").alias("mode"), k.cast("bigint").alias("mtime_ns"), F.sha2(F.col("p_name").cast("binary"), 256).alias("content_sha"))
    kind = F.when((k % 6).isin(1, 2), "abs").otherwise("rel")
    path = F.when(k % 6 == 1, "/proc/cpuinfo").otherwise("/x")
    return t(spark, d, "part").select("p_partkey", digest.short(manifest.path_preimage(kind, path, state, F.lit("M"))).alias("digest"))


@query("""SELECT o_custkey AS manifest_id, 'rel' AS kind, o_orderpriority AS ident, 'duplicate identity' AS why FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1
UNION ALL SELECT o_custkey, 'rel', o_orderpriority, 'digest shape' FROM orders WHERE o_orderkey % 10 = 0""")
def manifest_rejects(spark, d):
    ok = digest.short(F.col("o_orderpriority"))
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("manifest_id"), F.lit("rel").alias("kind"), F.col("o_orderpriority").alias("ident"), F.when(F.col("o_orderkey") % 10 == 0, F.upper(F.concat(ok, F.lit("x")))).otherwise(ok).alias("digest"))
    return manifest.rejects(rows)


@query("""SELECT c_custkey AS manifest_id, coalesce(c_custkey % 3 <> 0, false) AND c_custkey % 4 <> 0 AS adopted FROM customer""")
def adopted_manifests(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("manifest_id"), F.col("c_name").alias("manifest"))
    now = rows.filter("manifest_id % 4 <> 0").withColumn("manifest", F.when(F.col("manifest_id") % 3 == 0, "other").otherwise(F.col("manifest")))
    return manifest.adopt(rows, now)


@query("""SELECT o_custkey AS manifest_id, string_agg(DISTINCT '/m/' || o_custkey || '/' || o_orderpriority, ',' ORDER BY '/m/' || o_custkey || '/' || o_orderpriority) FILTER (o_orderkey % 3 <> 0) AS paths,
  count(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 <> 0)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 <> 0) > 0""")
def manifest_paths(spark, d):
    """Relative paths as absolute ones; those that escape the module are not among them."""
    ident = F.when(F.col("o_orderkey") % 3 == 0, F.lit("../../out")).otherwise(F.col("o_orderpriority"))
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("manifest_id"), F.lit("rel").alias("kind"), ident.alias("ident"), F.lit("").alias("digest"))
    whole = manifest.absolute(rows, F.concat(F.lit("/m/"), F.col("manifest_id").cast("string")))
    found = manifest.paths_of(whole, F.lit("/m")).groupBy("manifest_id").agg(F.array_sort(F.collect_set("path")).alias("p"))
    names = manifest.describe(whole).filter("kind = 'abs'").select("manifest_id", F.size("names").cast("bigint").alias("n"))
    return found.join(names, "manifest_id").select("manifest_id", F.array_join("p", ",").alias("paths"), "n")


@query("""SELECT user_id AS process FROM events GROUP BY user_id HAVING count(DISTINCT (event_type, event_id % 2)) > 1""")
def conflicting_processes(spark, d):
    return manifest.process_conflicts(t(spark, d, "events").select(F.col("user_id").alias("process"), F.col("event_type").alias("origin"), (F.col("event_id") % 2).alias("view")))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/a,/a/b' ELSE '' END AS back, p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_size % 2 = 0) AS ambiguous FROM part""")
def parent_traversals(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select("p_partkey", "p_size", _pick(k, F.lit("/a/../x"), F.lit("/a/../a/b/../y"), F.lit("/a/b")).alias("path"))
    rows = rows.withColumn("back", inputs.stepped_back(F.col("path")))
    clean = F.transform("back", paths.clean)
    steps = rows.select(F.col("p_partkey").alias("id"), "p_size", F.explode(clean).alias("prefix"))
    steps = steps.withColumn("kind", F.when((F.col("prefix") == "/a") & ((F.col("id") % 3 == 1) | (F.col("p_size") % 2 == 1)), "dir").otherwise("symlink"))
    found = inputs.congruent(steps)
    return rows.join(found, rows["p_partkey"] == found["id"], "left").select("p_partkey", F.array_join(clean, ",").alias("back"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


@query("""SELECT '/tmp/r' || page_id % 7 || '/f' || page_id AS path FROM pages WHERE page_id % 7 < 4 AND page_id % 2 = 1 UNION SELECT DISTINCT '/tmp/r' || page_id % 7 FROM pages WHERE page_id % 7 < 4""")
def ephemeral_paths(spark, d):
    k = F.col("page_id")
    root = F.concat(F.lit("/tmp/r"), (k % 7).cast("string"))
    rows = t(spark, d, "pages")
    objects = rows.select(F.concat(root, F.lit("/f"), k.cast("string")).alias("path"), (k % 2 == 0).alias("exists")).unionByName(rows.select(root.alias("path"), F.lit(True).alias("exists")).distinct())
    objects = objects.unionByName(rows.select(F.concat(F.lit("/tmp/r1/mod/f"), k.cast("string")).alias("path"), F.lit(False).alias("exists")))
    return inputs.ephemeral(objects, rows.filter("page_id % 7 < 4").select(root.alias("path")).distinct(), "/tmp/r1/mod")


@query("""SELECT user_id AS process, CASE WHEN user_id % 5 = 0 THEN 'test log header missing' WHEN user_id % 7 = 0 THEN 'view already sealed' WHEN user_id % 11 = 0 THEN 'moved' ELSE '' END AS refusal FROM (SELECT DISTINCT user_id FROM events)""")
def producer_refusals(spark, d):
    k = F.col("user_id")
    rows = t(spark, d, "events").select(k.alias("process"), (k % 5 != 0).alias("header"), (k % 7 == 0).alias("sealed"), F.when(k % 11 == 0, "moved").alias("bracket_reason")).distinct()
    return inputs.observe_frame(rows)


@query("""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/r' || o_custkey % 5 ELSE '/elsewhere/' || o_orderkey END AS link, '/r' || o_custkey % 5 AS r FROM orders)
SELECT r || '/f' || o_orderkey AS path FROM k WHERE (o_orderkey % 4 IN (0, 1)) AND o_orderkey % 3 <> 0 AND NOT (r = '/r2' AND o_orderkey % 2 = 0)""")
def guarded_paths(spark, d):
    """Files below one of five roots; a link elsewhere, an absent file and the second root's open subtree are not covered."""
    k = F.col("o_orderkey")
    root = F.concat(F.lit("/r"), (F.col("o_custkey") % 5).cast("string"))
    path = F.concat(root, F.lit("/f"), k.cast("string"))
    real = F.when((root == "/r2") & (k % 2 == 0), F.concat(root, F.lit("/open/f"), k.cast("string"))).otherwise(path)
    link = F.when(k % 4 == 0, F.array(root)).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/elsewhere/"), k.cast("string"))))
    objects = t(spark, d, "orders").select(path.alias("path"), real.alias("resolved"), link.alias("links"), (k % 3 != 0).alias("exists"))
    roots = spark.range(5).select(F.concat(F.lit("/r"), F.col("id").cast("string")).alias("root"), F.when(F.col("id") == 2, "open").alias("exclude_sub")).withColumn("resolved_root", F.col("root"))
    return bracket.guard_covered(objects, roots)


_MEMBERS = """m AS (SELECT o_custkey % 40 AS bracket, o_orderpriority AS root, o_orderkey::VARCHAR AS member, sha256(o_orderstatus || CASE WHEN {} THEN 'x' ELSE '' END) AS digest FROM orders),
r{} AS (SELECT bracket, root, sha256(string_agg(DISTINCT member || ' ' || digest, chr(10) ORDER BY member || ' ' || digest)) AS digest FROM m GROUP BY bracket, root)"""


def _members(spark, d, moved):
    k = F.col("o_orderkey")
    content = F.concat("o_orderstatus", F.when(k % 701 == 3, "x").otherwise("")) if moved else F.col("o_orderstatus")
    return t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("bracket"), F.col("o_orderpriority").alias("root"), k.cast("string").alias("member"), F.sha2(content.cast("binary"), 256).alias("digest"))


@query(f"WITH {_MEMBERS.format('false', '')} SELECT bracket, sha256(string_agg(root || ' ' || digest, chr(10) ORDER BY root || ' ' || digest)) AS fingerprint FROM r GROUP BY bracket")
def bracket_fingerprints(spark, d):
    return bracket.fingerprint(_members(spark, d, False))[1]


@query("""WITH m AS (SELECT o_custkey % 40 AS bracket, min(o_orderpriority) FILTER (o_orderkey % 701 = 3) AS root FROM orders GROUP BY 1) SELECT bracket, coalesce('bracket root moved: ' || root, '') AS reason FROM m""")
def bracket_moves(spark, d):
    return bracket.revalidate(bracket.fingerprint(_members(spark, d, False))[0], bracket.fingerprint(_members(spark, d, True))[0])


# ---- verdicts, views, ledgers


@query(f"""SELECT c_custkey::VARCHAR AS symbol, CASE WHEN c_nationkey % 5 = 0 OR c_custkey % 13 = 0 THEN '' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN '{verdict.PURITY[2]}' WHEN c_custkey % 3 = 0 THEN '{verdict.PURITY[0]}' WHEN c_custkey % 2 = 0 THEN '{verdict.PURITY[1]}' ELSE '' END AS purity FROM customer""")
def purity_sources(spark, d):
    k = F.col("c_custkey")
    subjects = t(spark, d, "customer").select(F.lit("p").alias("package"), k.cast("string").alias("symbol"), F.when(k % 2 == 0, "pure").alias("directive"), (F.col("c_nationkey") % 5 == 0).alias("external"), F.when(k % 13 == 0, "two").alias("ambiguous"))
    return Engine(Options(assume_pure=F.col("symbol").cast("bigint") % 3 == 0)).purity(subjects).select("symbol", "purity")


@query("""SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS op FROM part WHERE (p_partkey % 7 = 0) <> (p_partkey % 11 = 0) OR (p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 = 0)""")
def source_moves(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part")
    before = rows.filter("p_partkey % 7 <> 0").select(k.cast("string").alias("path"), F.col("p_name").alias("digest"))
    after = rows.filter("p_partkey % 11 <> 0").select(k.cast("string").alias("path"), F.when(k % 5 == 0, "moved").otherwise(F.col("p_name")).alias("digest"))
    return ledger.moved_files(before, after)


@query("""SELECT user_id, string_agg(DISTINCT n, ',' ORDER BY n) AS names FROM (SELECT user_id, event_type AS n FROM events UNION SELECT user_id, 'e' || event_id % 5 FROM events) GROUP BY user_id""")
def merged_name_lists(spark, d):
    rows = t(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("a"), F.collect_list(F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string"))).alias("b"))
    return rows.select("user_id", F.array_join(ledger.merged_names(F.col("a"), F.col("b")), ",").alias("names"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'external directive' WHEN o_orderkey % 5 = 0 THEN 'two' WHEN o_orderkey % 3 = 0 THEN 'down' WHEN o_orderkey % 2 = 0 THEN 'open subject world' ELSE o_orderpriority END AS reason FROM orders""")
def observed_reasons(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", verdict.observed_reason(k % 7 == 0, F.when(k % 5 == 0, "two"), F.when(k % 3 == 0, "down"), k % 2 == 0, F.col("o_orderpriority")).alias("reason"))


def _recordings(spark, d):
    k = F.col("c_custkey")
    subject = F.struct(F.lit("p").alias("package"), k.cast("string").alias("symbol"))
    proof = F.struct(F.lit(verdict.PROOF_STRATEGY).alias("strategy"), subject.alias("subject"), F.lit(True).alias("observable"), F.lit("").alias("reason"),
        verdict.proof_evidence(F.when(k % 6 == 5, F.lit("old")).otherwise(F.col("c_mktsegment")), F.lit(verdict.PURITY[0]), F.lit(verdict.PROOF_STRATEGY), F.lit("p"), k.cast("string"), F.lit(True), F.lit("")).alias("evidence"))
    kept = F.struct(F.lit("g").alias("toolchain"), F.lit("g").alias("build_config"), F.when(k % 17 == 0, "m").otherwise("").alias("machine"), F.lit("").alias("runtime_config"))
    own = {"subject": subject, "maximal_closure": F.col("c_mktsegment"), "test_variant_closure": F.lit("T"), "observation_assertion": F.lit(verdict.PURITY[0]), "proof": proof, "guards": kept, "purity_assertion": F.lit(""),
        "dynamic_state_strategy": F.lit(verdict.STRATEGY), "runtime_inputs": F.concat(F.lit("M"), text("c_nationkey")), "runtime_digest": F.lit("D"), "result_kind": F.lit(1)}
    recordings = t(spark, d, "customer").select(*[v.alias(n) for n, v in own.items()])
    now = {"subject": subject, "hash": F.when(k % 8 == 3, "moved").otherwise(F.col("c_mktsegment")), "test_variants": F.lit("T"), "guards": F.struct(F.lit("g").alias("toolchain"), F.lit("g").alias("build_config"), F.lit("").alias("machine"), F.lit("").alias("runtime_config")), "purity": F.lit(""), "unverifiable": k % 3 == 0, "reason": F.lit(""), "external": F.lit(False)}
    current = t(spark, d, "customer").select(*[v.alias(n) for n, v in now.items()])
    runtime = t(spark, d, "nation").select(F.concat(F.lit("M"), text("n_nationkey")).alias("manifest"), F.lit(True).alias("ok"), F.when(F.col("n_nationkey") == 4, "E").otherwise("D").alias("digest"), (F.col("n_nationkey") == 5).alias("unverifiable"), F.lit("").alias("reason"))
    return recordings, current, runtime


_CHECKED = """SELECT c_custkey::VARCHAR AS symbol, CASE WHEN c_custkey % 8 = 3 THEN 'stale' WHEN c_nationkey = 4 THEN 'stale' WHEN c_nationkey = 5 THEN 'unverifiable' WHEN c_custkey % 3 = 0 {} THEN 'unverifiable' ELSE 'valid' END AS status,
  CASE WHEN c_custkey % 8 = 3 THEN 'closure' WHEN c_nationkey = 4 THEN 'runtimeinputs' WHEN c_nationkey = 5 THEN 'runtime inputs' WHEN c_custkey % 3 = 0 {} THEN 'external dependence' ELSE '' END AS reason FROM customer WHERE c_custkey % 17 <> 0"""


@query(_CHECKED.format("", ""))
def batch_verdicts(spark, d):
    found, _ = verdict.check(*_recordings(spark, d))
    return found.select("subject.symbol", "verdict.status", "verdict.reason")


@query(_CHECKED.format("AND c_custkey % 6 = 5", "AND c_custkey % 6 = 5"))
def observed_verdicts(spark, d):
    """A proof under this closure stands in for what is not verifiable; one under another does not."""
    found, _ = verdict.check(*_recordings(spark, d), observed=True)
    return found.select("subject.symbol", "verdict.status", "verdict.reason")


@query("""SELECT DISTINCT 'M' || c_nationkey AS manifest FROM customer""")
def distinct_runtime_states(spark, d):
    return verdict.distinct_manifests(_recordings(spark, d)[0])


@query(f"""SELECT symbol, CASE WHEN c_nationkey = 6 THEN 'stale' ELSE status END AS status, CASE WHEN c_nationkey = 6 THEN 'runtimeinputs' ELSE reason END AS reason FROM ({_CHECKED.format('', '')}) JOIN customer ON symbol = c_custkey::VARCHAR""")
def demoted_verdicts(spark, d):
    """What moved between the two looks is stale."""
    recordings, current, runtime = _recordings(spark, d)
    found, _ = verdict.check(recordings, current, runtime)
    closing = runtime.withColumn("digest", F.when(F.col("manifest") == "M6", "moved").otherwise(F.col("digest")))
    found = verdict.demote_moved(found, runtime, closing, recordings.select("subject", F.col("runtime_inputs").alias("manifest")))
    return found.select("subject.symbol", "verdict.status", "verdict.reason")


@query("""SELECT c_custkey AS symbol, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS maximal_closure, 'm' AS machine, 2 AS result_kind FROM customer""")
def captured_recordings(spark, d):
    rows = t(spark, d, "customer").select(F.lit("p").alias("package"), F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("hash"), F.lit("T").alias("test_variants"))
    kept = spark.range(1).select(F.lit("g").alias("toolchain"), F.lit("g").alias("build_config"), F.lit("m").alias("machine"), F.lit("r").alias("runtime_config"))
    found = snapshot.capture(rows.select("package", "symbol"), rows.filter("symbol % 4 <> 0"), kept, verdict.STRATEGY, 2)
    return found.select("subject.symbol", "maximal_closure", "guards.machine", "result_kind")


@query("SELECT c_custkey AS symbol FROM customer WHERE c_nationkey % 3 = 0")
def missing_subjects(spark, d):
    rows = t(spark, d, "customer")
    snap = snapshot.Snapshot({}, rows.select(F.col("c_custkey").alias("symbol")))
    return snap.missing(rows.filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("symbol")))
