"""One query for each operator family, over the driver's tables in the shape that the operator takes, with DuckDB SQL for
the same rows. A table's rows stand in for facts: generations are made of it by rules on its keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, paths, rules
from ..operators import attribution, bracket, dynstate, effects, explain, fixpoint, guards, inputs, ledger, manifest, snapshot, verdict
from ..session import shared_dir
from ..sources.memo import Memo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str):
    return F.col(c).cast("string")


# ---- folds and digests


@query("""SELECT o_custkey, left(sha256(string_agg(DISTINCT line, chr(10) ORDER BY line)), 32) AS hash
FROM (SELECT o_custkey, o_orderkey::VARCHAR || chr(0) || sha256(o_orderpriority) || chr(10) AS line FROM orders) GROUP BY o_custkey""")
def fold_by_group(spark, d):
    line = digest.file_line(text("o_orderkey"), F.sha2(F.col("o_orderpriority").cast("binary"), 256))
    return t(spark, d, "orders").groupBy("o_custkey").agg(digest.fold(line).alias("hash"))


@query("""SELECT c_custkey, left(sha256(octet_length(encode(h))::VARCHAR || ':' || h || octet_length(encode(c_mktsegment))::VARCHAR || ':' || c_mktsegment
  || octet_length(encode(c_name))::VARCHAR || ':' || c_name), 32) AS salted FROM (SELECT *, left(sha256(c_nationkey::VARCHAR), 32) AS h FROM customer)""")
def salted_fold(spark, d):
    h = digest.short(text("c_nationkey"))
    return t(spark, d, "customer").select("c_custkey", digest.short(digest.framed(h, F.col("c_mktsegment"), F.col("c_name"))).alias("salted"))


@query("""SELECT event_id, left(sha256(CASE WHEN event_type = 'view' THEN 'false ' ELSE 'true ' END || sha256(CASE WHEN event_type = 'view' THEN '' ELSE props END)), 32) AS digest FROM events""")
def env_entry_digest(spark, d):
    return t(spark, d, "events").select("event_id", digest.env_entry(F.when(F.col("event_type") != "view", F.col("props"))).alias("digest"))


@query("""SELECT c_custkey, left(sha256('GOGC=' || c_mktsegment || chr(10) || 'GODEBUG=' || chr(10) || 'GOMEMLIMIT=' || c_name || chr(10) || 'GOMAXPROCS=' || chr(10)), 32) AS runtime_config FROM customer""")
def runtime_config_digest(spark, d):
    env = F.create_map(F.lit("GOGC"), F.col("c_mktsegment"), F.lit("GOMEMLIMIT"), F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", digest.runtime_config(env).alias("runtime_config"))


# ---- guards and verdicts

_RECORDED = ("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN kind NOT IN (1, 2) THEN 'kind' WHEN r1 = '' OR r1 <> c1 THEN 'toolchain' WHEN r2 = '' OR r2 <> c2 THEN 'buildconfig'
  WHEN kind = 2 AND (r3 = '' OR r3 <> c3) THEN 'machine' WHEN kind = 2 AND (r4 = '' OR r4 <> c4) THEN 'runtimeconfig' ELSE '' END AS mismatch
FROM (SELECT o_orderkey, 1 + o_orderkey % 2 AS kind, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS r1, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS c1,
  o_orderpriority AS r2, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS c2, o_custkey::VARCHAR AS r3, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS c3,
  o_orderkey::VARCHAR AS r4, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS c4 FROM orders)""")
def guard_first_mismatch(spark, d):
    k = F.col("o_orderkey")
    names = ("toolchain", "build_config", "machine", "runtime_config")
    recorded = F.struct(F.when(k % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("toolchain"), *[text(c).alias(n) for c, n in list(zip(_RECORDED, names))[1:]])
    current = F.struct(*[F.when(k % m == 0, v).otherwise(text(c)).alias(n) for c, n, m, v in zip(_RECORDED, names, (5, 7, 3, 13), ("x", "x", "x", ""))])
    rows = t(spark, d, "orders").select("o_orderkey", recorded.alias("r"), current.alias("c"), (1 + k % 2).cast("int").alias("kind"))
    return rows.select("o_orderkey", guards.first_mismatch(F.col("r"), F.col("c"), F.col("kind")).alias("mismatch"))


def _generation(orders: DataFrame, current: bool) -> DataFrame:
    """A fold of each customer's orders; the current generation has some changed and some dropped."""
    k = F.col("o_orderkey")
    rows = orders.filter(k % 101 != 0) if current else orders
    value = F.when(k % 97 == 0, F.lit("moved")).otherwise(F.col("o_orderpriority")) if current else F.col("o_orderpriority")
    line = digest.file_line(text("o_orderkey"), F.sha2(value.cast("binary"), 256))
    return rows.groupBy("o_custkey").agg(digest.fold(line).alias("hash"))


def _gen_sql(current: bool) -> str:
    value = "CASE WHEN o_orderkey % 97 = 0 THEN 'moved' ELSE o_orderpriority END" if current else "o_orderpriority"
    return f"""SELECT o_custkey, left(sha256(string_agg(line, chr(10) ORDER BY line)), 32) AS hash FROM (SELECT o_custkey, o_orderkey::VARCHAR || chr(0) || sha256({value}) || chr(10) AS line
      FROM orders {"WHERE o_orderkey % 101 <> 0" if current else ""}) GROUP BY o_custkey"""


@query(f"""WITH r AS ({_gen_sql(False)}), c AS ({_gen_sql(True)}),
j AS (SELECT r.o_custkey AS k, r.hash AS rh, coalesce(c.hash, '') AS ch FROM r LEFT JOIN c USING (o_custkey)),
v AS (SELECT k, CASE
  WHEN rh = ch AND (k % 17 = 0 OR k % 19 = 0) THEN ['stale', 'test variants'] WHEN rh <> ch THEN ['stale', 'closure'] WHEN k % 23 = 0 THEN ['stale', 'dynamic-state strategy']
  WHEN k % 5 = 0 AND k % 29 = 0 THEN ['stale', 'runtimeinputs'] WHEN k % 5 <> 0 AND (k % 31 = 0) THEN ['stale', 'runtimeinputs'] WHEN k % 37 = 0 THEN ['stale', 'toolchain']
  WHEN k % 41 = 0 THEN ['unverifiable', 'external directive'] WHEN k % 3 <> 0 AND k % 5 <> 0 AND k % 43 = 0 THEN ['unverifiable', 'runtime inputs']
  WHEN k % 3 <> 0 AND k % 7 = 0 AND NOT (k % 2 = 0 AND k % 5 <> 0 AND k % 14 <> 0) THEN ['unverifiable', CASE WHEN k % 14 = 0 THEN 'shared dynamic state: x' ELSE 'external dependence' END]
  ELSE ['valid', ''] END AS v FROM j)
SELECT k AS o_custkey, v[1] AS status, v[2] AS reason FROM v""")
def verdict_ladder(spark, d):
    """Recorded against current folds of each customer's orders, through evidence, guards and what comes after."""
    orders = t(spark, d, "orders")
    k = F.col("o_custkey")
    rows = _generation(orders, False).join(_generation(orders, True).withColumnRenamed("hash", "now"), "o_custkey", "left")
    tests = F.when(k % 17 == 0, F.lit("")).otherwise(F.lit("T"))
    early = verdict.evidence(F.col("hash"), F.col("now"), tests, F.when(k % 19 == 0, F.lit("U")).otherwise(F.lit("T")), F.when(k % 23 == 0, F.lit("old")).otherwise(F.lit(verdict.STRATEGY)))
    names = ("toolchain", "build_config", "machine", "runtime_config")
    rec = F.struct(*[F.lit("g").alias(n) for n in names])
    cur = F.struct(F.when(k % 37 == 0, "x").otherwise("g").alias("toolchain"), *[F.lit("g").alias(n) for n in names[1:]])
    held = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("M"))
    recorded = F.when(k % 5 != 0, F.lit("D")).when(k % 29 == 0, F.lit("D")).otherwise(F.lit(""))
    known = verdict.known_guards(held, recorded, F.lit(True), F.when(k % 31 == 0, F.lit("E")).otherwise(F.lit("D")), rec, cur, F.lit(1))
    reason = F.when(k % 14 == 0, F.lit("shared dynamic state: x")).otherwise(F.lit(""))
    late = verdict.after_guards(k % 41 == 0, k % 3 == 0, held, k % 43 == 0, F.lit(""), k % 7 == 0, reason, k % 2 == 0)
    rows = rows.withColumn("v", F.coalesce(early, known, late))
    return rows.select("o_custkey", "v.status", "v.reason")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, left(sha256(octet_length(encode(l_linestatus))::VARCHAR || ':' || l_linestatus || '16:caller assertion' || '13:observation/1' || '1:p' || octet_length(encode(l_returnflag))::VARCHAR || ':' || l_returnflag || CASE WHEN l_linenumber = 1 THEN 'true' ELSE 'false' END || CASE WHEN l_linenumber = 1 THEN '0:' ELSE '1:r' END), 32) AS evidence,
  l_linenumber = 1 OR l_linestatus = 'O' AS told FROM lineitem""")
def proof_evidence(spark, d):
    ok = F.col("l_linenumber") == 1
    e = verdict.proof_evidence(F.col("l_linestatus"), F.lit(verdict.PURITY[0]), F.lit(verdict.PROOF_STRATEGY), F.lit("p"), F.col("l_returnflag"), ok, F.when(ok, "").otherwise("r"))
    return t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), e.alias("evidence"), (ok | (F.col("l_linestatus") == "O")).alias("told"))


# ---- ledgers

_LEDGER = "SELECT l_orderkey, l_linenumber, sha256(l_returnflag || '/' || l_linestatus || '/' || l_quantity::INTEGER::VARCHAR) AS h FROM lineitem"
_AFTER = "SELECT l_orderkey, l_linenumber, sha256(CASE WHEN l_orderkey % 7 = 0 THEN 'X' ELSE l_returnflag END || '/' || l_linestatus || '/' || l_quantity::INTEGER::VARCHAR) AS h FROM lineitem WHERE l_orderkey % 11 <> 0"
_DIFF = f"""b AS (SELECT l_orderkey, l_linenumber, h, count(*) AS n FROM ({_LEDGER}) WHERE l_orderkey % 13 <> 0 GROUP BY ALL), a AS (SELECT l_orderkey, l_linenumber, h, count(*) AS n FROM ({_AFTER}) GROUP BY ALL),
o AS (SELECT l_orderkey, l_linenumber, h, coalesce(b.n, 0) - coalesce(a.n, 0) AS over FROM b FULL JOIN a USING (l_orderkey, l_linenumber, h)),
s AS (SELECT l_orderkey, l_linenumber, h, over > 0 AS side, unnest(range(1, abs(over) + 1)) AS copy FROM o WHERE over <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, side ORDER BY h, copy) AS nth FROM s),
d AS (SELECT l_orderkey, l_linenumber, nth, max(h) FILTER (side) AS before_hash, max(h) FILTER (NOT side) AS after_hash FROM p GROUP BY ALL),
x AS (SELECT *, CASE WHEN before_hash IS NULL THEN 'added' WHEN after_hash IS NULL THEN 'removed' ELSE 'changed' END AS op FROM d)"""


def _ledger(spark, d, after: bool) -> DataFrame:
    rows = t(spark, d, "lineitem")
    flag = F.when(F.col("l_orderkey") % 7 == 0, "X").otherwise(F.col("l_returnflag")) if after else F.col("l_returnflag")
    rows = rows.filter("l_orderkey % 11 <> 0") if after else rows.filter("l_orderkey % 13 <> 0")
    h = F.sha2(F.concat_ws("/", flag, "l_linestatus", F.col("l_quantity").cast("int").cast("string")).cast("binary"), 256)
    return rows.select("l_orderkey", "l_linenumber", h.alias("hash"))


@query(f"WITH {_DIFF} SELECT l_orderkey, l_linenumber, op, before_hash, after_hash FROM x")
def ledger_diff(spark, d):
    return ledger.diff(_ledger(spark, d, False), _ledger(spark, d, True), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {_DIFF} SELECT l_orderkey AS package, bool_and(op = 'added' AND l_linenumber NOT IN (3, 4)) AS inert FROM x GROUP BY l_orderkey
UNION ALL SELECT DISTINCT l_orderkey, true FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM x)""")
def ledger_inert(spark, d):
    delta = ledger_diff(spark, d)
    kind = F.when(F.col("l_linenumber") == 4, "var").when(F.col("l_linenumber") == 1, "const").when(F.col("l_linenumber") == 2, "type").otherwise("func")
    named = delta.select(F.col("l_orderkey").alias("package"), "op", kind.alias("kind"), F.when(F.col("l_linenumber") == 3, "TestMain").otherwise("f").alias("name"))
    none = spark.createDataFrame([], "package bigint, embedded boolean")
    return ledger.inert(named, none, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("package")))


_POS = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS n FROM lineitem"


@query(f"SELECT l_orderkey, n::INTEGER AS position, sha256(l_returnflag || l_linestatus || chr(0) || n::VARCHAR) AS digest FROM ({_POS})")
def positional_digest(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = t(spark, d, "lineitem").withColumn("position", ledger.ordinal(["l_orderkey"], order))
    return rows.select("l_orderkey", "position", ledger.positional(F.concat("l_returnflag", "l_linestatus"), F.col("position")).alias("digest"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS governing FROM events""")
def carry_forward_const(spark, d):
    rows = t(spark, d, "events").withColumn("v", F.when(F.col("event_type").isin("signup", "purchase"), F.col("props")))
    return rows.select("event_id", "user_id", ledger.governing("v", ["user_id"], ["ts", "event_id"]).alias("governing"))


@query("""SELECT process, seq, op, coalesce(last_value(CASE WHEN op = 'chdir' THEN name END IGNORE NULLS) OVER w, '/pkg') AS cwd, coalesce(max(op = 'chdir') OVER w, false) AS after_chdir
FROM (SELECT user_id::VARCHAR AS process, event_id AS seq, CASE event_type WHEN 'signup' THEN 'chdir' WHEN 'click' THEN 'stat' ELSE 'open' END AS op, '/d' || (event_id % 7)::VARCHAR AS name FROM events)
WINDOW w AS (PARTITION BY process ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cwd_carry(spark, d):
    kind = F.when(F.col("event_type") == "signup", "chdir").when(F.col("event_type") == "click", "stat").otherwise("open")
    log = t(spark, d, "events").select(text("user_id").alias("process"), F.col("event_id").alias("seq"), F.concat(kind, F.lit(" /d"), (F.col("event_id") % 7).cast("string")).cast("binary").alias("line"))
    ops = inputs.parse(log)
    dirs = ops.select("process").distinct().withColumn("package_dir", F.lit("/pkg"))
    return inputs.working_directories(ops, dirs).select("process", "seq", "op", "cwd", "after_chdir")


@query("""WITH b AS (SELECT source, sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL), a AS (SELECT source, sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL)
SELECT source, h, side, unnest(range(0, n)) * 0 AS extra FROM (
SELECT b.source, b.h, 0 AS side, b.n - coalesce(a.n, 0) AS n FROM b LEFT JOIN a USING (source, h) UNION ALL SELECT a.source, a.h, 1, a.n - coalesce(b.n, 0) FROM a LEFT JOIN b USING (source, h)) WHERE n > 0""")
def multiset_except(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    a, b = rows.filter("doc_id % 3 <> 0").drop("doc_id"), rows.filter("doc_id % 5 <> 0").drop("doc_id")
    return snapshot.differences(a, b).select("source", "h", "side", F.lit(0).cast("bigint").alias("extra"))


# ---- manifests, paths, brackets


def _parts(spark, d, current: bool) -> DataFrame:
    k = F.col("p_partkey")
    rows = t(spark, d, "part")
    value = F.when(k % 9 == 0, F.lit("moved")).otherwise(F.col("p_name")) if current else F.col("p_name")
    rows = rows.filter(k % 14 != 0) if current else rows
    return rows.select(F.col("p_brand").alias("manifest_id"), F.lit("rel").alias("kind"), text("p_partkey").alias("ident"), digest.short(value).alias("digest"))


@query("SELECT p_brand AS manifest_id, 'rel' AS kind, p_partkey::VARCHAR AS ident FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 14 = 0")
def moved_inputs(spark, d):
    return manifest.moved(_parts(spark, d, False), _parts(spark, d, True))


@query("""SELECT user_id % 50 AS manifest_id, 'env' AS kind, event_type || '/' || (event_id % 40)::VARCHAR AS ident, min(left(sha256('true ' || sha256(event_type)), 32)) AS digest FROM events GROUP BY ALL""")
def merge_manifests(spark, d):
    rows = t(spark, d, "events").select((F.col("user_id") % 50).alias("g"), F.lit("env").alias("kind"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 40).cast("string")).alias("ident"), digest.env_entry(F.col("event_type")).alias("digest"))
    one, two = rows.filter("g % 2 = 0"), rows.filter("g % 2 = 1")
    return manifest.merge(one.unionByName(two).unionByName(one), "g")


_URL_PATH = "regexp_replace(url, '^https?:/', '')"


@query(f"""WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages), r AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS root FROM p WHERE page_id % 3 = 0)
SELECT page_id, bool_or(path = root OR starts_with(path, root || '/')) AS covered FROM (SELECT page_id, rtrim(regexp_replace(path, '/+', '/', 'g'), '/') AS path FROM p), r GROUP BY page_id""")
def coverage_prefix_join(spark, d):
    path = F.regexp_replace("url", "^https?:/", "")
    rows = t(spark, d, "pages").select("page_id", path.alias("path"))
    roots = rows.filter("page_id % 3 = 0").select(F.concat(F.lit("/"), F.split("path", "/")[1]).alias("root")).distinct()
    objects = rows.select(F.col("page_id").alias("id"), F.rtrim(F.regexp_replace("path", "/+", "/"), F.lit("/")).alias("resolved"), F.array().cast("array<string>").alias("links"))
    return bracket.covered(objects, roots).select(F.col("id").alias("page_id"), "covered")


@query(f"""WITH p AS (SELECT page_id, rtrim({_URL_PATH}, '/') AS path FROM pages), x AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:3], '/') AS e FROM p WHERE page_id % 10 = 0)
SELECT page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE path = e OR starts_with(path, e || '/'))""")
def exclusion_anti(spark, d):
    rows = t(spark, d, "pages").select("page_id", F.rtrim(F.regexp_replace("url", "^https?:/", ""), F.lit("/")).alias("path"))
    exclusions = rows.filter("page_id % 10 = 0").select(F.array_join(F.slice(F.split("path", "/"), 1, 3), "/").alias("path")).distinct()
    return bracket.without_excluded(rows, exclusions).select("page_id")


@query("""SELECT conv_id, role, text, min(turn) AS turn FROM conversations GROUP BY ALL""")
def dedupe_first_seen(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("process"), F.col("role").alias("kind"), F.col("text").alias("ident"), F.col("turn").alias("seq"), F.lit(False).alias("bound"))
    return inputs.first_seen(rows).select(F.col("process").alias("conv_id"), F.col("kind").alias("role"), F.col("ident").alias("text"), F.col("seq").alias("turn"))


@query("""WITH m AS (SELECT user_id % 200 AS g, event_type, min(props) AS p FROM events GROUP BY ALL), a AS (SELECT g, to_json({'v': 1, 'env': list({'n': event_type, 'd': left(sha256('true ' || sha256(p)), 32)} ORDER BY event_type)})::VARCHAR AS j FROM m GROUP BY g)
SELECT g AS manifest_id, rtrim(translate(to_base64(encode(j)), '+/', '-_'), '=') AS manifest, true AS round_trip FROM a""")
def manifest_codec(spark, d):
    rows = t(spark, d, "events").groupBy((F.col("user_id") % 200).alias("manifest_id"), "event_type").agg(F.min("props").alias("p"))
    rows = rows.select("manifest_id", F.lit("env").alias("kind"), F.col("event_type").alias("ident"), digest.env_entry(F.col("p")).alias("digest"))
    folded = manifest.fold(rows)
    return folded.select("manifest_id", "manifest", F.coalesce(F.size(manifest.decode(F.col("manifest"))["env"]) > 0, F.lit(False)).alias("round_trip"))


@query("""SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, NOT regexp_matches(text, '[\\x00\\r\\n]') AS representable FROM documents""")
def text_utf8_refuse(spark, d):
    return t(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), paths.representable(F.col("text")).alias("representable"))


@query("""SELECT page_id, CASE WHEN p = '/mod' OR starts_with(p, '/mod/') THEN 'rel' WHEN starts_with(p, '/proc/') THEN NULL WHEN page_id % 4 = 3 THEN NULL ELSE 'abs' END AS kind,
 CASE WHEN starts_with(p, '/proc/') THEN 'volatile OS input: ' || p WHEN page_id % 4 = 3 THEN 'external directory input: ' || p END AS reason
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/mod/' WHEN 1 THEN '/proc/' ELSE '/ext/' END || page_id::VARCHAR AS p FROM pages)""")
def path_classes(spark, d):
    k = F.col("page_id")
    p = F.concat(F.when(k % 4 == 0, "/mod/x/../").when(k % 4 == 1, "//proc/./").otherwise("/ext/"), k.cast("string"))
    state = F.struct((k % 4 != 2).alias("exists"), F.when(k % 4 == 3, "dir").otherwise("file").alias("kind"))
    c = inputs.classify(F.lit("/mod"), paths.clean(p), state)
    return t(spark, d, "pages").select("page_id", c["kind"].alias("kind"), c["reason"].alias("reason"))


# ---- effects


@query("""WITH e AS (SELECT user_id, event_type AS reason, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 0 END AS rank FROM events)
SELECT user_id, arg_min(reason, row(-rank, reason)) AS reason FROM e GROUP BY user_id""")
def effect_rank_argmax(spark, d):
    kind = F.when(F.col("event_type") == "error", rules.KIND["network"]).when(F.col("event_type") == "purchase", rules.KIND["file_io"]).when(F.col("event_type") == "signup", rules.KIND["environment"]).otherwise(rules.KIND["unaudited_standard"])
    rows = t(spark, d, "events").select("user_id", kind.alias("kind"), F.lit("os").alias("package_path"), F.lit("").alias("symbol"), F.lit("").alias("detail"), F.col("event_type").alias("reason"), F.lit(False).alias("unrefinable"), F.lit(False).alias("observable"))
    return effects.preferred_reason(rows, "user_id")


@query("""SELECT l_orderkey * 10 + l_linenumber AS fn, CASE l_linenumber WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 5 THEN 12 ELSE 7 END AS kind,
  CASE l_linenumber WHEN 1 THEN 'reaches os.ReadFile (file I/O)' WHEN 2 THEN 'reaches os.Getenv (environment input)' WHEN 3 THEN 'reaches fmt.Println (formatted output)' WHEN 5 THEN 'reaches unaudited standard operation reflect.ValueOf' ELSE 'reaches testing.Log (test harness logging)' END AS reason
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <> 4""".replace("WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2", "WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2"))
def effect_rules_join(spark, d):
    n = F.col("l_linenumber")
    pick = lambda *names: F.when(n == 1, names[0]).when(n == 2, names[1]).when(n == 3, names[2]).when(n == 4, names[3]).when(n == 5, names[4]).otherwise(names[5])
    calls = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("fn"), pick("os", "os", "fmt", "fmt", "reflect", "testing").alias("pkg"), pick("ReadFile", "Getenv", "Println", "Sprintf", "ValueOf", "Log").alias("symbol"), F.lit(True).alias("std"), F.lit(False).alias("writer_in_memory")).distinct()
    return effects.classify(calls).select("fn", "kind", "reason")


# ---- call graphs and fixpoints


@query("""WITH s AS (SELECT s_suppkey AS site, s_nationkey AS sig, 1::BIGINT << (s_suppkey % 40)::INTEGER AS m FROM supplier), f AS (SELECT c_custkey AS fn, c_nationkey AS sig, (1::BIGINT << (c_custkey % 40)::INTEGER) | (1::BIGINT << (c_custkey % 7)::INTEGER) AS m FROM customer)
SELECT site, fn, s.m & f.m AS mask FROM s JOIN f USING (sig) WHERE s.m & f.m <> 0""")
def mask_conjunct_join(spark, d):
    sites = t(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("sig"), attribution.subject_bit(F.col("s_suppkey") % 40).alias("mask"))
    k = F.col("c_custkey")
    functions = t(spark, d, "customer").select(k.alias("fn"), F.col("c_nationkey").alias("sig"), attribution.subject_bit(k % 40).bitwiseOR(attribution.subject_bit(k % 7)).alias("mask"))
    return attribution.mask_conjunct(sites, functions)


@query("""WITH m AS (SELECT DISTINCT o_custkey AS type, o_orderpriority AS method FROM orders), i AS (SELECT DISTINCT c_mktsegment AS iface, o_orderpriority AS method FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT iface, count(*) AS n FROM i GROUP BY iface) SELECT type, iface FROM m JOIN i USING (method) JOIN w USING (iface) GROUP BY type, iface, n HAVING count(*) = n""")
def implements_division(spark, d):
    orders, customer = t(spark, d, "orders"), t(spark, d, "customer")
    methods = orders.select(F.col("o_custkey").alias("type"), F.col("o_orderpriority").alias("method"))
    ifaces = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("iface"), F.col("o_orderpriority").alias("method"))
    return attribution.implements(methods, ifaces)


def _graph(spark, d) -> DataFrame:
    """Each part leads to two others, by its number."""
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return parts.select(F.col("k").alias("src"), F.explode(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3) + F.col("s") % 5)).alias("dst"))


_GRAPH = "SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3 + p_size % 5]) AS dst FROM part"


@query(f"""WITH RECURSIVE g AS ({_GRAPH}), r(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 1 UNION SELECT dst FROM r JOIN g ON src = node) SELECT node FROM r""")
def reach_from_seed(spark, d):
    return fixpoint.reach(_graph(spark, d), t(spark, d, "part").filter("p_partkey % 97 = 1").select(F.col("p_partkey").alias("node")))


@query(f"""WITH RECURSIVE g AS ({_GRAPH}), r(subject, node) AS (SELECT p_partkey % 8, p_partkey FROM part WHERE p_partkey % 97 = 1 UNION SELECT subject, dst FROM r JOIN g ON src = node)
SELECT node, bit_or(1::BIGINT << subject::INTEGER) AS mask, count(*) AS subjects FROM r GROUP BY node""")
def attributed_reach(spark, d):
    """Rows and masks, joined: the masks' bits are as many as the rows."""
    graph = _graph(spark, d)
    seeds = t(spark, d, "part").filter("p_partkey % 97 = 1").select((F.col("p_partkey") % 8).alias("subject"), F.col("p_partkey").alias("node"))
    rows = fixpoint.reach(graph, seeds, ["subject"]).groupBy("node").agg(F.count("*").alias("subjects"))
    masks = fixpoint.reach_masks(graph, seeds.select("node", attribution.subject_bit(F.col("subject")).alias("mask")))
    return rows.join(masks, "node").select("node", "mask", "subjects")


@query(f"""WITH RECURSIVE g AS (SELECT src, dst FROM ({_GRAPH}) WHERE dst < src AND src >= 20), bad(node) AS (SELECT dst FROM g WHERE dst NOT IN (SELECT src FROM g) AND dst % 4 = 0 UNION SELECT src FROM bad JOIN g ON dst = node)
SELECT DISTINCT src AS node FROM g WHERE src NOT IN (SELECT node FROM bad) UNION SELECT DISTINCT dst FROM g WHERE dst NOT IN (SELECT src FROM g) AND dst % 4 <> 0""")
def least_proof(spark, d):
    """Dependencies without cycles, where what fails is exactly what reaches a leaf that is no axiom."""
    deps = _graph(spark, d).filter("dst < src and src >= 20").select(F.col("src").alias("own"), F.col("dst").alias("dep"))
    leaves = deps.select(F.col("dep").alias("node")).distinct().join(deps.select(F.col("own").alias("node")), "node", "left_anti")
    return fixpoint.least_proof(leaves.filter("node % 4 <> 0"), deps)


@query(f"""WITH RECURSIVE g AS (SELECT src AS own, dst AS dep FROM ({_GRAPH}) WHERE dst < src), s(node) AS (SELECT dep FROM g WHERE dep % 211 = 5 AND dep IN (SELECT own FROM g) UNION SELECT dep FROM g WHERE dep NOT IN (SELECT own FROM g) AND dep % 3 = 0),
f(node) AS (SELECT node FROM s UNION SELECT own FROM f JOIN g ON dep = node) SELECT node FROM f WHERE node % 211 = 5 AND node IN (SELECT own FROM g) OR node NOT IN (SELECT node FROM s) OR node IN (SELECT own FROM g)""")
def opacity_falls(spark, d):
    deps = _graph(spark, d).filter("dst < src").select(F.col("src").alias("own"), F.col("dst").alias("dep"))
    owners = deps.select(F.col("own").alias("node")).distinct()
    leaves = deps.select(F.col("dep").alias("node")).distinct().join(owners, "node", "left_anti")
    declared = owners.unionByName(leaves.filter("node % 3 <> 0"))
    return fixpoint.fallen(owners.filter("node % 211 = 5").join(deps.select(F.col("dep").alias("node")), "node", "left_semi"), deps, declared)


@query("""WITH RECURSIVE l AS (SELECT DISTINCT 2 * l_suppkey AS a, 2 * l_partkey + 1 AS b FROM lineitem), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS own ON own.node = e.b WHERE r.root < own.root GROUP BY e.b)
SELECT node, root FROM r""")
def carrier_components(spark, d):
    """Every link of lineitem, none left out; suppliers are the even nodes, parts the odd ones."""
    links = t(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()
    return fixpoint.components(links)


@query("""WITH RECURSIVE r AS (SELECT 'f' || p_partkey AS callee, CASE WHEN p_partkey % 50 = 49 THEN 'prog' WHEN p_partkey < 20 THEN 'init' ELSE 'f' || (p_partkey // 2) END AS region FROM part),
bad(node) AS (SELECT callee FROM r WHERE region = 'prog' UNION SELECT callee FROM bad JOIN r ON region = node) SELECT DISTINCT callee AS node FROM r WHERE callee NOT IN (SELECT node FROM bad)""")
def init_only_forall(spark, d):
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    region = F.when(k % 50 == 49, "prog").when(k < 20, "init").otherwise(name(F.floor(k / 2)))
    return fixpoint.init_only(t(spark, d, "part").select(name(k).alias("callee"), region.alias("region")).distinct())


@query("""WITH p AS (SELECT DISTINCT n_regionkey AS root, 'm' || s_nationkey || '@v' || (s_nationkey % 4) AS pin, s_nationkey % 11 = 3 AS local FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT 'region' || root % 3 || '@v1' AS pin, pin AS there, local FROM p UNION SELECT DISTINCT 'region' || root % 3 || '@v1', 'region' || root % 3 || '@v1', false FROM p)
SELECT pin, pin || '|' || left(sha256('[' || string_agg(DISTINCT '"' || there || '"', ' ' ORDER BY '"' || there || '"') || ']'), 16) AS bucket FROM m GROUP BY pin HAVING NOT bool_or(local)""")
def cone_digest(spark, d):
    """Regions as packages of three pinned modules over the nations with suppliers; a module with a local nation in the cone
    of any of its packages has no key."""
    pairs = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "s_nationkey").distinct()
    root, leaf = F.concat(F.lit("r"), text("n_regionkey")), F.concat(F.lit("n"), text("s_nationkey"))
    imports = pairs.select(root.alias("import_path"), leaf.alias("imported"))
    local = F.col("s_nationkey") % 11 == 3
    pin = F.concat(F.lit("m"), text("s_nationkey"), F.lit("@v"), (F.col("s_nationkey") % 4).cast("string"))
    module = F.concat(F.lit("region"), (F.col("n_regionkey") % 3).cast("string"), F.lit("@v1"))
    nodes = pairs.select(leaf.alias("import_path"), F.when(local, "mutable_local").otherwise("pinned").alias("class"), pin.alias("pin")).distinct()
    nodes = nodes.unionByName(pairs.select(root.alias("import_path"), F.lit("pinned").alias("class"), module.alias("pin")).distinct())
    return dynstate.buckets(nodes, imports).filter(F.startswith("pin", F.lit("region")))


@query("""SELECT c_custkey AS package, coalesce(bool_and(o_orderkey % 6 <> 0), true) AS complete FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def rooted_vacuous_and(spark, d):
    complete = t(spark, d, "orders").select(F.col("o_custkey").alias("package"), (F.col("o_orderkey") % 6 != 0).alias("complete"))
    none = spark.createDataFrame([], "package bigint, fn string")
    return attribution.rooted_package(none, complete, t(spark, d, "customer").select(F.col("c_custkey").alias("package")))[1]


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS pkg, 'v' || (l_partkey % 50) AS var_key, CASE l_linenumber % 3 WHEN 0 THEN 'mutation' WHEN 1 THEN 'escape' ELSE 'environment' END AS class FROM lineitem),
k AS (SELECT * FROM m WHERE NOT (class = 'escape' AND right(var_key, 1) = '3') AND NOT (pkg % 5 = 0 AND class = 'mutation')),
r AS (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY CASE class WHEN 'mutation' THEN 0 WHEN 'escape' THEN 1 ELSE 2 END, var_key) AS n FROM k) SELECT pkg, var_key, class FROM r WHERE n = 1""")
def culprit_rank(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.concat(F.lit("v"), (F.col("l_partkey") % 50).cast("string")).alias("v"), F.when(F.col("l_linenumber") % 3 == 0, "mutation").when(F.col("l_linenumber") % 3 == 1, "escape").otherwise("environment").alias("class")).distinct()
    key = F.concat(text("pkg"), F.lit(":"), "v")
    marks = rows.select(key.alias("var_key"), "class")
    declares = rows.select("pkg", key.alias("var_key"))
    opaque = rows.filter(F.endswith("v", F.lit("3"))).select(key.alias("var_key")).distinct()
    discharged = rows.filter("pkg % 5 = 0 and class = 'mutation'").select("pkg", key.alias("var_key"), "class")
    found = dynstate.culprits(marks, declares, opaque, discharged)
    return found.filter("first").select("pkg", F.regexp_replace("var_key", "^[0-9]+:", "").alias("var_key"), "class")


# ---- explanations, memo, snapshots


@query("""WITH r AS (SELECT DISTINCT source, lang || '-' || (doc_id % 9) AS v FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v) AS n, count(*) OVER (PARTITION BY source) AS size FROM r)
SELECT source, string_agg(v, ', ' ORDER BY v) FILTER (n <= 3) || CASE WHEN max(size) > 3 THEN ', and ' || (max(size) - 3) || ' more' ELSE '' END AS summary FROM n GROUP BY source""")
def first_three_more(spark, d):
    rows = t(spark, d, "documents").select("source", F.concat("lang", F.lit("-"), (F.col("doc_id") % 9).cast("string")).alias("v"))
    return verdict.first_three(rows, "source", "v")


@query("""WITH l AS (SELECT conv_id AS culprit, turn AS seq, turn % 13 = 12 AS p FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY culprit ORDER BY seq) AS nth, count(*) OVER (PARTITION BY culprit) AS total FROM l),
m AS (SELECT *, coalesce(max(CASE WHEN p AND nth >= 5 THEN nth END) OVER (PARTITION BY culprit), total) AS late FROM n)
SELECT culprit, seq, greatest(0, total - 5) AS omitted FROM m WHERE total <= 5 OR nth <= 4 OR nth = late""")
def bounded_chain(spark, d):
    links = t(spark, d, "conversations").select(F.col("conv_id").alias("culprit"), F.col("turn").alias("seq"), (F.col("turn") % 13 == 12).alias("protect"))
    return explain.bounded(links, 5).select("culprit", "seq", "omitted")


@query("""WITH r AS (SELECT source || '/' || (doc_id % 40) AS manifest_id, doc_id FROM documents)
SELECT manifest_id, bool_or(coalesce(NOT (quality = 1), true)) AS dirty FROM r LEFT JOIN labels USING (doc_id) GROUP BY manifest_id""")
def dirty_any(spark, d):
    rows = t(spark, d, "documents").select(F.concat("source", F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("manifest_id"), F.lit("rel").alias("kind"), text("doc_id").alias("ident"))
    return manifest.dirty(rows, t(spark, d, "labels").select(text("doc_id").alias("ident"), (F.col("quality") == 1).alias("reproducible")))


@query("""WITH d AS (SELECT DISTINCT sha256(text) AS h FROM documents), m AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 4 = 0)
SELECT h, h IN (SELECT h FROM m) AS hit, left(sha256(h), 32) AS result FROM d""")
def memo_hit_split(spark, d):
    """Distinct texts; those remembered are taken, the rest computed."""
    rows = t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    compute = lambda df: df.select("h", digest.short(F.col("h")).alias("result"))
    wanted, remembered = rows.select("h").distinct(), compute(rows.filter("doc_id % 4 = 0").select("h").distinct())
    memo = Memo(spark, f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}")
    memo.store("texts", "all", remembered)
    found = memo.split("texts", "all", wanted, ["h"], compute)
    return found.join(remembered.select("h", F.lit(True).alias("hit")), "h", "left").select("h", F.coalesce("hit", F.lit(False)).alias("hit"), "result")


@query("""SELECT * FROM (SELECT o_orderkey, 0 AS side FROM orders WHERE o_orderkey % 1000 = 7 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 1000 = 7)""")
def snapshot_agreement(spark, d):
    """Two observations that agree but for one order in a thousand: each such row from either side."""
    once = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    again = once.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1000 == 7, "?").otherwise(F.col("o_orderstatus")))
    view = snapshot.Snapshot.observe(lambda: {"orders": once}, once.select("o_orderkey"))
    return snapshot.differences(view.tables["orders"], again).select("o_orderkey", "side")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN 'subject' WHEN o_orderkey % 7 = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS field FROM orders WHERE o_orderkey % 31 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""")
def drift_first_field(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    now = rows.filter("k % 31 <> 0").select("k", F.when(F.col("k") % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("k") % 5 == 0, "?").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return snapshot.drift(rows, now, "k", ["o_orderstatus", "o_orderpriority"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def sibling_subset(spark, d):
    snap = snapshot.Snapshot({}, t(spark, d, "customer").select("c_custkey", "c_name"))
    some = t(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return snap.sibling(snap.subjects.join(some, "c_custkey").select("c_custkey", "c_name")).subjects
