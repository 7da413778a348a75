"""Shared dynamic state: facts of all packages composed into proofs, marks, culprits and their discharge.

dyn_facts in long form: pkg, variant, kind, var_key, fn_key, param_idx, dep_key, field, class, malformed. A malformed fact
proves nothing, and everything that it declares is marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digest import short
from ..session import pin
from .fixpoint import components, fallen, init_only, init_reach, least_proof, reach

#: Culprits by class, the gravest first.
CLASS_RANK = {"mutation": 0, "escape": 1, "environment": 2}


def of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.filter(F.col("kind").isin(*kinds) & ~F.coalesce("malformed", F.lit(True)))


def malformed_marks(facts: DataFrame) -> DataFrame:
    """(pkg, var_key) of all that packages with a malformed fact declare."""
    bad = facts.filter(F.coalesce("malformed", F.lit(True))).select("pkg").distinct()
    return facts.filter(F.col("kind") == "declares").join(bad, "pkg", "left_semi").select("pkg", "var_key").distinct()


def leak_free(facts: DataFrame) -> DataFrame:
    return least_proof(of(facts, "paramLeakFree").select(F.col("var_key").alias("node")), of(facts, "paramLeakFreeDeps").select(F.col("var_key").alias("own"), F.col("dep_key").alias("dep")))


def retention_free(facts: DataFrame, leaks: DataFrame) -> DataFrame:
    """A dependency is satisfied by either grade; a leak-free one needs no proof of its own."""
    return least_proof(of(facts, "paramRetentionFree").select(F.col("var_key").alias("node")), of(facts, "paramRetentionFreeDeps").select(F.col("var_key").alias("own"), F.col("dep_key").alias("dep")), also=leaks)


def opaque(facts: DataFrame) -> DataFrame:
    """(var_key): opaque in every fact that declares it, not broken by any, and not chained to one that falls."""
    declares = facts.filter(F.col("kind") == "declares").select("pkg", "variant", "var_key").distinct()
    said = of(facts, "opaque").select("pkg", "variant", "var_key").distinct().withColumn("is", F.lit(True))
    agreed = declares.join(said, ["pkg", "variant", "var_key"], "left").groupBy("var_key").agg(F.bool_and(F.coalesce("is", F.lit(False))).alias("all"))
    breaks = agreed.filter(~F.col("all")).select(F.col("var_key").alias("node")).unionByName(facts.filter(F.col("kind") == "opacityBreaks").select(F.col("var_key").alias("node")))
    deps = of(facts, "opaqueDeps").select(F.col("var_key").alias("own"), F.col("dep_key").alias("dep"))
    fell = fallen(breaks.distinct(), deps, declares.select(F.col("var_key").alias("node")).distinct())
    return agreed.filter("all").select("var_key").join(fell.select(F.col("node").alias("var_key")), "var_key", "left_anti")


def env_free(facts: DataFrame) -> DataFrame:
    owners = of(facts, "returnEnvFree").select(F.col("fn_key").alias("node")).distinct()
    deps = of(facts, "returnEnvDeps").select(F.col("fn_key").alias("own"), F.col("dep_key").alias("dep"))
    mine = deps.join(owners.select(F.col("node").alias("own")), "own", "left_semi")
    return least_proof(owners.limit(0), mine, owners)


def escaped_uses(uses: DataFrame, proven: DataFrame) -> DataFrame:
    """Deferred uses (var_key, dep_key) of parameters that are not proven."""
    return uses.join(proven.select(F.col("node").alias("dep_key")), "dep_key", "left_anti")


def populations(defer: DataFrame, poison: DataFrame, constructors: DataFrame, proven: DataFrame) -> DataFrame:
    """(carrier, position) proven: something is registered there, or by what constructs the carrier, nothing of that is
    poisoned, and each is a proven parameter. defer: carrier, position, dep_key; poison: carrier, position (null: all)."""
    own = defer.select("carrier", "position").distinct()
    through = reach(constructors.select(F.col("carrier").alias("src"), F.col("by").alias("dst")), own.select("carrier", F.col("carrier").alias("node")).distinct(), ["carrier"])
    wide = through.join(defer.select(F.col("carrier").alias("node"), "position", "dep_key"), "node")
    bad = wide.join(proven.select(F.col("node").alias("dep_key")), "dep_key", "left_anti").select("carrier", "position")
    at = through.join(poison.select(F.col("carrier").alias("node"), F.col("position").alias("p")), "node").select("carrier", "p")
    spoilt = own.join(at, "carrier").filter(F.col("p").isNull() | (F.col("p") == F.col("position"))).select("carrier", "position")
    return wide.select("carrier", "position").distinct().join(bad.unionByName(spoilt).distinct(), ["carrier", "position"], "left_anti")


def promote(uses: DataFrame, refs: DataFrame) -> DataFrame:
    """Attributed uses (fn_key, var_key, class, literal) that count: all but those in functions of initialisation alone; a
    literal's count too where its encloser is reached from there."""
    quiet = init_only(refs).select(F.col("node").alias("fn_key"))
    loud = init_reach(refs).select(F.col("node").alias("fn_key"))
    direct = uses.filter(~F.coalesce("literal", F.lit(False))).join(quiet, "fn_key", "left_anti")
    literal = uses.filter(F.coalesce("literal", F.lit(False)))
    return direct.unionByName(literal.join(loud, "fn_key", "left_semi")).unionByName(literal.join(loud, "fn_key", "left_anti").join(quiet, "fn_key", "left_anti"))


def close_marks(marks: DataFrame, links: DataFrame) -> DataFrame:
    """marks (var_key, class) spread over carrier links (a, b), which bind both ways."""
    parts = components(links)
    rooted = marks.join(parts, marks["var_key"] == parts["node"], "left").select(F.coalesce("root", "var_key").alias("root"), "class").distinct()
    members = parts.select(F.col("node").alias("var_key"), "root").unionByName(marks.select("var_key", F.col("var_key").alias("root")).join(parts.select(F.col("node").alias("var_key")), "var_key", "left_anti")).distinct()
    return members.join(rooted, "root").select("var_key", "class").distinct()


def culprits(marks: DataFrame, declares: DataFrame, opaque_vars: DataFrame, discharged: DataFrame) -> DataFrame:
    """(pkg, var_key, class, rank, first): marked variables of a package that nothing discharges; an escape counts only of one
    that is not opaque. The first of a package names its reason."""
    rows = declares.select("pkg", "var_key").distinct().join(marks, "var_key")
    rows = rows.join(opaque_vars.select("var_key", F.lit("escape").alias("class")), ["var_key", "class"], "left_anti")
    rows = rows.join(discharged.select("pkg", "var_key", "class"), ["pkg", "var_key", "class"], "left_anti")
    rank = F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv])[F.col("class")]
    rows = rows.withColumn("rank", rank)
    return rows.withColumn("first", F.row_number().over(W.partitionBy("pkg").orderBy("rank", "var_key")) == 1)


def discharges(candidates: DataFrame, vouches: DataFrame, audited: DataFrame, directives: DataFrame, attested: bool) -> DataFrame:
    """(pkg, var_key, class, channel). candidates: pkg, package_class, pin, var_key, class. A caller's vouch counts of pinned
    packages, an audited version of its pin, an author's directive of local ones with the execution attested."""
    pinned = candidates.filter(F.col("package_class") == "pinned")
    vouched = pinned.join(vouches.select("var_key"), "var_key", "left_semi").withColumn("channel", F.lit("vouch"))
    known = pinned.join(audited.select("pin", "var_key"), ["pin", "var_key"], "left_semi").withColumn("channel", F.lit("audit"))
    local = candidates.filter((F.col("package_class") == "mutable_local") & F.lit(attested)).join(directives.select("var_key"), "var_key", "left_semi").withColumn("channel", F.lit("directive"))
    return vouched.unionByName(known).unionByName(local).select("pkg", "var_key", "class", "channel").distinct()


def unreachable_discharges(found: DataFrame, sites: DataFrame, rooted: DataFrame, complete: DataFrame, key: str = "subject") -> DataFrame:
    """Culprits (key, var_key) none of whose mark sites (var_key, fn) lies in the functions rooted for the key, where that
    inventory is complete. A culprit without any site stays. Rows of found and rooted may repeat; those returned don't.

    A key's least and greatest functions settle most of its culprits. The rest are looked up from their shorter side, the
    key's functions or the variable's sites, so that neither a large inventory nor a variable of many sites multiplies the other."""
    sites, rooted = pin(sites.select("var_key", "fn").distinct(), "sites"), rooted.select(key, "fn")
    placed = pin(sites.groupBy("var_key").agg(F.count("*").alias("n_sites")), "placed")
    sizes = rooted.groupBy(key).agg(F.count("*").alias("n_rooted"), F.min("fn").alias("least_fn"), F.max("fn").alias("greatest_fn"))
    whole = complete.filter(F.coalesce("complete", F.lit(False))).select(key)
    rows = found.join(placed, "var_key").join(whole, key, "left_semi").join(sizes, key, "left")
    rows = rows.withColumn("near", F.col("n_rooted") <= F.col("n_sites")).drop("n_rooted", "n_sites")
    for end in ("least_fn", "greatest_fn"):
        rows = rows.join(sites.withColumnRenamed("fn", end), ["var_key", end], "left_anti").drop(end)
    rows = pin(rows.distinct(), "unsettled")
    near, far = rows.filter("near").select(key, "var_key"), rows.filter("not near").select(key, "var_key")
    hit = near.join(rooted, key).join(sites, ["var_key", "fn"], "left_semi").select(key, "var_key")
    if not far.isEmpty():
        hit = hit.unionByName(far.join(sites, "var_key").join(rooted, [key, "fn"], "left_semi").select(key, "var_key"))
    return rows.join(hit, [key, "var_key"], "left_anti").select(found.columns)


def reached_culprits(packages: DataFrame, imports: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(root, reason) of view packages whose imports, standard ones left out, lead to a culprit. The least of (package,
    rank, variable) names it: rows have no traversal order, and reasons are not part of the contract."""
    inner = nodes.filter("class <> 'standard'").select(F.col("import_path").alias("dst"))
    edges = imports.select(F.col("import_path").alias("src"), F.col("imported").alias("dst")).join(inner, "dst", "left_semi")
    cone = reach(edges, packages.select(F.col("import_path").alias("root"), F.col("import_path").alias("node")), ["root"])
    hit = cone.join(found.select(F.col("pkg").alias("node"), "var_key", "class", "rank"), "node")
    text = F.concat(F.lit("shared dynamic state: "), "var_key", F.lit(" ("), "class", F.lit(")"))
    return hit.groupBy("root").agg(F.min_by(text, F.struct("node", "rank", "var_key")).alias("reason"))


def acceptance(packages: DataFrame, imports: DataFrame, keys: DataFrame) -> DataFrame:
    """(root, keys): the sorted keys (pkg, key) of all that a view package imports."""
    cone = reach(imports.select(F.col("import_path").alias("src"), F.col("imported").alias("dst")), packages.select(F.col("import_path").alias("root"), F.col("import_path").alias("node")), ["root"])
    return cone.join(keys.select(F.col("pkg").alias("node"), "key"), "node").groupBy("root").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def quoted(x: Column) -> Column:
    """A string in double quotes, quotes and backslashes escaped; pins are printable."""
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def buckets(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(pin, bucket) of pinned modules: the pin and a digest of all pins that its packages reach. A module any package of
    which reaches a local one has no key: part of what it is made of may change under one."""
    edges = imports.select(F.col("import_path").alias("src"), F.col("imported").alias("dst"))
    pins = nodes.filter("class = 'pinned'").select("pin", F.col("import_path").alias("node"))
    cone = reach(edges, pins, ["pin"])
    known = cone.join(nodes.select(F.col("import_path").alias("node"), "class", F.col("pin").alias("there")), "node")
    rows = known.groupBy("pin").agg(F.bool_or(F.col("class") == "mutable_local").alias("local"), F.array_sort(F.collect_set("there")).alias("cone"))
    text = F.concat(F.lit("["), F.array_join(F.transform("cone", quoted), " "), F.lit("]"))
    return rows.filter(~F.col("local")).select("pin", F.concat("pin", F.lit("|"), F.substring(short(text), 1, 16)).alias("bucket"))


def covered_by_all(directives: DataFrame, declares: DataFrame) -> DataFrame:
    """(var_key) that carry a directive in every variant that declares them."""
    rows = declares.select("pkg", "variant", "var_key").distinct().join(directives.select("pkg", "variant", "var_key").distinct().withColumn("has", F.lit(True)), ["pkg", "variant", "var_key"], "left")
    return rows.groupBy("var_key").agg(F.bool_and(F.coalesce("has", F.lit(False))).alias("all")).filter("all").select("var_key")


def method_directives(directives: DataFrame, methods: DataFrame) -> DataFrame:
    """(pkg, symbol, directive) of methods, promoted ones by their origin; the least that is not empty."""
    rows = methods.join(directives, [methods["origin_pkg"] == directives["package"], methods["origin_symbol"] == directives["symbol"]])
    return rows.filter(F.col("directive") != "").groupBy(methods["pkg"], methods["symbol"]).agg(F.min("directive").alias("directive"))


def first_reason(rank: Column, reason: Column) -> Column:
    return F.min_by(reason, F.struct(rank, reason))
