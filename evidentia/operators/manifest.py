"""Runtime-input manifests: entries, canonical form, digest, codec, merge and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digest, paths

VERSION = 1
WIRE = "struct<v:int,env:array<struct<n:string,d:string>>,paths:array<struct<k:string,p:string,d:string>>,unverifiable:array<string>>"


def path_preimage(kind: Column, path: Column, state: Column, machine: Column) -> Column:
    """What an identity's digest is taken of: presence, kind of object and content, by the state observed. state: a struct of
    exists, kind (file, dir, symlink, other), size, mode, mtime_ns, content_sha. External folders bind existence alone; the
    machine's fact files the machine; what can't be hashed has no preimage."""
    stat = F.concat(F.lit("stat "), state["size"].cast("string"), F.lit(" "), F.lower(F.hex(state["mode"])), F.lit(" "), state["mtime_ns"].cast("string"), F.lit(" "), (state["kind"] == "dir").cast("string"), F.lit("\n"))
    return (
        F.when((kind == "abs") & path.isin(*paths.MACHINE_FACT_FILES), F.concat(F.lit("machine "), machine))
        .when(~F.coalesce(state["exists"], F.lit(False)), F.lit("missing"))
        .when((kind == "abs") & (state["kind"] == "dir"), F.lit("external-dir"))
        .when(state["kind"].isin("file", "symlink", "dir"), F.concat(F.lit("object "), state["kind"], F.lit("\n"), stat, F.coalesce(state["content_sha"], F.lit(""))))
    )


def entries(observed: DataFrame, env: DataFrame, states: DataFrame, machine: Column, module_dir: str | None = None) -> DataFrame:
    """observed (manifest_id, kind: env, rel, abs or unverifiable; ident) with digests of the present state."""
    value = env.select(F.col("key").alias("ident"), F.when(F.col("present"), F.coalesce("value", F.lit(""))).alias("value"))
    names = observed.filter("kind = 'env'").join(value, "ident", "left").select("manifest_id", "kind", "ident", digest.env_entry(F.col("value")).alias("digest"))
    state = states.select(F.col("path").alias("ident"), F.struct("exists", F.col("kind").alias("kind"), "size", "mode", "mtime_ns", "content_sha").alias("state"))
    found = observed.filter("kind in ('rel', 'abs')").join(state, "ident", "left")
    hashed = found.select("manifest_id", "kind", "ident", digest.short(path_preimage(F.col("kind"), F.col("ident"), F.col("state"), machine)).alias("digest"))
    reasons = observed.filter("kind = 'unverifiable'").select("manifest_id", "kind", "ident", F.lit(None).cast("string").alias("digest"))
    if module_dir is not None:  # a relative path may lead outside the module by a link: existence there is all that is known
        target = states.select(F.col("path").alias("ident"), F.col("resolved"), (F.col("kind") == "dir").alias("is_dir"), "exists")
        hashed = hashed.join(target, "ident", "left")
        outside = F.coalesce((F.col("kind") == "rel") & F.col("exists") & F.col("resolved").isNotNull() & ~paths.under(F.col("resolved"), F.lit(module_dir)), F.lit(False))
        says = F.when(outside & F.col("is_dir"), "external directory input: ").when(outside, "external runtime input target: ")
        hashed = hashed.select("manifest_id", "kind", "ident", F.when(~outside, F.col("digest")).alias("digest"), says.alias("says"))
    else:
        hashed = hashed.withColumn("says", F.lit(None).cast("string"))
    why = F.concat(F.coalesce("says", F.lit("unhashable runtime input: ")), "ident")
    lost = hashed.filter("digest is null").select("manifest_id", F.lit("unverifiable").alias("kind"), why.alias("ident"), "digest")
    hashed = hashed.drop("says")
    return names.unionByName(hashed.filter("digest is not null")).unionByName(reasons).unionByName(lost).distinct()


def fold(rows: DataFrame) -> DataFrame:
    """entries -> manifest_id, manifest (encoded), digest, unverifiable, reason. One sort a manifest, in canonical order."""
    of = lambda *kinds: F.col("kind").isin(*kinds)
    env = F.array_sort(F.collect_set(F.when(of("env"), F.struct(F.col("ident").alias("n"), F.col("digest").alias("d")))))
    files = F.array_sort(F.collect_set(F.when(of("rel", "abs"), F.struct(F.col("kind").alias("k"), F.col("ident").alias("p"), F.col("digest").alias("d")))))
    reasons = F.array_sort(F.collect_set(F.when(of("unverifiable"), F.col("ident"))))
    m = rows.groupBy("manifest_id").agg(env.alias("env"), files.alias("paths"), reasons.alias("unverifiable"))
    return m.select("manifest_id", encode(F.lit(VERSION), F.col("env"), F.col("paths"), F.col("unverifiable")).alias("manifest"), combined(F.col("env"), F.col("paths"), F.col("unverifiable")).alias("digest"), (F.size("unverifiable") > 0).alias("unverifiable"), F.coalesce(F.try_element_at("unverifiable", F.lit(1)), F.lit("")).alias("reason"), F.lit(True).alias("ok"))


def combined(env: Column, files: Column, reasons: Column) -> Column:
    lines = F.concat(
        F.array(F.lit(f"version {VERSION}\n")),
        F.transform(env, lambda e: F.concat(F.lit("env "), e["n"], F.lit(" "), e["d"], F.lit("\n"))),
        F.transform(files, lambda e: F.concat(F.lit("path "), e["k"], F.lit(" "), e["p"], F.lit(" "), e["d"], F.lit("\n"))),
        F.transform(reasons, lambda r: F.concat(F.lit("unverifiable "), r, F.lit("\n"))),
    )
    return digest.short(F.array_join(lines, ""))


def encode(version: Column, env: Column, files: Column, reasons: Column) -> Column:
    some = lambda a: F.when(F.size(a) > 0, a)
    return digest.base64url(F.to_json(F.struct(version.alias("v"), some(env).alias("env"), some(files).alias("paths"), some(reasons).alias("unverifiable"))))


def decode(encoded: Column) -> Column:
    """The manifest's struct, or null: not base64url, not JSON, unknown fields, another order or version, not valid."""
    text = digest.from_base64url(encoded).cast("string")
    m = F.from_json(text, WIRE)
    again = encode(m["v"], *[F.array_sort(F.coalesce(m[f], F.array().cast(t))) for f, t in (("env", "array<struct<n:string,d:string>>"), ("paths", "array<struct<k:string,p:string,d:string>>"), ("unverifiable", "array<string>"))])
    return F.when((m["v"] == VERSION) & (again == encoded) & valid(m), m)


def valid(m: Column) -> Column:
    none = lambda f, t: F.coalesce(m[f], F.array().cast(t))
    env, files = none("env", "array<struct<n:string,d:string>>"), none("paths", "array<struct<k:string,p:string,d:string>>")
    names, idents = F.transform(env, lambda e: e["n"]), F.transform(files, lambda e: F.struct(e["k"], e["p"]))
    unique = (F.size(F.array_distinct(names)) == F.size(names)) & (F.size(F.array_distinct(idents)) == F.size(idents))
    hashed = F.forall(env, lambda e: digest.valid_entry(e["d"]) & (e["n"] != "") & paths.representable(e["n"])) & F.forall(files, lambda e: digest.valid_entry(e["d"]))
    placed = F.forall(files, lambda e: F.coalesce(((e["k"] == "rel") & ~paths.is_abs(e["p"]) & (e["p"] != "..") & ~F.startswith(e["p"], F.lit("../")) & (paths.clean(e["p"]) == e["p"])) | ((e["k"] == "abs") & paths.is_abs(e["p"]) & (paths.clean(e["p"]) == e["p"])), F.lit(False)))
    said = F.forall(none("unverifiable", "array<string>"), lambda r: (r != "") & paths.representable(r))
    return F.coalesce(unique & hashed & placed & said, F.lit(False))


def explode(manifests: DataFrame, encoded: str = "manifest", key: str = "manifest_id") -> DataFrame:
    """Entries of encoded manifests, again in rows."""
    m = manifests.select(key, decode(F.col(encoded)).alias("m")).filter("m is not null")
    env = m.select(key, F.explode("m.env").alias("e")).select(key, F.lit("env").alias("kind"), F.col("e.n").alias("ident"), F.col("e.d").alias("digest"))
    files = m.select(key, F.explode("m.paths").alias("e")).select(key, F.col("e.k").alias("kind"), F.col("e.p").alias("ident"), F.col("e.d").alias("digest"))
    reasons = m.select(key, F.explode("m.unverifiable").alias("r")).select(key, F.lit("unverifiable").alias("kind"), F.col("r").alias("ident"), F.lit(None).cast("string").alias("digest"))
    return env.unionByName(files).unionByName(reasons)


def rejects(rows: DataFrame) -> DataFrame:
    """Entries that no manifest may hold, and why."""
    twice = rows.filter("kind <> 'unverifiable'").groupBy("manifest_id", "kind", "ident").agg(F.count("*").alias("n")).filter("n > 1").select("manifest_id", "kind", "ident", F.lit("duplicate identity").alias("why"))
    shape = rows.filter((F.col("kind") != "unverifiable") & ~digest.valid_entry(F.col("digest"))).select("manifest_id", "kind", "ident", F.lit("digest shape").alias("why"))
    other = rows.filter(~F.col("kind").isin("env", "rel", "abs", "unverifiable")).select("manifest_id", "kind", "ident", F.lit("unknown kind").alias("why"))
    return twice.unionByName(shape).unionByName(other)


def merge(rows: DataFrame, group: str) -> DataFrame:
    """Union of the manifests of each group: commutative, associative, idempotent. Each was just revalidated, so equal
    identities have equal digests; where not, the least stays and the group is reported by conflicts()."""
    return rows.groupBy(group, "kind", "ident").agg(F.min("digest").alias("digest")).withColumnRenamed(group, "manifest_id")


def merge_checked(rows: DataFrame, group: str, current: DataFrame, processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, refused). rows: the manifests' entries with their group; current: the entries as they are now; processes:
    group, process, origin, view. A group is merged only if none of its inputs moved and no process is told of in two ways;
    refused (group, reason) holds the others, the least moved input or conflicting process first."""
    shifted = rows.select(group, "manifest_id").distinct().join(moved(rows, current).select("manifest_id").distinct(), "manifest_id")
    shifted = shifted.groupBy(group).agg(F.concat(F.lit("merge input moved: "), F.min("manifest_id").cast("string")).alias("reason"))
    twice = processes.groupBy(group, "process").agg(F.count_distinct(F.struct("origin", "view")).alias("n")).filter("n > 1")
    twice = twice.groupBy(group).agg(F.concat(F.lit("conflicting observations for process "), F.min("process").cast("string")).alias("reason"))
    refused = twice.unionByName(shifted).groupBy(group).agg(F.min("reason").alias("reason"))
    return merge(rows.join(refused, group, "left_anti").drop("manifest_id"), group), refused


def conflicts(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group, "kind", "ident").agg(F.count_distinct("digest").alias("n")).filter("n > 1").select(group, "kind", "ident")


def process_conflicts(processes: DataFrame) -> DataFrame:
    """Processes that are said to have two origins or views."""
    return processes.groupBy("process").agg(F.count_distinct(F.struct("origin", "view")).alias("n")).filter("n > 1").select("process")


def moved(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose digest is another now; one that is gone has moved."""
    r = recorded.select("manifest_id", "kind", "ident", F.col("digest").alias("recorded"))
    c = current.select("manifest_id", "kind", "ident", F.col("digest").alias("current"))
    rows = r.filter("kind <> 'unverifiable'").join(c, ["manifest_id", "kind", "ident"], "left")
    return rows.filter(~F.col("recorded").eqNullSafe(F.col("current"))).select("manifest_id", "kind", "ident")


def adopt(persisted: DataFrame, recomputed: DataFrame) -> DataFrame:
    """manifest_id, adopted: exactly the manifest that is computed anew."""
    p, r = persisted.select("manifest_id", F.col("manifest").alias("p")), recomputed.select("manifest_id", F.col("manifest").alias("r"))
    return p.join(r, "manifest_id", "left").select("manifest_id", F.coalesce(F.col("p") == F.col("r"), F.lit(False)).alias("adopted"))


def absolute(rows: DataFrame, module_dir: Column) -> DataFrame:
    """Relative identities as absolute ones, to merge across modules; those that escape the module are given as reasons."""
    where = paths.materialize(module_dir, F.col("kind"), F.col("ident"))
    rel = F.col("kind") == "rel"
    kind = F.when(~rel, F.col("kind")).when(where.isNull(), "unverifiable").otherwise("abs")
    ident = F.when(~rel, F.col("ident")).when(where.isNull(), F.concat(F.lit("relative path escapes module: "), "ident")).otherwise(where)
    return rows.withColumns({"kind": kind, "ident": ident})


def incomplete(reason: str) -> list[tuple[str, str]]:
    """The only entry of an observation that did not finish."""
    return [("unverifiable", reason or "incomplete observation")]


def describe(rows: DataFrame) -> DataFrame:
    """Names only, by manifest and kind."""
    return rows.groupBy("manifest_id", "kind").agg(F.array_sort(F.collect_set("ident")).alias("names"))


def dirty(rows: DataFrame, reproducible: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """manifest_id, dirty: a module-local input that the commit (ident, reproducible) can't give again. With current, the
    entries as they are now: null, no answer, for a manifest that has moved."""
    local = rows.filter("kind = 'rel'").join(reproducible, "ident", "left")
    found = local.groupBy("manifest_id").agg(F.bool_or(~F.coalesce("reproducible", F.lit(False))).alias("dirty"))
    out = rows.select("manifest_id").distinct().join(found, "manifest_id", "left").select("manifest_id", F.coalesce("dirty", F.lit(False)).alias("dirty"))
    if current is None:
        return out
    shifted = moved(rows, current).select("manifest_id", F.lit(True).alias("gone")).distinct()
    return out.join(shifted, "manifest_id", "left").select("manifest_id", F.when(F.col("gone").isNull(), F.col("dirty")).alias("dirty"))


def paths_of(rows: DataFrame, module_dir: Column) -> DataFrame:
    """manifest_id, path, module_relative: absolute paths of all identities, and the relative ones of the module."""
    found = rows.filter("kind in ('rel', 'abs')")
    return found.select("manifest_id", paths.materialize(module_dir, F.col("kind"), F.col("ident")).alias("path"), F.when(F.col("kind") == "rel", F.col("ident")).alias("module_relative"))


def ordered(rows: DataFrame) -> DataFrame:
    """Identities in canonical order."""
    return rows.orderBy("kind", "ident")
