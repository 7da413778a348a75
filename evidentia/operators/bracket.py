"""Observation brackets: fingerprints of declared roots, coverage by containment, and revalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.digest import NEWLINE


def without_excluded(rows: DataFrame, exclusions: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is no exclusion and below none: an equi-join on the path's ancestors, not a comparison of all with all."""
    tagged = rows.withColumn("_p", F.col(path))
    hit = tagged.select("_p").distinct().select("_p", F.explode(paths.prefixes(F.col("_p"))).alias("up")).join(exclusions.select(F.col("path").alias("up")), "up", "left_semi").select("_p").distinct()
    return tagged.join(hit, "_p", "left_anti").drop("_p")


def contained(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """rows with root, for each root (root) that is the path or above it."""
    up = rows.withColumn("_up", F.explode(paths.prefixes(F.col(path))))
    return up.join(roots.select(F.col("root").alias("_up"), F.col("root")), "_up").drop("_up")


def covered(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """objects (id, resolved, links) -> id, covered, escaped: the resolved object and every link walked lie below some
    root; escaped names the least link that does not. An object that does not resolve is not covered."""
    legs = objects.select("id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("resolved").alias("path"))), F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.struct(F.lit(1).alias("k"), x.alias("path"))))).alias("leg")).select("id", "leg.k", "leg.path").distinct()
    inside = contained(legs.filter("path is not null"), roots).select("id", "k", "path").distinct().withColumn("ok", F.lit(True))
    rows = legs.join(inside, ["id", "k", "path"], "left")
    return rows.groupBy("id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("covered"), F.min(F.when(F.col("ok").isNull() & (F.col("k") == 1), F.col("path"))).alias("escaped"))


def guard_covered(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """objects (path, resolved, links, exists) -> (path) for which one and the same root holds the path itself or its
    resolved form, the resolved object and every link. roots: root, resolved_root, exclude_sub (its one subtree that stays
    observed). What does not exist stays observed."""
    names = roots.select(F.col("root").alias("r"), F.explode(F.array_distinct(F.array("root", "resolved_root"))).alias("root"))
    legs = objects.filter(F.coalesce("exists", F.lit(False))).select("path", "resolved", F.explode(F.array_distinct(F.concat(F.array("path", "resolved"), F.coalesce("links", F.array().cast("array<string>"))))).alias("leg"))
    total = legs.groupBy("path").agg(F.count("*").alias("legs"))
    held = contained(legs, names, "leg")
    named = held.join(names.withColumnRenamed("root", "n"), held["root"] == F.col("n")).select("path", "leg", "r")
    open_ = named.join(roots.select(F.col("root").alias("r"), "resolved_root", "exclude_sub"), "r")
    out = F.coalesce(paths.under(F.col("leg"), F.concat("r", F.lit("/"), "exclude_sub")) | paths.under(F.col("leg"), F.concat("resolved_root", F.lit("/"), "exclude_sub")), F.lit(False))
    counts = open_.filter(F.col("exclude_sub").isNull() | ~out).select("path", "leg", "r").distinct().groupBy("path", "r").agg(F.count("*").alias("n"))
    return counts.join(total, "path").filter("n = legs").select("path").distinct()


def fingerprint(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (bracket, root, member, digest) -> root digests, bracket fingerprints: two folds, full SHA-256."""
    line = F.concat("member", F.lit(" "), "digest")
    roots = members.groupBy("bracket", "root").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), NEWLINE).cast("binary"), 256).alias("digest"))
    whole = F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat("root", F.lit(" "), "digest"))), NEWLINE).cast("binary"), 256)
    return roots, roots.groupBy("bracket").agg(whole.alias("fingerprint"))


def seal(brackets: DataFrame) -> DataFrame:
    """brackets (bracket, module, roots, exclusions, fingerprint, members: array of root and member) with a seal over all that
    was captured, length-framed: a member added, taken away or moved between roots breaks it as another digest would."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    many = lambda c: F.concat(F.size(c).cast("string"), F.lit("["), F.array_join(F.transform(F.array_sort(c), part), ""), F.lit("]"))
    return brackets.withColumn("seal", F.sha2(F.concat(part(F.col("module")), many(F.col("roots")), many(F.col("exclusions")), part(F.col("fingerprint")), many(F.transform("members", lambda m: F.concat(part(m["root"]), part(m["member"]))))).cast("binary"), 256))


def revalidate(before: DataFrame, after: DataFrame) -> DataFrame:
    """bracket -> reason: '' if no root (bracket, root, digest) moved, else that its first one did."""
    b, a = before.select("bracket", "root", F.col("digest").alias("b")), after.select("bracket", "root", F.col("digest").alias("a"))
    rows = b.join(a, ["bracket", "root"], "full").withColumn("moved", ~F.col("b").eqNullSafe(F.col("a")))
    first = F.min(F.when(F.col("moved"), F.col("root")))
    return rows.groupBy("bracket").agg(F.coalesce(F.concat(F.lit("bracket root moved: "), first), F.lit("")).alias("reason"))
