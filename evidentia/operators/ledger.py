"""Declaration ledgers: positional digests, multiset difference, inertness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digest import NUL, fold, short

IDENTITY = ["file", "pkg_clause", "kind", "receiver", "name"]


def ordinal(partition: list[str], order: list[str]) -> Column:
    return F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1


def positional(content: Column, position: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), F.lit(NUL).cast("binary"), position.cast("string").cast("binary")), 256)


def governing(value: str, group: list[str], order: list[str]) -> Column:
    """A constant group's last value so far: an omitted one repeats it."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def identity_digest(lines: DataFrame, key: list[str], line: Column) -> DataFrame:
    """The compartment's identity: its file lines, folded."""
    return lines.groupBy(*key).agg(fold(line).alias("identity"))


def diff(before: DataFrame, after: DataFrame, key: list[str], hash_col: str = "hash") -> DataFrame:
    """key columns, op (added, changed, removed), before_hash, after_hash. Equal hashes of an identity cancel as often as
    both sides have them; of what is left, the n-th least of either side pair up as changed. Null parts of an identity
    match only themselves."""

    def side(df: DataFrame, n: str) -> DataFrame:
        rows = df.groupBy(*key, hash_col).agg(F.count("*").alias(n))
        return rows

    b, a = side(before, "b").alias("x"), side(after, "a").alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*key, hash_col]]
    both = b.join(a, on, "full")
    named = [F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in [*key, hash_col]]
    over = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    left = both.select(*named, over.alias("over")).filter("over <> 0")
    single = left.select(*key, hash_col, F.when(F.col("over") > 0, "b").otherwise("a").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("over").cast("int"))).alias("copy"))
    nth = F.row_number().over(W.partitionBy(*key, "side").orderBy(hash_col, "copy"))
    paired = single.withColumn("nth", nth).groupBy(*key, "nth").agg(F.max(F.when(F.col("side") == "b", F.col(hash_col))).alias("before_hash"), F.max(F.when(F.col("side") == "a", F.col(hash_col))).alias("after_hash"))
    op = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").otherwise("changed")
    return paired.select(*key, op.alias("op"), "before_hash", "after_hash")


def headers(before: DataFrame, after: DataFrame) -> DataFrame:
    """package, file, before_hash, after_hash, embedded of headers that came, went or changed; embedded on either side."""
    b = before.select("package", "file", F.col("hash").alias("before_hash"), F.col("embedded").alias("eb"))
    a = after.select("package", "file", F.col("hash").alias("after_hash"), F.col("embedded").alias("ea"))
    rows = b.join(a, ["package", "file"], "full")
    same = F.col("before_hash").eqNullSafe(F.col("after_hash")) & F.col("eb").eqNullSafe(F.col("ea"))
    return rows.filter(~same).select("package", "file", "before_hash", "after_hash", (F.coalesce("eb", F.lit(False)) | F.coalesce("ea", F.lit(False))).alias("embedded"))


def inert(delta: DataFrame, header_changes: DataFrame, packages: DataFrame) -> DataFrame:
    """package, inert: nothing changed or removed, only constants, types and functions (but TestMain) added, no embedded
    member moved. A package without any change is inert; a kind that is not known is not."""
    harmless = F.coalesce((F.col("op") == "added") & (F.col("kind").isin("const", "type") | ((F.col("kind") == "func") & (F.col("name") != "TestMain"))), F.lit(False))
    d = delta.groupBy("package").agg(F.bool_and(harmless).alias("d"))
    h = header_changes.groupBy("package").agg(F.bool_and(~F.coalesce("embedded", F.lit(True))).alias("h"))
    rows = packages.select("package").distinct().join(d, "package", "left").join(h, "package", "left")
    return rows.select("package", (F.coalesce("d", F.lit(True)) & F.coalesce("h", F.lit(True))).alias("inert"))


def order_of_declarations() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("file", "kind", "receiver", "name", "hash")]


def referenced(refs: DataFrame) -> DataFrame:
    return refs.withColumn("refs", F.array_sort(F.array_distinct("refs")))


def merged_names(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def moved_files(captured: DataFrame, current: DataFrame) -> DataFrame:
    """path, op of source files: added, removed, changed; without both digests nothing is called changed."""
    rows = captured.select("path", F.lit(True).alias("b"), F.col("digest").alias("d0")).join(current.select("path", F.lit(True).alias("a"), F.col("digest").alias("d1")), "path", "full")
    op = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("d0") != F.col("d1"), "changed")
    return rows.select("path", op.alias("op")).filter("op is not null")


def short_of(content: Column) -> Column:
    return short(content)
