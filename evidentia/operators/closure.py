"""Content closures: listing rows to contributions, folded for each root, and the compartment of its own tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.digest import file_line, fold, framed, short, whole

FILE_KINDS = ["go_files", "cgo_files", "c_files", "s_files", "syso_files", "embed_files", "other_files"]


def source_files() -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(k, none) for k in FILE_KINDS]))


def pinned(module_cache: Column) -> Column:
    """A package in the cache's folder, of a module that is not the main one: its version stands for its content."""
    own = paths.clean(F.coalesce("dir", F.lit("")))
    inside = (own == module_cache) | F.startswith(own, F.concat(module_cache, F.lit("/")))
    return F.col("module").isNotNull() & ~F.coalesce("module.main", F.lit(False)) & inside


def classes(packages: DataFrame, module_cache: str) -> DataFrame:
    """The graph's nodes: import path, class (standard, pinned, mutable_local), pin, once each."""
    pin = pinned(F.lit(module_cache))
    kind = F.when(F.coalesce("standard", F.lit(False)) | F.col("module").isNull(), "standard").when(pin, "pinned").otherwise("mutable_local")
    place = paths.clean(F.coalesce("replace_dir", "module.dir"))
    inside = F.startswith(place, F.lit(f"{module_cache}/"))
    version = F.when(inside, F.substring(place, F.lit(len(module_cache) + 2), F.length(place))).otherwise(place)
    rows = packages.withColumn("class", kind).withColumn("pin", F.when(kind == "pinned", version))
    return rows.select("generation", "import_path", "pkg_path", "dir", "for_test", "class", "pin").dropDuplicates(["generation", "import_path"])


def test_main() -> Column:
    return F.coalesce(F.endswith("import_path", F.lit(".test")), F.lit(False))


def own_variant(root: Column, root_dir: Column) -> Column:
    """A node of the root's own tests: made for it, in its folder (or its external test package)."""
    base = F.regexp_replace("import_path", r" \[.*$", "")
    return F.coalesce((F.col("for_test") == root) & ((base == root) | (base == F.concat(root, F.lit("_test")))) & (F.col("dir") == root_dir), F.lit(False))


def file_sets(package_files: DataFrame) -> DataFrame:
    """dir, digest of all its named files: one hash a file, folded in order of their names. Null where one of them could not
    be read (null content)."""
    line = F.struct(F.col("file").alias("f"), file_line(F.col("file"), F.sha2("content", 256)).alias("l"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(line["l"].isNotNull(), line))), lambda x: x["l"]), "")
    return package_files.groupBy("generation", "dir").agg(F.when(whole(line["l"]), short(lines)).alias("files_hash"))


def contributions(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """import_path, counts, contribution: cache:module@version of pinned ones, src:path=hash of local ones. Standard packages
    and generated test mains do not count; one that counts and whose content is not known has a null contribution."""
    rows = nodes.join(hashes, ["generation", "dir"], "left").withColumn("counts", (F.col("class") != "standard") & ~test_main())
    text = F.when(F.col("class") == "pinned", F.concat(F.lit("cache:"), "pin")).otherwise(F.concat(F.lit("src:"), "import_path", F.lit("="), "files_hash"))
    return rows.select("generation", "import_path", "counts", F.when(F.col("counts"), text).alias("contribution"))


def maximal(deps: DataFrame, contribs: DataFrame) -> DataFrame:
    """deps (generation, root, import_path: all that root reaches) -> root, hash. A root with a dependency that no listing
    knows, or whose content is not known, has no hash, and so is never valid."""
    rows = deps.join(contribs, ["generation", "import_path"], "left")
    known = F.bool_and(F.coalesce(~F.col("counts") | F.col("contribution").isNotNull(), F.lit(False)))
    gathered = F.array_sort(F.collect_set("contribution"))
    return rows.groupBy("generation", "root").agg(F.when(known & (F.size(gathered) > 0), short(F.array_join(gathered, "\n"))).alias("hash"))


def compartment(variant_files: DataFrame, base_files: DataFrame) -> DataFrame:
    """root -> identity of the files that only its tests have. Both: generation, root, file, content_sha."""
    only = variant_files.join(base_files.select("generation", "root", "file"), ["generation", "root", "file"], "left_anti")
    return only.groupBy("generation", "root").agg(fold(file_line(F.col("file"), F.col("content_sha"))).alias("test_variants"))


def subject_hash(package_hash: Column, package: Column, symbol: Column) -> Column:
    return short(framed(package_hash, package, symbol))


def native_effects() -> Column:
    """Reasons of a package's native parts, as rows' array."""
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return F.array_compact(F.array(F.when(has("cgo_files"), F.lit("cgo")), F.when(has("syso_files"), F.lit("syso objects")), F.when(has("s_files"), F.lit("assembly"))))
