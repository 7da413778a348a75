"""Lexical paths as columns; nothing here touches a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roots whose files the kernel makes up on reading, and the files there that describe the machine.
VOLATILE_ROOTS = ("/proc", "/sys")
MACHINE_FACT_FILES = ("/proc/cpuinfo", "/proc/meminfo", "/proc/sys/kernel/osrelease")


def components(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda x: x != "")


def is_abs(p: Column) -> Column:
    return F.startswith(p, F.lit("/"))


def has_parent(p: Column) -> Column:
    return F.array_contains(F.split(p, "/"), "..")


def clean(p: Column) -> Column:
    """Lexical cleaning: no empty, '.' or inner '..' components; the empty path is '.'."""
    empty = F.array().cast("array<string>")
    rooted = is_abs(p)

    def step(acc, x):
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when((x == "") | (x == "."), acc).when(x != "..", F.array_append(acc, x)).when(F.coalesce(up, F.lit(False)), F.slice(acc, 1, F.size(acc) - 1)).when(rooted, acc).otherwise(F.array_append(acc, F.lit("..")))

    body = F.array_join(F.aggregate(F.split(p, "/"), empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def resolve(cwd: Column, name: Column) -> Column:
    return clean(F.when(is_abs(name), name).otherwise(F.concat(cwd, F.lit("/"), name)))


def under(p: Column, root: Column) -> Column:
    """p is root or below it; both cleaned. Null is not below anything."""
    return F.coalesce((p == root) | (root == "/") | F.startswith(p, F.concat(root, F.lit("/"))), F.lit(False))


def rel_under(root: Column, p: Column) -> Column:
    """p relative to root, '.' for root itself; null where it lies outside."""
    return F.when(p == root, F.lit(".")).when(under(p, root), F.substring(p, F.length(root) + F.when(root == "/", 1).otherwise(2), F.length(p)))


def materialize(module_dir: Column, kind: Column, path: Column) -> Column:
    """Absolute path of an identity; null where a relative one escapes the module or the kind is unknown."""
    joined = clean(F.concat(module_dir, F.lit("/"), path))
    return F.when((kind == "rel") & under(joined, module_dir), joined).when((kind == "abs") & is_abs(path), clean(path))


def prefixes(p: Column) -> Column:
    """p and all its ancestors: containment in a set of roots is an equi-join on these."""
    parts = components(p)
    lead = F.when(is_abs(p), F.lit("/")).otherwise(F.lit(""))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(lead, F.array_join(F.slice(parts, 1, i), "/")))
    return F.array_distinct(F.when(is_abs(p), F.concat(F.array(F.lit("/")), steps)).otherwise(steps))


def volatile(p: Column) -> Column:
    roots = [under(p, F.lit(r)) for r in VOLATILE_ROOTS]
    return (roots[0] | roots[1]) & ~clean(p).isin(*MACHINE_FACT_FILES)


def in_namespace(p: Column, directory: Column, prefix: Column, suffix: Column) -> Column:
    """p lies in or below a child of directory whose name is prefix, at least one character, suffix."""
    rest = rel_under(directory, p)
    child = F.element_at(F.split(rest, "/"), 1)
    fits = F.startswith(child, prefix) & F.endswith(child, suffix) & (F.length(child) > F.length(prefix) + F.length(suffix))
    return F.coalesce((rest != ".") & fits, F.lit(False))


def std_import(p: Column) -> Column:
    """A standard package by its path alone: no dot in the first element. Module facts, where known, decide instead."""
    return ~F.contains(F.element_at(F.split(p, "/"), 1), F.lit("."))


def representable(x: Column) -> Column:
    return ~F.coalesce(x.rlike(r"[\x00\r\n]"), F.lit(True))
