"""Test logs to observed inputs. A log is an ordered list of operations of a process; what each contributes (an identity, a
reason, or nothing) is decided by one ladder over columns. The working directory is carried by windows where directory
changes are absolute, and by a fold within the process where a relative one depends on those before it."""

from __future__ import annotations

from collections.abc import Iterator
from posixpath import isabs, join, normpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths

HEADER = "# test log"


def parse(log: DataFrame) -> DataFrame:
    """log (process, seq, line: binary) -> process, seq, op, name, reason. Reasons: malformed lines and unknown operations;
    the header is dropped."""
    line = F.col("line")
    fine = F.is_valid_utf8(line.cast("string"))
    text = F.when(fine, line.cast("string"))
    cut = F.instr(text, " ")
    rows = log.withColumns({"text": text, "cut": cut}).filter(~F.coalesce(F.col("text") == HEADER, F.lit(False)))
    op = F.when(F.col("cut") > 0, F.substring("text", F.lit(1), F.col("cut") - 1))
    name = F.when(F.col("cut") > 0, F.substring("text", F.col("cut") + 1, F.length("text")))
    malformed = (F.col("text") == "") | F.startswith("text", F.lit("#")) | (F.col("cut") == 0) | (name == "")
    reason = (
        F.when(F.col("text").isNull(), F.lit("non-UTF-8 testlog line"))
        .when(malformed, F.lit("malformed testlog line"))
        .when(~op.isin("getenv", "open", "stat", "chdir"), F.when(paths.representable(op), F.concat(F.lit("unrecognized testlog op: "), op)).otherwise("unrepresentable testlog operation"))
        .when((op == "getenv") & ~paths.representable(name), F.lit("unrepresentable environment name"))
    )
    return rows.select("process", "seq", op.alias("op"), name.alias("name"), reason.alias("reason"))


def unterminated(ends: DataFrame) -> DataFrame:
    """ends (process, size, ends_with_newline) -> reasons of logs that were cut off."""
    return ends.filter((F.col("size") > 0) & ~F.coalesce("ends_with_newline", F.lit(False))).select("process", F.lit("malformed testlog line").alias("reason"))


def working_directories(ops: DataFrame, package_dir: DataFrame) -> DataFrame:
    """ops with cwd (before the operation) and after_chdir. Processes whose directory changes are all absolute, that is most,
    need windows only; the rest are folded, each by itself and in order."""
    rows = ops.join(package_dir.select("process", "package_dir"), "process")
    moves = (F.col("op") == "chdir") & F.col("reason").isNull()
    relative = rows.filter(moves & ~paths.is_abs(F.col("name"))).select("process").distinct()
    earlier = W.partitionBy("process").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(moves, paths.clean(F.col("name"))), ignorenulls=True).over(earlier)
    simple = rows.join(relative, "process", "left_anti").withColumns({"cwd": F.coalesce(last, F.col("package_dir")), "after_chdir": F.coalesce(F.max(moves).over(earlier), F.lit(False))})

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        cwd, moved, at, after = group["package_dir"].iloc[0] if len(group) else "/", False, [], []
        for op, name, reason in zip(group["op"], group["name"], group["reason"]):
            at.append(cwd)
            after.append(moved)
            if op == "chdir" and reason is None:
                cwd, moved = normpath(name if isabs(name) else join(cwd, name)), True
        return group.assign(cwd=at, after_chdir=after)

    folded = rows.join(relative, "process", "left_semi").groupBy("process").applyInPandas(follow, simple.schema)
    return simple.unionByName(folded)


def classify(module_dir: Column, p: Column, state: Column) -> Column:
    """(kind, ident, reason) of a resolved path. Volatile roots are known by their names, without a look at the object."""
    rel = paths.rel_under(module_dir, p)
    none = F.lit(None).cast("string")
    out = lambda k, i, r: F.struct(k.alias("kind"), i.alias("ident"), r.alias("reason"))
    refuse = lambda r: out(none, none, r)
    return (
        F.when(~paths.representable(p), refuse(F.lit("unrepresentable runtime input path")))
        .when(rel.isNotNull(), out(F.lit("rel"), rel, none))
        .when(paths.volatile(p), refuse(F.concat(F.lit("volatile OS input: "), p)))
        .when(F.coalesce(state["exists"], F.lit(False)) & (state["kind"] == "dir"), refuse(F.concat(F.lit("external directory input: "), p)))
        .when(state.isNull(), refuse(F.concat(F.lit("unhashable runtime input: "), p)))
        .otherwise(out(F.lit("abs"), paths.clean(p), none))
    )


def contributions(ops: DataFrame, states: DataFrame, module_dir: str, recordless: DataFrame, excluded: DataFrame, declared: DataFrame, true_pwd: DataFrame) -> DataFrame:
    """ops (process, seq, op, name, reason, cwd, after_chdir, ambiguous) -> process, seq, kind, ident, bound: what each
    operation contributes. states: path, exists, kind. recordless (path): admitted roots, scratch and the like, found by
    guard_covered(), ephemeral(), in_namespace(); excluded (path); declared (path): resolved paths below a bracket's roots;
    true_pwd (process): PWD is the folder the process began in."""
    p = paths.resolve(F.col("cwd"), F.col("name"))
    rows = ops.withColumn("p", F.when(F.col("op").isin("open", "stat", "chdir"), p))
    flag = lambda df, name: df.select(F.col("path").alias("p"), F.lit(True).alias(name)).distinct()
    state = states.select(F.col("path").alias("p"), F.struct("exists", "kind").alias("state"))
    rows = rows.join(state, "p", "left").join(flag(recordless, "quiet"), "p", "left").join(flag(excluded, "out"), "p", "left").join(flag(declared, "inside"), "p", "left").join(true_pwd.select("process", F.lit(True).alias("pwd")), "process", "left")
    loose = F.coalesce("after_chdir", F.lit(False)) & ~paths.is_abs(F.col("name")) & (F.col("op") != "chdir")
    doubt = F.coalesce("ambiguous", F.lit(False)) | loose
    entry = lambda k, i, b=False: F.struct(k.alias("kind"), i.alias("ident"), F.lit(b).alias("bound"))
    say = lambda r: entry(F.lit("unverifiable"), r)
    nothing = F.array().cast("array<struct<kind:string,ident:string,bound:boolean>>")
    where = classify(F.lit(module_dir), F.col("p"), F.col("state"))
    shown = where["ident"]
    own = F.array(entry(where["kind"], shown))
    doubts = F.array_compact(F.array(F.when(F.coalesce("ambiguous", F.lit(False)), say(F.concat(F.lit("ambiguous parent traversal: "), shown))), F.when(loose, say(F.concat(F.lit("relative runtime input after working-directory change: "), shown)))))
    admitted = ~doubt & (F.coalesce("quiet", F.lit(False)) | (F.col("p") == "/dev/null"))
    beyond = ~doubt & paths.is_abs(F.col("p")) & ~paths.under(F.col("p"), F.lit(module_dir)) & ~paths.volatile(F.col("p"))
    exists = F.coalesce(F.col("state.exists"), F.lit(False))
    binds = beyond & F.col("state").isNotNull() & (~exists | (F.col("state.kind") == "dir"))
    stat = F.when(F.coalesce("inside", F.lit(False)), F.array().cast("array<struct<kind:string,ident:string,bound:boolean>>")).otherwise(F.array(say(F.concat(F.lit("stat metadata input: "), shown))))
    refused = F.array(say(where["reason"]))
    left = F.coalesce("out", F.lit(False))
    seal = F.array(say(F.lit("working-directory change")))
    got = (
        F.when(F.col("reason").isNotNull(), F.array(say(F.col("reason"))))
        .when((F.col("op") == "getenv") & (F.col("name") == "PWD"), F.when(F.coalesce("pwd", F.lit(False)), nothing).otherwise(F.array(say(F.lit("process-local environment input: PWD")))))
        .when(F.col("op") == "getenv", F.array(entry(F.lit("env"), F.col("name"))))
        .when(F.col("op") == "chdir", F.when(left, seal).when(where["reason"].isNotNull(), F.concat(refused, seal)).otherwise(F.concat(own, seal, doubts)))
        .when(admitted | left, nothing)
        .when((F.col("op") == "stat") & binds, F.array(entry(F.lit("abs"), F.col("p"), True)))
        .when(where["reason"].isNotNull(), refused)
        .when(F.col("op") == "stat", F.concat(own, stat, doubts))
        .otherwise(F.concat(own, doubts))
    )
    return rows.select("process", "seq", F.explode(got).alias("e")).select("process", "seq", "e.kind", "e.ident", "e.bound")


def first_seen(rows: DataFrame) -> DataFrame:
    """Each identity of a process once, where it came first."""
    kept = rows.groupBy("process", "kind", "ident").agg(F.min("seq").alias("seq"), F.bool_or("bound").alias("bound"))
    return kept


def uncovered(identities: DataFrame, coverage: DataFrame) -> DataFrame:
    """Reasons of identities (process, kind, ident, bound) that no bracket covers (ident, covered, escaped). What existence
    or the machine binds needs none."""
    exempt = F.coalesce("bound", F.lit(False)) | ((F.col("kind") == "abs") & F.col("ident").isin(*paths.MACHINE_FACT_FILES))
    rows = identities.filter(F.col("kind").isin("rel", "abs") & ~exempt).join(coverage, "ident", "left").filter(~F.coalesce("covered", F.lit(False)))
    link = F.when(F.col("escaped").isNotNull() & paths.representable(F.col("escaped")), F.concat(F.lit(" (symlink outside every bracket root: "), "escaped", F.lit(")"))).otherwise("")
    return rows.select("process", F.lit("unverifiable").alias("kind"), F.concat(F.lit("runtime input not covered by observation bracket: "), "ident", link).alias("ident"))


def ephemeral(objects: DataFrame, roots: DataFrame, module_dir: str) -> DataFrame:
    """(path) admitted below an ephemeral root: the root itself, or deeper what is absent; never inside the module."""
    up = objects.filter(~paths.under(F.col("path"), F.lit(module_dir))).withColumn("up", F.explode(paths.prefixes(F.col("path"))))
    hit = up.join(roots.select(F.col("path").alias("up")), "up")
    return hit.filter((F.col("up") == F.col("path")) | ~F.coalesce("exists", F.lit(False))).select("path").distinct()


def congruent(steps: DataFrame) -> DataFrame:
    """(id, ambiguous) of paths with '..': every folder stepped back from (id, prefix, kind) must be a real one."""
    return steps.groupBy("id").agg(F.bool_or(~F.coalesce(F.col("kind") == "dir", F.lit(False))).alias("ambiguous"))


def stepped_back(path: Column) -> Column:
    """Prefixes of a path that a '..' steps back from, as arrays' joined text."""
    parts = F.split(path, "/")
    at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i.cast("int")) == "..")
    return F.transform(at, lambda i: F.array_join(F.slice(parts, 1, i.cast("int") - 1), "/"))


def observe_frame(rows: DataFrame) -> DataFrame:
    """rows (process, header, sealed, bracket_moved, error...) -> process, refusal: the first of a producer's refusals."""
    text = (
        F.when(~F.coalesce("header", F.lit(False)), "test log header missing")
        .when(F.coalesce("sealed", F.lit(True)), "view already sealed")
        .when(F.coalesce(F.col("bracket_reason"), F.lit("")) != "", F.col("bracket_reason"))
        .otherwise("")
    )
    return rows.select("process", text.alias("refusal"))


def lines_of(files: DataFrame) -> DataFrame:
    """files (path, content) as read with Spark's binary reader -> process, seq, line: bytes, not yet text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                lines = bytes(content).split(b"\n")
                lines = lines[:-1] if lines and not lines[-1] else lines
                yield pd.DataFrame({"process": [path] * len(lines), "seq": range(len(lines)), "line": lines})

    return files.select("path", "content").mapInPandas(cut, "process string, seq bigint, line binary")
