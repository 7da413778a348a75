"""Explanations, on demand only: chains from a culprit to its marks, bounded; trails along unresolved edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin

BOUND = 24


def bounded(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """links (culprit, seq, protect, ...) -> at most `bound` of each culprit, and how many are left out: all, or the first
    bound - 1 and one more, the protected link if that comes later (the last of several), else the last of all."""
    whole = W.partitionBy("culprit")
    nth = F.row_number().over(whole.orderBy("seq"))
    rows = links.withColumns({"nth": nth, "total": F.count("*").over(whole)})
    late = F.max(F.when(F.col("protect") & (F.col("nth") >= bound), F.col("nth"))).over(whole)
    rows = rows.withColumn("late", F.coalesce(late, "total"))
    keep = (F.col("total") <= bound) | (F.col("nth") <= bound - 1) | (F.col("nth") == F.col("late"))
    return rows.filter(keep).withColumn("omitted", F.greatest(F.lit(0), F.col("total") - bound)).drop("nth", "total", "late")


def chains(culprits: DataFrame, mark_sites: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """culprits (culprit, var_key, class) -> links in order: the mark's own sites by position."""
    rows = culprits.join(mark_sites, ["var_key", "class"])
    return rows.withColumns({"seq": F.row_number().over(W.partitionBy("culprit").orderBy("pos", "clause")), "protect": F.col("clause") == "origin"})


def trail(edges: DataFrame, start: str, local: set[str]) -> list[str]:
    """Along unresolved edges (own, dep) from start to a local refusal, depth-first, least names first. Edges stay a table:
    one node's edges are asked for at a time, so the driver holds the walk and never the graph."""
    known = pin(edges.select("own", "dep").distinct(), "trail")
    stack, seen = [(start, [start])], set()
    while stack:
        node, path = stack.pop()
        if node in local:
            return path
        if node not in seen:
            seen.add(node)
            next_ = [r.dep for r in known.filter(F.col("own") == node).select("dep").orderBy(F.desc("dep")).collect()]
            stack.extend((d, [*path, d]) for d in next_ if d not in seen)
    return []


def param_display(key: Column) -> Column:
    """path, function and index, NUL-separated, as `path.function parameter index`; other keys with dots for NULs."""
    parts = F.split(key, "\0", 3)
    return F.when(F.size(parts) == 3, F.concat(parts[0], F.lit("."), parts[1], F.lit(" parameter "), parts[2])).otherwise(F.replace(key, F.lit("\0"), F.lit(".")))


def describe_observability(observable: Column, reason: Column) -> Column:
    return F.when(observable, F.lit("observable")).when(F.coalesce(reason, F.lit("")) == "", F.lit("not observable")).otherwise(F.concat(F.lit("not observable: "), reason))


def origin_site(position: Column) -> Column:
    return F.regexp_replace(position, r"^.*/", "")
