"""Fixpoints as semi-naive loops over DataFrames. Every round's new rows are pinned in the shared folder, so a plan never
grows with the number of rounds and a lost executor loses nothing. Nothing is gathered on the driver but counts."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin

#: Edges up to which a round joins by broadcast; counted once, before the loop.
BROADCAST_EDGES = 200_000


#: Rounds after which what was gathered is pinned as one table, so that its plan stays short.
FLATTEN = 16


def gather(so_far: DataFrame, new: DataFrame, n: int) -> DataFrame:
    both = so_far.unionByName(new)
    return pin(both, "gathered") if n % FLATTEN == FLATTEN - 1 else both


class BudgetExhausted(RuntimeError):
    """The rounds or the time allowed were not enough; the result is unavailable, not wrong."""


_DEADLINE: ContextVar[float | None] = ContextVar("deadline", default=None)


@contextmanager
def budget(seconds: float | None) -> Iterator[None]:
    """Fixpoints within the block end by that time on the wall clock, or raise BudgetExhausted. None: no bound."""
    token = _DEADLINE.set(None if seconds is None else time.monotonic() + seconds)
    try:
        yield
    finally:
        _DEADLINE.reset(token)


def rounds(what: str, most: int | None = None) -> Iterator[int]:
    """0, 1, 2, ... as far as the budget goes."""
    n = 0
    while most is None or n < most:
        deadline = _DEADLINE.get()
        if deadline is not None and time.monotonic() > deadline:
            break
        yield n
        n += 1
    raise BudgetExhausted(what)


def _edges(edges: DataFrame) -> DataFrame:
    kept = pin(edges.distinct(), "edges")
    return F.broadcast(kept) if kept.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES else kept


def reach(edges: DataFrame, seeds: DataFrame, keys: list[str] | None = None, max_rounds: int | None = None, edge_keys: list[str] | None = None) -> DataFrame:
    """edges (edge_keys..., src, dst), seeds (keys..., node) -> (keys..., node): everything reachable from each key's seeds,
    seeds too. edge_keys: those keys that an edge is bound to; other keys pass every edge."""
    keys, edge_keys = keys or [], edge_keys or []
    columns = [*keys, "node"]
    step = _edges(edges.select(*edge_keys, F.col("src").alias("node"), "dst"))
    delta = pin(seeds.select(*columns).distinct(), "delta")
    reached = delta
    for n in rounds("reach", max_rounds):
        new = delta.join(step, [*edge_keys, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        delta = pin(new.join(reached, columns, "left_anti"), "delta")
        if delta.isEmpty():
            return reached
        reached = gather(reached, delta, n)


def reach_masks(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """As reach(), for at most 64 keys as bits: seeds (node, mask) -> (node, mask). A round passes on the bits that are new."""
    step = _edges(edges.select("src", "dst"))
    total = pin(seeds.groupBy("node").agg(F.bit_or("mask").alias("mask")), "masks")
    delta = total
    for _ in rounds("reach_masks", max_rounds):
        came = delta.join(step, delta["node"] == step["src"]).groupBy(F.col("dst").alias("node")).agg(F.bit_or("mask").alias("add"))
        fresh = came.join(total, "node", "left").select("node", F.col("add").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("bigint")))).alias("mask")).filter("mask <> 0")
        delta = pin(fresh, "delta")
        if delta.isEmpty():
            return total
        total = pin(total.unionByName(delta).groupBy("node").agg(F.bit_or("mask").alias("mask")), "masks")


def least_proof(axioms: DataFrame, deps: DataFrame, owners: DataFrame | None = None, also: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(node) proven: an axiom, or an owner all of whose dependencies are proven. Cycles and what is not there refuse.
    deps (own, dep); owners: those that may be proven (default: all that own a dependency; one listed without any proves at
    once); also: nodes that satisfy a dependency without being proven themselves.

    Each owner's open dependencies are counted once; a round takes from the counts what the last round proved, and asks
    nothing of dependencies that it did not touch."""
    deps = pin(deps.select("own", "dep").distinct(), "deps")
    who = (owners.select(F.col("node")) if owners is not None else deps.select(F.col("own").alias("node"))).distinct()
    proven = pin(axioms.select("node").distinct(), "proven")
    good = proven if also is None else proven.unionByName(also.select("node")).distinct()
    sizes = deps.groupBy(F.col("own").alias("node")).agg(F.count("*").alias("open"))
    # owners still to be proven, with their open dependencies; null ids never are
    waiting = pin(who.join(sizes, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open")).join(good, "node", "left_anti"), "waiting")
    delta = pin(good, "good")
    for n in rounds("least_proof", max_rounds):
        met = deps.join(delta.select(F.col("node").alias("dep")), "dep").groupBy(F.col("own").alias("node")).agg(F.count("*").alias("met"))
        left = waiting.join(met, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"))
        left = pin(left, "waiting")
        delta = left.filter("open = 0").select("node")
        if delta.isEmpty():
            return proven
        proven, waiting = gather(proven, delta, n), left.filter("open > 0")


def fallen(breaks: DataFrame, deps: DataFrame, declared: DataFrame) -> DataFrame:
    """(node) that fall: broken ones, and what depends on a fallen or undeclared one. Cycles without a break stand."""
    undeclared = deps.select(F.col("dep").alias("node")).distinct().join(declared.select("node"), "node", "left_anti")
    seeds = breaks.select("node").unionByName(undeclared).distinct()
    back = deps.select(F.col("dep").alias("src"), F.col("own").alias("dst"))
    return reach(back, seeds).join(undeclared.join(breaks.select("node"), "node", "left_anti"), "node", "left_anti")


def init_only(refs: DataFrame) -> DataFrame:
    """refs (callee, region) -> (node): functions referred to from initialisation alone, or from such functions. One
    without references is not among them; a region that no function carries never proves."""
    deps = refs.filter(F.col("region") != "init").select(F.col("callee").alias("own"), F.col("region").alias("dep"))
    return least_proof(refs.select(F.col("callee").alias("node")).limit(0), deps, refs.select(F.col("callee").alias("node")))


def init_reach(refs: DataFrame) -> DataFrame:
    """(node): functions that some reference reaches from initialisation or program code, literals by their encloser."""
    region = F.regexp_replace("region", "^lit:", "")
    edges = refs.select(region.alias("src"), F.col("callee").alias("dst"))
    seeds = edges.filter(F.col("src").isin("init", "prog")).select(F.col("src").alias("node"))
    return reach(edges, seeds).join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """edges (a, b) -> (node, root: the least node of its component). Each round stars every node onto the least root that
    it or a neighbour knows, then onto that one's root: rounds grow with the logarithm of the longest path."""
    both = pin(edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in rounds("components", max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hop = labels.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = hop.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = pin(hop.join(jump, hop["root"] == jump["n2"], "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return labels
