"""Mixing sources to target weights: hierarchical budgeting over a tree of domain, language and source.

Each node's token budget is divided among its children in proportion to their integer weights; a child that cannot use its
share (capacity: the tokens below it times max_epochs) takes its capacity, and what it leaves goes to its siblings in
proportion to their weights. Only what all children together cannot take stays with the parent's siblings, as a parent's
own share is bounded by its capacity. In closed form: children in order of capacity a weight fill up to a common water
level, found with running sums over the (small) table of nodes.

A leaf's documents are taken in seeded epochs: whole epochs while the budget lasts, then from the next epoch's order (md5
of seed, epoch and id) the longest prefix within what is left. A prefix of an order by hash is a threshold on the hash, so
the rows themselves are never sorted or moved: narrow rows are summed in buckets of hash ranges, and only the bucket in
which a budget ends is put in order, about bucket_rows rows a leaf, however large the leaf.

Tokens of a text: its maximal runs of other than ASCII white space.

Edge cases: null keys of the tree count as 'none'; null and empty texts have 0 tokens and come with any prefix that
reaches them; ids that repeat share a hash and are taken or left together; null ids hash as the text 'null'; budgets are
rounded down to whole tokens; a budget beyond all capacity takes everything max_epochs times; an empty table gives no rows;
input columns named as outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

#: Leaves up to which the plan is broadcast to the rows; beyond it, they are joined by a shuffle.
BROADCAST_LEAVES = 20_000
LEVELS = ["domain", "lang", "source"]
#: Weights of the production mix; what is not named weighs 1.
WEIGHTS = {"domain": {"d1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3}}


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_tree(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """docs with the tree's keys. domain: which domain a row belongs to, over its columns; by default the given tables'
    rule, by the length of the source's name."""
    source = F.coalesce(F.col("source"), F.lit("none"))
    if domain is None:
        domain = F.concat(F.lit("d"), (F.length(source) % 3).cast("string"))
    return docs.withColumns({"domain": F.coalesce(domain, F.lit("none")), "source": source, "lang": F.coalesce("lang", F.lit("none"))})


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        if int(w) < 1:
            raise ValueError("weights are whole numbers of at least 1")
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, total, weights: dict, max_epochs: int) -> DataFrame:
    """leaves (tree keys, tokens, docs) with budget, in whole tokens. total: a Column over the one row of all leaves."""
    capacity = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = capacity.agg(F.floor(F.least(total, F.sum("cap"))).cast("long").alias("budget"))
    for depth in range(1, len(LEVELS) + 1):
        keys = LEVELS[:depth]
        nodes = capacity.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(keys[-1], weights))
        nodes = nodes.join(above, keys[:-1]) if depth > 1 else nodes.crossJoin(above)  # one row above the first level
        ratio = F.col("cap").cast("double") / F.col("w")
        order = W.partitionBy(*(keys[:-1] or [F.lit(0)])).orderBy(ratio, keys[-1]).rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*(keys[:-1] or [F.lit(0)]))
        left = F.col("budget") - F.coalesce(F.sum("cap").over(order), F.lit(0))
        weight_left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(order), F.lit(0))
        nodes = nodes.withColumn("level", left.cast("double") / weight_left).withColumn("full", ratio <= F.col("level"))
        water = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0), F.floor(F.col("w") * water)).cast("long"))
        above = nodes.withColumn("share", share).select(*keys, F.col("share").alias("budget"))
    return leaves.join(above, LEVELS)


def order_hash(epoch: Column, seed: int, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def plan(docs: DataFrame, share: tuple[int, int] = (3, 5), weights: dict | None = None, max_epochs: int = 2, seed: int = 6, bucket_rows: int = 2048) -> DataFrame:
    """docs (tree keys, doc_id, n_tokens) -> one row a leaf: whole epochs, and of the next epoch the largest hash that is
    taken (null: none). share: the target as a fraction of all tokens."""
    weights = WEIGHTS if weights is None else weights
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = budgets(leaves, F.sum("tokens") * share[0] / share[1], weights, max_epochs)
    once = F.greatest(F.col("tokens"), F.lit(1))
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") == 0, F.lit(max_epochs)).otherwise(F.floor(F.col("budget") / once)).cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    leaves = materialise(leaves.withColumn("buckets", F.ceil(F.col("docs") / bucket_rows)), "leaves")
    rows = attach(docs, leaves.filter(F.col("epochs") < max_epochs)).withColumn("h", order_hash(F.col("epochs"), seed))
    place = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32)
    rows = rows.select(*LEVELS, "rest", "n_tokens", "h", place.alias("bucket"))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"), F.max("rest").alias("rest"), F.max("h").alias("top"))
    ordered = W.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("sum").over(ordered) - F.col("sum"))
    sums = materialise(sums, "buckets")
    whole = sums.filter("before + sum <= rest").select(*LEVELS, F.col("top").alias("h"))
    ends = sums.filter("before <= rest and before + sum > rest").select(*LEVELS, "bucket", "before")
    # rows of one hash (null ids have one) are taken or left together: one row each before the window
    inner = rows.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "bucket", "before", "rest", "h").agg(F.sum("n_tokens").alias("n_tokens"))
    running = F.sum("n_tokens").over(W.partitionBy(*LEVELS, "bucket").orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow))
    part = inner.withColumn("run", F.col("before") + running).filter("run <= rest").select(*LEVELS, "h")
    cut = whole.unionByName(part).groupBy(*LEVELS).agg(F.max("h").alias("cut"))
    return materialise(leaves.select(*LEVELS, "epochs").join(cut, LEVELS, "left"), "plan")


def attach(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """docs with their leaf's columns; the leaf table is broadcast only where counted to be small."""
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return docs.join(F.broadcast(leaves) if small else leaves, LEVELS)


def select(docs: DataFrame, leaf_plan: DataFrame, max_epochs: int = 2, seed: int = 6) -> DataFrame:
    """docs (with tree keys), a row for each epoch that takes it, with epoch."""
    rows = attach(docs, leaf_plan)
    taken = F.coalesce(order_hash(F.col("epochs"), seed) <= F.col("cut"), F.lit(False)) & (F.col("epochs") < max_epochs)
    n = F.col("epochs") + taken.cast("int")
    return rows.filter(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), n - 1))).drop("epochs", "cut")


def narrow(docs: DataFrame) -> DataFrame:
    return materialise(with_tree(docs.select("doc_id", "lang", "source", tokens().alias("n_tokens"))), "sizes")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = narrow(table(spark, sf_dir, "documents"))
    return select(rows, plan(rows)).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def _level_sql(n: int, keys: list[str], weight: str) -> str:
    parents = ", ".join(keys[:-1]) or "0"
    join = f"JOIN b{n - 1} USING ({', '.join(keys[:-1])})" if len(keys) > 1 else "CROSS JOIN b0"
    cols = ", ".join(keys)
    return f"""
n{n} AS (SELECT {cols}, sum(cap)::BIGINT AS cap, {weight} AS w FROM leaf GROUP BY {cols}),
l{n} AS (SELECT {cols}, cap, w, cap::DOUBLE / w AS ratio,
  (budget - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER (PARTITION BY {parents}) - coalesce(sum(w) OVER o, 0)) AS level
  FROM n{n} {join} WINDOW o AS (PARTITION BY {parents} ORDER BY cap::DOUBLE / w, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b{n} AS (SELECT {cols}, CASE WHEN ratio <= level THEN cap ELSE
  greatest(0, floor(w * max(CASE WHEN ratio > level THEN level END) OVER (PARTITION BY {parents})))::BIGINT END AS budget FROM l{n}),"""


OP6_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  'd' || (length(coalesce(source, 'none')) % 3) AS domain, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS cap FROM d GROUP BY ALL),
b0 AS (SELECT floor(least(sum(tokens) * 3 / 5, sum(cap)))::BIGINT AS budget FROM leaf),"""
    + _level_sql(1, LEVELS[:1], "CASE WHEN domain = 'd1' THEN 2 ELSE 1 END")
    + _level_sql(2, LEVELS[:2], "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")
    + _level_sql(3, LEVELS, "CASE WHEN source = 'src0' THEN 3 ELSE 1 END")
    + """
p AS (SELECT leaf.*, CASE WHEN tokens = 0 THEN 2 ELSE budget // greatest(tokens, 1) END AS epochs, budget FROM leaf JOIN b3 USING (domain, lang, source)),
r AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest,
  sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('6:' || p.epochs || ':' || coalesce(doc_id::VARCHAR, 'null'))) AS run
  FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range(0, epochs + CASE WHEN epochs < 2 AND run <= rest THEN 1 ELSE 0 END))::INTEGER AS epoch, n_tokens FROM r
"""
)
