"""Connected components of an edge table, never gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, root: the smallest node reachable), for nodes that occur in an edge.

    Alternating large-star and small-star rounds: each node links its larger neighbours, then its smaller ones, to the
    smallest node known to it, until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Each half round writes its edges to a table in the shared folder. Self-links and nulls are left out.
    """
    spark = edges.sparkSession
    schema = "a long, b long"

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, path = put(ordered)
    last = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        mid, mid_path = put(large)
        low = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        after, after_path = put(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        remove(spark, mid_path)
        now, path = after, after_path
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
