import pandas as pd

from evidentia.plans.catalogue import QUERIES


def _union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_every_link_of_lineitem_counts(spark, tmp_path):
    # no key is a multiple of 23 or 5, and (3, 7) alone joins two components
    rows = [(1, 1, 2), (2, 2, 2), (3, 3, 4), (4, 3, 6), (6, 4, 7), (7, 3, 7), (8, 9, 11), (8, 9, 11)]
    pd.DataFrame(rows, columns=["l_orderkey", "l_suppkey", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {r.node: r.root for r in QUERIES["carrier_components"](spark, str(tmp_path)).collect()}
    assert got == _union_find([(2 * s, 2 * p + 1) for _, s, p in rows]) and len(set(got.values())) == 3


def test_all_nodes_of_the_given_table(spark, sf):
    links = [(2 * r.l_suppkey, 2 * r.l_partkey + 1) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()]
    assert {r.node: r.root for r in QUERIES["carrier_components"](spark, sf).collect()} == _union_find(links)
