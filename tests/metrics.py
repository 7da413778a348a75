"""What Spark counted while a test ran."""


def joined(spark, run):
    """What run() gives, and the rows that joins made meanwhile, pinned tables included."""
    store = spark._jsparkSession.sharedState().statusStore()
    n = store.executionsCount()
    out, made = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for i in range(n, runs.size()):
        at = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size()) if "Join" in nodes.apply(j).name()):
            own = [node.metrics().apply(j) for j in range(node.metrics().size())]
            made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in own if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return out, made
