"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.session import written


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) -> (node, component): the component is its least node. Direction, repeated edges and
    loops don't matter; edges with a null end are ignored.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every edge is moved to the least
    node of its neighbourhood until nothing moves, in about log(n) rounds. Each round is a written table,
    so lineage stays short and lost executors cost one round at most. No neighbourhood is collected: the
    least neighbour is an aggregate, combined map-side.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    now = written(
        e.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc"
    )
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.filter("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(least, "src")
        nxt = written(
            joined.filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .unionByName(least.select("src", F.col("low").alias("dst")))
            .distinct(),
            "cc",
        )
        same = nxt.exceptAll(now).isEmpty() and now.exceptAll(nxt).isEmpty()
        now = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
