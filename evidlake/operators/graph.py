"""Traversals over edge tables, all starts at once, one join per level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.session import written


def reachable(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """starts (start), edges (src, dst) -> start, node, depth: every node within max_depth steps, by its least
    depth; the start itself has depth 0. Each level joins only the nodes first met on the last one."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    seen = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    frontier, levels = seen, seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(levels.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        levels = levels.unionByName(frontier)
    return levels


def provenance(starts: DataFrame, edges: DataFrame, known: DataFrame, max_depth: int = 64) -> DataFrame:
    """Per start: nodes reached, roots (known, without parents), dangling (unknown), whether it leads back to itself.

    known: node; stale ones exist here too. A diamond is visited once."""
    r = reachable(starts, edges, max_depth).select("start", "node", "depth")
    up = edges.select(F.col("src").alias("node")).distinct().withColumn("has_parent", F.lit(True))
    j = r.join(known.select("node").distinct().withColumn("known", F.lit(True)), "node", "left").join(up, "node", "left")
    back = r.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("start")), ["node", "start"], "left_semi").select("start").distinct().withColumn("cycle", F.lit(True))
    g = j.groupBy("start").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("known") & F.col("has_parent").isNull()).alias("n_roots"), F.count_if(F.col("known").isNull()).alias("n_dangling")
    )
    return g.join(back, "start", "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def provenance_nodes(starts: DataFrame, edges: DataFrame, known: DataFrame, max_depth: int = 64) -> DataFrame:
    """start, node, depth, state: root (known, without parents), dangling (unknown), cut (parents beyond max_depth, at most
    1,024) or inner."""
    if not 0 <= max_depth <= 1024:
        raise ValueError("max_depth must be between 0 and 1024")
    up = edges.filter("dst is not null").select(F.col("src").alias("node")).distinct().withColumn("up", F.lit(True))
    j = reachable(starts, edges, max_depth).join(known.select("node").distinct().withColumn("known", F.lit(True)), "node", "left").join(up, "node", "left")
    state = F.when(F.col("known").isNull(), "dangling").when(F.col("up").isNull(), "root").when(F.col("depth") == max_depth, "cut").otherwise("inner")
    return j.select("start", "node", "depth", state.alias("state"))


def provenance_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """start, src, dst: the edges between the nodes of ``provenance_nodes`` that were followed."""
    open_ = nodes.filter("state <> 'cut'").select("start", F.col("node").alias("src"))
    return open_.join(edges.select("src", "dst").filter("dst is not null").distinct(), "src").select("start", "src", "dst")


def with_ttl(seeds: DataFrame, now: str) -> DataFrame:
    """Peer edges of seeds (..., ttl_days): expires_at is that many days after ``now``, null without."""
    at = F.date_format(F.lit(now).cast("timestamp") + F.make_interval(days=F.col("ttl_days")), "yyyy-MM-dd")
    return seeds.withColumn("expires_at", F.when(F.col("ttl_days").isNotNull(), at)).drop("ttl_days")


def swept(peers: DataFrame, graphs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Peers and graphs that stay when expired edges, and then graphs without any edge, are deleted."""
    kept = live_peers(peers, now)
    return kept, graphs.join(kept.select("slug").distinct(), "slug", "left_semi")


def live_peers(peers: DataFrame, now: str) -> DataFrame:
    """Edges without an end of life or with one not yet past."""
    return peers.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def without_peers(graphs: DataFrame, peers: DataFrame) -> DataFrame:
    """Graphs that no edge belongs to any more."""
    return graphs.join(peers.select("slug").distinct(), "slug", "left_anti")
