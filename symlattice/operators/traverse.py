"""Bounded breadth-first search over call edges, level by level.

State is the set of visited nodes and a frontier. A frontier node's place is the path of edge ids by which it was first
found; comparing paths compares places, so no global numbering is needed. Each level takes the frontier's edges, drops
visited nodes and keeps, for each new node, the edge with the least path: an aggregate that Spark combines before it
shuffles. The edge that first discovers a node is emitted.

A frontier of at most ``LISTED`` nodes is named in the filter on the edges, so a layout in buckets opens only theirs; a
larger one is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

OUT, IN, BOTH = "out", "in", "both"
LISTED = 1000


def discover(edges: DataFrame, start: int, depth: int, direction: str = OUT, kind: int = 1, by_target: DataFrame | None = None) -> DataFrame:
    """(level, path, edge_id, from_id, to_id and, if edges have it, site) of discovering edges.

    ``edges`` has edge_id, from_id, to_id, kind. With ``by_target``, the same edges laid out by their targets, both are
    tables that each level reads; else the edges are what a plan says, which runs once.
    """
    spark = edges.sparkSession
    kept = ["edge_id", "from_id", "to_id", *[c for c in ("site",) if c in edges.columns]]
    calls = edges.filter(F.col("kind") == kind).select(*kept)
    calls, back = (calls, by_target.filter(F.col("kind") == kind).select(*kept)) if by_target is not None else (cut(calls),) * 2
    ways = [(calls, "from_id", "to_id")] * (direction != IN) + [(back, "to_id", "from_id")] * (direction != OUT)
    visited = spark.createDataFrame([(start,)], "nxt long")
    front = spark.createDataFrame([(start, [])], "cur long, path array<long>")
    levels = []
    for level in range(1, depth + 1):
        ids = [r["cur"] for r in front.select("cur").limit(LISTED + 1).collect()]
        steps = []
        for table, near, far in ways:
            here = table.filter(F.col(near).isin(ids)) if len(ids) <= LISTED else table
            steps.append(here.select(F.col(near).alias("cur"), F.col(far).alias("nxt"), *kept))
        step = steps[0].unionByName(steps[1]) if len(steps) > 1 else steps[0]
        found = front.join(step, "cur").join(visited, "nxt", "left_anti").withColumn("path", F.concat("path", F.array("edge_id")))
        first = found.groupBy("nxt").agg(F.min(F.struct("path", *kept)).alias("e"))
        new = cut(first.select(F.lit(level).alias("level"), "nxt", "e.*"))
        levels.append(new)
        front = new.select(F.col("nxt").alias("cur"), "path")
        visited = visited.unionByName(new.select("nxt"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.drop("nxt")


def capped(found: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` discovering edges in order."""
    return found.orderBy("level", "path").limit(rows)
