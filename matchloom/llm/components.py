"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is its smallest node.

    Each round hooks every node to its smallest neighbour (a partial
    aggregation, so hubs do not skew), shortcuts the hooks, and contracts the
    edges to the hooks' roots.  At least half of the nodes of each open component
    go in a round, so edges shrink geometrically; rounds are written tables.
    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("up")), "hooks")
        while True:  # pointer doubling: hooks go down in value, so there are no cycles
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            doubled = materialize(hook.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hooks")
            hook = doubled.select("node", "up")
            if doubled.where("moved").isEmpty():
                break
        steps.append(hook)
        a = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = materialize(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("the contraction did not end")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0].select("node", F.col("up").alias("component"))
    for step in steps[1:]:
        up = step.select(F.col("node").alias("component"), F.col("up").alias("top"))
        out = out.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return out
