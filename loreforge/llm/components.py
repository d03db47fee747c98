"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import discard, stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
    return r["n"], r["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): the component is its smallest node.

    A node's least neighbour is found by aggregation before it is joined to the node's edges, so a node with very many
    edges costs no task of its own. Rounds grow with the logarithm of the longest path; each is written, which cuts
    lineage. Loops and repeated edges do no harm; null ends are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = stored(small.where("a <> b").distinct(), "small-star")
        discard(e, large)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
