"""Connected components of a table of edges, by alternating large and small stars.

Each round is two shuffles over the edges alone and writes its table, so rounds
cost what is left of the edges and a lost executor repeats one round.  Hubs are
handled by a join that Spark may split, after an aggregation that it combines
before shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on rows (u, v): every v goes to the smallest neighbour of u."""
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("o"))
    back = edges.select(F.col("v").alias("c"), F.col("u").alias("o"))
    if large:
        around = both.unionByName(back)
    else:  # small: centre on the larger end
        around = edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("o"))
    least = around.groupBy("c").agg(F.min("o").alias("least")).select("c", F.least("c", "least").alias("m"))
    joined = around.join(least, "c")
    if large:
        out = joined.where(F.col("o") > F.col("c")).select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of an edge (a, b); comp is the smallest node."""
    ends = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(*ends).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        seen, k = state, k + 1
        mid = scratch.keep(_star(now, True), f"{name}-{k}a")
        now = scratch.keep(_star(mid, False), f"{name}-{k}b")
        scratch.drop(f"{name}-{k - 1}b" if k > 1 else f"{name}-0", f"{name}-{k}a")
