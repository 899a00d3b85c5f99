"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step joins edges with the smallest neighbour of a node; the table shrinks to stars whose centres are the smallest
nodes. Nothing is collected but two numbers a step that tell whether anything has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """(u, v) -> every chosen neighbour v of u is linked to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    least = least.select("c", F.least("c", "m").alias("m"))
    linked = pairs.join(least, F.col("u") == F.col("c")).select("u", "v", "m")
    if small:  # u itself hangs below m as well
        out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m")), F.struct(F.col("u").alias("x"), F.col("m")))).alias("e"))
        return out.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct()
    return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node."""
    big, low = F.greatest(a, b), F.least(a, b)
    now = cut(edges.filter(F.col(a) != F.col(b)).select(big.alias("u"), low.alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(now)
    while last[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = cut(_star(_star(both, small=False), small=True))
        this = mark(now)
        if this == last:
            break
        last = this
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
