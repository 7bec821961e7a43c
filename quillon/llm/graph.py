"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), longs in either direction and repeated at will: (node, component), component being the smallest node reachable.

    In each round every node points to the neighbour of the lowest hash, if lower than its own, and the
    edges are carried over to what the ends point to. A random order shrinks chains as fast as stars. A
    table is written in each round; the driver only learns whether edges are left. Loops and nulls fall away;
    without edges the result is empty.
    """
    left = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mapping = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        order = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("node"))
        step = written(both.groupBy("u").agg(F.min(order("v")).alias("low")).select(F.col("u").alias("node"), F.least("low", order("u"))["node"].alias("root")), "roots")
        at = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        after = written(left.join(at("u"), "u").join(at("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).where("u <> v").distinct(), "edges")
        dropped(left)
        left = after
        if mapping is None:
            mapping = step
        else:
            further = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            grown = written(mapping.join(further, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots")
            dropped(mapping)
            dropped(step)
            mapping = grown
    if mapping is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    lowest = mapping.groupBy("root").agg(F.min("node").alias("component"))
    return mapping.join(lowest, "root").select("node", "component")
