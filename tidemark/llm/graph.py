"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialise

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is its smallest node.

    Large-star and small-star steps alternate until every edge joins a node to its
    component's smallest node; the number of rounds is logarithmic in practice.
    Each step is a grouped minimum (combined before the shuffle) and one join
    whose large keys Spark can split, so a hub never lands in one task. Edges with
    a null end and self-loops are ignored. No edges give no rows.
    """
    state = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _fingerprint(state)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = materialise(small)
        now = _fingerprint(after)
        discard(state)
        state, done, mark = after, now == mark, now
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
