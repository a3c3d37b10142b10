"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.tables import cut


def _drop_hub(edges: DataFrame, larger: bool) -> DataFrame:
    """One half of the alternating star contraction.

    ``larger``: each node hands its larger neighbours to the least node it knows; else its smaller-or-equal ones. The
    neighbourhood is never gathered: its minimum is an aggregate with a partial step, joined back by node.
    """
    if larger:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an edge: component is the least node it is connected with.

    Alternates large-star and small-star steps until each node points at its root; the steps needed grow with the
    logarithm of the node count. Null ends and loops give no rows but do no harm; repeated edges are one edge. Every step
    is checkpointed to the shared folder, so a lost executor costs one step at most. An empty edge table gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(rounds):
        e = cut(_drop_hub(_drop_hub(e, True), False))
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


