"""Connected components by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; nodes of one component share a root.

    Each round hooks every node to its least neighbour, follows the hooks twice, and replaces the ends
    of the edges by what they hang on; edges within one tree vanish. Rounds grow with the logarithm
    of the longest chain. All state is in tables of the shared folder; the driver sees counts only.
    """
    left = edges.select("u", "v").where("u <> v")
    assigned = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        for _ in range(2):
            over = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(over, "p").select("u", F.col("pp").alias("p"))
        hook = staged(hook, "hooks")
        if assigned is None:
            assigned = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = hook.select(F.col("u").alias("root"), F.col("p").alias("next"))
            assigned = assigned.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        left = (
            left.join(hook, "u").select(F.col("p").alias("a"), F.col("v").alias("u"))
            .join(hook, "u").select("a", F.col("p").alias("b"))
            .where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        left = staged(left, "edges")
        if left.isEmpty():
            return assigned
        assigned = staged(assigned, "assigned")
