"""Connected components of an edge table, by alternating hooks to the smallest neighbour and pointer jumps.

All tables stay distributed; each round ends in a checkpoint. A vertex with very many neighbours is no burden: every
step is an aggregation that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, component: the smallest vertex each can reach. Vertices are those of the edges; nulls are left out."""
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    work = checkpointed(pairs)
    vertices = checkpointed(work.select(F.explode(F.array("u", "v")).alias("vertex")).distinct())
    # (vertex, parent): every root is the least vertex of its tree so far.
    label = vertices.select("vertex", F.col("vertex").alias("component"))
    while not work.isEmpty():
        # Each vertex hooks to the least of its neighbours' and its own.
        both = work.select(F.col("u").alias("x"), F.col("v").alias("y")).union(work.select(F.col("v"), F.col("u")))
        hook = checkpointed(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("parent")))
        # Jump until parents are roots; a chain halves each time.
        while True:
            up = hook.select(F.col("x").alias("parent"), F.col("parent").alias("above"))
            jumped = checkpointed(hook.join(up, "parent", "left").select("x", "parent", F.coalesce("above", "parent").alias("above")))
            moved = not jumped.where("above < parent").isEmpty()
            hook = jumped.select("x", F.col("above").alias("parent"))
            if not moved:
                break
        root = hook.select(F.col("x").alias("key"), F.col("parent").alias("root"))
        label = label.join(root, F.col("component") == F.col("key"), "left").select("vertex", F.coalesce("root", "component").alias("component"))
        label = checkpointed(label)
        # Contract: edges between roots remain.
        left = work.join(root, F.col("u") == F.col("key")).select(F.col("root").alias("ru"), "v")
        left = left.join(root, F.col("v") == F.col("key")).select("ru", F.col("root").alias("rv"))
        work = checkpointed(left.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).where("u < v").distinct())
    return label
