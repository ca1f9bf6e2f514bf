"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrade.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every end of `links` (columns u, v; not null).

    Each round hooks every node to its smallest neighbour below it, follows the hooks twice, and contracts the graph,
    until no link is left.  Rounds grow with the logarithm of the longest path; every step is a join or an aggregation
    with partial sums, so a node with very many links is no heavy task.
    """
    edges = materialize(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where(F.col("a") < F.col("b")).distinct())
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")))
        for _ in range(2):
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(further, "to", "left").select("from", F.coalesce("next", "to").alias("to"))
        hooks = materialize(hooks)

        def follow(df: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            return df.join(hooks.withColumnRenamed("from", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        roots = materialize(follow(roots, "root"))
        moved = follow(follow(edges, "a"), "b")
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct())
    return roots.select("node", "root")
