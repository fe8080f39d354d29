"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key of the edges (a, b): the root is one key per component.

    In each round every key goes to its least neighbour and the edges move along; edges inside a key vanish. Each
    round's state is a written table. Hot keys only meet a partial minimum and joins that can be split.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    roots = stored(
        edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct().select("key", F.col("key").alias("root")), "roots"
    )
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("next")).where("next < root")
        least = stored(least, "least")

        def moved(df: DataFrame, name: str, least: DataFrame = least) -> DataFrame:
            step = least.select(F.col("root").alias(name), "next")
            return df.join(step, name, "left").withColumn(name, F.coalesce("next", name)).drop("next")

        roots = stored(moved(roots, "root").select("key", "root"), "roots")
        edges = stored(moved(moved(edges, "a"), "b").select("a", "b").where("a != b").distinct(), "edges")
    return roots
