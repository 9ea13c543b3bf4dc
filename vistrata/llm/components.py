"""Connected components of a link table, by alternating star steps.

Each round hangs every node on the least of its neighbours, first its larger
neighbours, then its smaller ones, until nothing changes (Kiveris et al.,
"Connected components in MapReduce and beyond", SoCC 2014). Only two numbers per
round reach the driver; every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vistrata.plans.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``) except the roots.

    The root is the least node of its component.
    """
    edges = materialise(
        links.filter(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(),
        "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select(
            "src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").filter(F.col("dst") > F.col("src")).select(
            F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = materialise(large, "edges")
        lower = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(lower, "src").filter(F.col("dst") != F.col("m")).select(
            F.col("dst").alias("src"), F.col("m").alias("dst"))
        edges = materialise(
            small.unionByName(lower.select("src", F.col("m").alias("dst"))).distinct(), "edges")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
