"""Connected components of a graph that stays on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.storage import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge list can reach.

    Alternates two rewritings of the edge list, of which the number of edges never grows: every node
    links its larger neighbours to its smallest one, then its smaller ones. The result is a star per
    component, after a number of rounds that is logarithmic in practice. Nodes are of one orderable
    type; edges may repeat and point either way; edges with a null end and loops are dropped. A node
    of very many edges is aggregated partially before the shuffle, then joined, where Spark splits it.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}"
    )
    links = stored(links.distinct(), "components")
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        links = stored(small.distinct(), "components")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
