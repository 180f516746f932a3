"""Connected components of an edge table by large-star and small-star rounds.

Only edges move: a large-star round hangs a node's larger neighbours on its smallest
neighbour, a small-star round the smaller ones, until every component is one star. Hubs
are met by partial minima and by joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.shared import kept


def _least(edges: DataFrame) -> DataFrame:
    """Each node u with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    joined = edges.join(_least(edges), "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(cls, root) for every node of the links (u, v), root being its component's smallest node; roots themselves are left out."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, _ = kept(spark, edges, "components")
    was = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        was = now
        edges, _ = kept(spark, _small(_large(edges)), "components")
