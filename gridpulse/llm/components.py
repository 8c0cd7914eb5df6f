"""Connected components of a link table by alternating large and small stars.

Each round is a few joins and aggregates by node; a node with very many links
is met by partial aggregation (its smallest neighbour) and a join whose large
partitions Spark splits. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import drop, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("x"), "m")
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): the smallest node of its component, for every linked node.

    Self-links and repeated links are allowed; null ends are not links. An empty
    table gives an empty table. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = written(e, "links")
    state = None
    while True:
        nxt, nxt_path = written(_small_star(_large_star(e)), "links")
        drop(spark, path)
        e, path = nxt, nxt_path
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
