"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two pre-aggregated group-bys and joins over the edge table, so no vertex's
neighbourhood is gathered in one task, and nothing but two counters per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamcast.llm.common import StageTable, release


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u long, v long); root is the component's least node.

    Self-loops and repeated edges are harmless; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    now = StageTable(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    while True:
        state = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        nxt = StageTable(_small(_large(now.df)), "edges")
        now.drop()
        now = nxt
        release(spark)
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
