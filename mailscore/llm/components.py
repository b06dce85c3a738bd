"""Connected components of a table of links, by alternating large and small stars.

A large star ties the larger neighbours of a node to its smallest neighbour, a small star the smaller ones and the node
itself; the links end as one star around the smallest node of each component. Every step is an aggregate and a join on
the node, written to the shared folder, so no component is ever gathered in one place.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscore.session import ensure_checkpoint_dir


def _large(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = both.where("b > a").join(lowest, "a")
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct()


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle and checkpoint files of tables that nothing refers to any more.

    It does so when the driver collects garbage, which a loop of many small steps does not bring about by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node with a link other than to itself.

    ``links`` has the columns a and b; nulls, repeated and reversed links are harmless, an empty table gives none.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = links.select("a", "b").where("a <> b").distinct().checkpoint()
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while True:
        links = _small(_large(links)).checkpoint()
        now = links.agg(mark.alias("m")).first()["m"]
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
        release(links.sparkSession)
