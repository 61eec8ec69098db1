"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop_path, fresh_path


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of links (a long, b long).

    Each round is two joins and two small aggregations over the links; long chains shrink geometrically. Tables go to
    the shared folder, so lineage stays short and nothing is collected.
    """
    spark = links.sparkSession
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = fresh_path(spark, "links")
    edges.write.parquet(path)
    before = None
    for _ in range(rounds):
        edges = spark.read.parquet(path)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = fresh_path(spark, "links")
        done.write.parquet(new)
        drop_path(spark, path)
        path = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = spark.read.schema("u long, v long").parquet(path)
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
