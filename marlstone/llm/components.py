"""Connected components by alternating large and small stars, in the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import remove


def components(edges: DataFrame, place: str) -> DataFrame:
    """``edges``: a, b. Returns node, root: the smallest node that links reach, for every node with a link.

    Each round turns the links of every node towards the smallest one that it knows; rounds grow with
    the logarithm of the longest chain, and go on until nothing changes. Links stay distributed; only their number and a checksum come
    to the driver.
    """
    spark: SparkSession = edges.sparkSession
    edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().write.parquet(f"{place}/0")
    now, before = spark.read.parquet(f"{place}/0"), None
    for k in count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small.where("u <> v").distinct().write.parquet(f"{place}/{k}")
        now = spark.read.parquet(f"{place}/{k}")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        remove(f"{place}/{k - 1}")
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
