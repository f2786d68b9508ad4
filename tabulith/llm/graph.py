"""Connected components of links, as joins and aggregates over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import drop, materialize


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b); a root is the least node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): every round hangs nodes on smaller
    ones until all hang on roots. No group is gathered: a node's links meet in a minimum alone.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    last, seen = None, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(m.withColumnRenamed("m", "v")).distinct()
        now = materialize(small, "links")
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        if last is not None:
            drop(last)
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = last = now
        seen = sign
