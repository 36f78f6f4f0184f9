"""Connected components of a link table, as DataFrame rounds.

Alternating large-star and small-star steps: every node is linked to the
smallest node it knows, until each component is a star around its smallest
node.  The number of rounds grows with the logarithm of the largest component.
Minima are aggregated before they are joined back, so a hub with many links is
never held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(links: DataFrame) -> DataFrame:
    return (links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` (the smallest node of the component) of every node that has a link, labels excepted."""
    stars = cut_lineage(_star(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        stars = cut_lineage(_star(small))
