"""Connected components of a written table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washboard.llm.common import stage


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node in ``links`` (a, b: bigint); the component is its smallest node.

    Alternating star steps: the large star ties each node's larger neighbours to the smallest node it knows, the small star
    does the same for the smaller ones. The links stay at most twice as many and the rounds are logarithmic in
    practice. Each step is a minimum per node, combined before its shuffle, joined to the links, so no node's
    neighbours ever meet in one task. Rounds stop when all links point at their smallest node."""
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = stage(links.filter(F.col("a") != F.col("b")).select(*pair).distinct(), label)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.filter(F.col("u") != F.col("v")), label)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(lowest, "u")
        small = tied.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), label)
        if done(after):
            break
        now = after
    roots = after.select(F.col("v").alias("node")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def done(links: DataFrame) -> bool:
    """Whether every node has one link and no root is itself linked to a smaller node."""
    doubled = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1)
    if doubled.count():
        return False
    chained = links.select("u").join(links.select(F.col("v").alias("u")), "u", "left_semi").limit(1)
    return not chained.count()
