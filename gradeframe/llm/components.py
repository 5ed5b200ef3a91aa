"""Connected components by alternating stars; no link or component reaches the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.storage import written


def _state(edges: DataFrame) -> tuple:
    """A count and a checksum that tell whether a round changed anything."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``node, root`` for every node of ``links``, where root is the smallest node it can reach.

    Each round links all larger neighbours of a node to its smallest neighbour, then all smaller ones
    (large star, small star); the number of rounds grows with the logarithm of the longest path. Rounds are
    written, so that lineage stays short. The smallest neighbours are written before the join,
    which lets adaptive execution split a node with very many links. Links with a null end, links of a
    node with itself and repeated links change nothing; no links give an empty table.
    """
    edges = (
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    edges = written(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.min("v").alias("m")), "links-low")
        large = (
            both.where("v > u")
            .join(lowest, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = written(large, "links-large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "links-low")
        small = (
            large.join(lowest, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = written(small, "links-small")
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
