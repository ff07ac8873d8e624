"""Connected components of links between ids, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """id and root, the smallest id that links reach, for every id in links (a, b).

    Each round every id takes the least root among itself and its neighbours (a minimum that is combined before the
    shuffle, so that an id with very many links does no harm), links are redrawn between roots, and links inside one
    root go. Trees of roots are then flattened by pointer jumping. Rounds are as many as the logarithm of the longest path.
    """
    links = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    parents = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        step = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "hooks")
        # Every id points to a smaller one or to itself: a forest. Jump until all point to a root.
        while True:
            up = step.select(F.col("id").alias("mid"), F.col("to").alias("top"))
            nxt = step.join(up, step["to"] == up["mid"]).select("id", F.col("top").alias("to"), (F.col("top") != step["to"]).alias("moved"))
            nxt = cut(nxt, "jumps")
            step = nxt.select("id", "to")
            if nxt.filter("moved").isEmpty():
                break
        parents = step if parents is None else cut(
            parents.join(step.select(F.col("id").alias("mid"), F.col("to").alias("top")), F.col("to") == F.col("mid"), "left").select("id", F.coalesce("top", "to").alias("to")), "roots"
        )
        ra, rb = (step.select(F.col("id").alias(k), F.col("to").alias(f"r{k}")) for k in "ab")
        links = links.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = cut(links.distinct(), "links")
    if parents is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return parents.select("id", F.col("to").alias("root"))
