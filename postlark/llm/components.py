"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) of every document in links (a, b); label is the least doc_id reachable.

    Large-star and small-star steps in turn, each a grouping by one end: every step points documents at
    the least neighbour that they know of, until nothing changes. The number of steps grows with the
    logarithm of the longest chain. Self-links and repeated links don't matter.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))
