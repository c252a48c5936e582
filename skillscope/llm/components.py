"""Connected components of a link table, by alternating star operations.

Each round points every larger neighbour of a node at the smallest node around
it, then every smaller one; links turn into stars around the least node of their
component in a logarithmic number of rounds.  All work is grouping and joining
on nodes; tables between rounds are written to the shared scratch folder.  The
links never leave the executors; the driver sees one count and one checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) that is not itself the
    least node, the root, of its component.  Self links and repeated links do
    no harm."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours of u move to the least node around u
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # (what a join reads is written first, so that adaptive execution sees plain shuffles and can split a hub)
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                       .distinct(), "large")
        # small star: u and its smaller neighbours move to the least of them (every link is stored larger node first)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct())
        after = stored(small, "links")
        # the links stay as they are once their number and an order-free checksum do
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for done in (edges, least, large, low):
            drop_stored(done)
        edges = after
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
