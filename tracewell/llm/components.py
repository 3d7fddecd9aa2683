"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import discard, written_at


def components(links: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``links`` (``a``, ``b``) the smallest node it reaches.

    Each round points nodes at smaller neighbours until nothing changes; the number of rounds grows with
    the logarithm of the longest path.  Only minima per node are computed, combined map-side, and each
    round is a table in the shared folder.  The driver sees one number per round.
    """
    edges, folder = written_at(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                               .filter("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour, and the node itself, points to the node's minimum
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        # smaller neighbours, and the node itself, point to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        done = folder
        edges, folder = written_at(small, "links")
        discard(done)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == before:
            ends = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            return ends.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
