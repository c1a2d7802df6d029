"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.common import forget, write_once


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long nodes -> (node, root): the smallest node that each linked node reaches.

    Nodes without an edge to another node don't appear, nor do roots themselves. Repeated edges, loops
    and either direction are fine; null ends are dropped; no edges give no rows. Each round is written to the shared folder, and all
    its work is groupings with map-side minima and joins that adaptive execution may split.
    """
    stars = write_once(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = _mark(stars)
    while seen[0]:
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = write_once(
            both.join(low, "u").where("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(),
            "large-star",
        )
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        following = write_once(small.union(low).distinct(), "small-star")
        forget(stars)
        forget(large)
        stars, before = following, seen
        seen = _mark(stars)
        if seen == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
