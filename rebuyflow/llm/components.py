"""Connected components of a distributed edge list by alternating star contractions.

A round joins every node's larger neighbours to the smallest node in its neighbourhood, then does the same among the
smaller ones; the edge set turns into stars around the components' smallest nodes. Minima are combined before the
shuffle and stored before they are joined back, so a hub with a third of all edges is split by adaptive execution. No
edge, label or component reaches the driver, only a checksum a round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebuyflow.plans.stages import stage


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum("lo")).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the smallest node reachable. Self-loops and nulls are ignored."""
    edges = (edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).distinct())
    edges = stage(edges, "edges")
    seen = _checksum(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-minima")
        large = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct(), "star-large")
        below = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "star-below")
        small = (large.join(below, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(below.select("hi", F.col("m").alias("lo"))).distinct())
        edges = stage(small, "edges")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
