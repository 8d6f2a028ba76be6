"""Connected components of an edge table, without hubs' neighbours ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join


def _are_stars(e: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` that is no ``u`` itself."""
    out = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    inner = e.select("v").distinct().join(out.select(F.col("u").alias("v")), "v", "left_semi")
    return inner.isEmpty() and out.where("n > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, most: int = 50_000) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``edges(a, b)``.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the edges are stars, however many
    rounds that takes.  The edges of a hub of over ``most`` neighbours are dealt to several tasks.  Each round is written
    to the shared folder.  Null ends and loops are ignored; repeated edges count once; no edges: no rows.
    """
    e = scratch.put(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.put(spread_join(both.where("v > u"), least, "u", most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, scratch.put(small)
        scratch.drop(old)
        scratch.drop(large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
