"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half of the alternating algorithm of large and small stars: neighbours move to the least neighbour. A hub's
    neighbours are never gathered: its least one is an aggregate that is joined back."""
    if large:
        pairs = _both_ways(links)
        keep = F.col("v") > F.col("u")
    else:  # from the larger end to the smaller one
        pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        keep = F.lit(True)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (id, component): the smallest id reachable, for every id that has a link to another.

    Self-links, repeated links and either direction are fine; null ends are left out; an empty table gives an empty
    table. Large and small stars alternate (a logarithmic number of rounds in practice) until a round changes nothing;
    every round is a written table, so lineage stays short."""
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        links = materialise(_star(_star(links, True), False))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(ends.select(F.col("component").alias("id"), "component").distinct())
