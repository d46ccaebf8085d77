"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step moves links toward the smallest id in reach, until each vertex is linked to its component's
smallest id alone. Links stay on the executors; a vertex with very many links costs a partial minimum and a
join whose large side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_ROUNDS = 60
#: Links of a task.
PART = 250_000


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def toward(links: DataFrame, small: bool) -> DataFrame:
    """links: a > b. One star step; the result is again a > b, distinct."""
    near = links.select("a", "b") if small else both_ways(links)
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    met = near.join(least, "a")
    if small:
        moved = met.select(F.col("b").alias("x"), "m").unionAll(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = met.where("b > a").select(F.col("b").alias("x"), "m")
    return moved.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def settled(links: DataFrame) -> bool:
    """Whether every vertex has one link, to a vertex without links of its own."""
    twice = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    inner = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
    return twice.unionAll(inner).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every vertex with a link to another. links: a, b (long)."""
    one = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(one, "links")
    # small tables in few files: links only get fewer, and a task's share stays small
    parts = now.count() // PART + 1
    for _ in range(MOST_ROUNDS):
        if settled(now):
            break
        now = materialise(toward(toward(now, small=False), small=True).coalesce(parts), "links")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return materialise(now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots).coalesce(parts), "labels")


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links. label: id, component; the new links are followed between components only."""
    if links.isEmpty():
        return label
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(label.select(F.col("id").alias(side), F.col("component").alias("c")), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    top = components(ends).select(F.col("id").alias("component"), F.col("component").alias("top"))
    moved = label.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    new = top.join(label.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component"))
    return materialise(moved.unionAll(new), "labels")
