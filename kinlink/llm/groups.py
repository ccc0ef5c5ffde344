"""Consolidating pairwise links into groups by seed-tree pruning.

Every round, each vertex finds the smallest id among itself and its neighbours and proposes it to all of them. A vertex
that nobody proposes is no minimum of any neighbourhood: it drops out of the graph and hangs below the smallest id
proposed to it, in a forest. The others are linked to that smallest id and go on. Vertices left alone are seeds, and in
the end their ids flow down the forest. Rounds grow with the logarithm of the longest chain; each is made of
aggregations with map-side combine and equi-joins, so a vertex with a third of all links costs a skewed join partition
that adaptive execution splits, never a collected list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.scratch import Scratch


def linked_ids(lists: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(u, v) of each list element with its row's id. Ids are trimmed, blank ids and elements vanish; an id without any
    element comes with v null, an element of a row without id with u null."""
    trimmed = lambda c: F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    nothing = lambda c: F.when(F.length(c) > 0, c)
    each = lists.select(nothing(trimmed(F.col(id_col))).alias("u"), F.explode_outer(F.split(F.coalesce(F.col(list_col), F.lit("")), ",")).alias("v"))
    return each.select("u", nothing(trimmed(F.col("v"))).alias("v")).where("u is not null or v is not null").distinct()


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("u"), F.col(b).alias("v")).union(df.select(F.col(b), F.col(a)))


def connected_groups(links: DataFrame, scratch: Scratch | None = None, most_rounds: int = 200) -> DataFrame:
    """(entity_id, group_id) for every id in links(u, v), group_id the smallest id linked directly or indirectly.

    Either side may be null (the other then only counts as an id), u may equal v, links may be repeated and point either
    way. An empty table gives an empty result. Works on any type that orders; strings in the order of their bytes."""
    scratch = scratch or Scratch(links.sparkSession, "groups")
    links = scratch.cut(links.select("u", "v").distinct())
    ids = links.select(F.explode(F.array("u", "v")).alias("entity_id")).where("entity_id is not null").distinct()
    edges = scratch.cut(_both(links.where("u is not null and v is not null and u <> v"), "u", "v").distinct())
    forest: list[DataFrame] = []
    while not edges.isEmpty():
        if len(forest) == most_rounds:
            raise RuntimeError(f"no end after {most_rounds} rounds")
        least = edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        proposed = edges.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select("u", "m")).distinct()
        proposed = scratch.cut(proposed)
        best = proposed.groupBy("x").agg(F.min("m").alias("top"), F.max(F.col("m") == F.col("x")).alias("stays"))
        forest.append(best.where(~F.col("stays")).select("x", "top"))
        ahead = proposed.join(best.select("x", "top"), "x").where(F.col("m") != F.col("top")).select("m", "top")
        after = scratch.cut(_both(ahead.distinct(), "m", "top").distinct())
        scratch.drop(edges)
        edges = after
    if not forest:
        return ids.select("entity_id", F.col("entity_id").alias("group_id"))
    # what hangs below a vertex fell before it, so paths are as short as there were rounds; each pass halves them
    label = scratch.cut(reduce(DataFrame.union, forest))
    for _ in range((len(forest) - 1).bit_length()):
        over = label.select(F.col("x").alias("top"), F.col("top").alias("seed"))
        label = scratch.cut(label.join(over, "top", "left").select("x", F.coalesce("seed", "top").alias("top")))
    label = label.withColumnRenamed("top", "seed")
    return ids.join(label.withColumnRenamed("x", "entity_id"), "entity_id", "left").select("entity_id", F.coalesce("seed", "entity_id").alias("group_id"))


def group_sizes(groups: DataFrame, by: Column | str = "group_id") -> DataFrame:
    return groups.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
