"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapwise.llm.common import stage_table


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``links(a, b)``.

    Alternates two kinds of steps until nothing changes: a *large* step
    attaches a node's larger neighbours to its smallest neighbour, a *small* step
    attaches its smaller neighbours to the smallest of them.  Both keep the
    components and end in one star per component after a logarithmic number of
    rounds.  A hub only meets its own smallest neighbour (a partial
    aggregate), never all pairs of its neighbours.
    """
    edges = stage_table(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
                        .where("low <> high").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        new = _state(edges)
        if new == state:
            break
        state = new
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")) \
            .unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.where("v > u").join(least, "u").select(F.col("_m").alias("low"), F.col("v").alias("high"))
        first = large.groupBy("high").agg(F.min("low").alias("_m"))
        small = large.join(first, "high")
        edges = stage_table(
            small.select(F.col("_m").alias("low"), F.col("low").alias("high")).where("low <> high")
            .unionByName(first.select(F.col("_m").alias("low"), "high")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")) \
                .unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
