"""Distributed connected components, by alternating large and small stars.

Edges shrink to stars around the smallest node of each component. Each round is two joins and aggregates with partial
sums, and is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of the number of nodes.
A join on a hub would bring all its edges to one task, so both sides of the joins have a salt: nodes of more than
`HUB` edges are dealt to as many salts as they have times so many edges, the others have one. Where there are no more
edges than that in all, there is no hub, and the joins go without.

Cases: no edges give no rows; repeated edges, both directions and loops are fine; edges with a null end are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.common import stash


#: Edges of a node that one salt takes.
HUB = 100_000


def _toward_less(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_least(edges: DataFrame, on: str, least: DataFrame) -> DataFrame:
    """edges with _m of the node in column `on`. least: _u, _m and perhaps _n, the node's number of edges."""
    if "_n" not in least.columns:
        return edges.join(least, F.col(on) == F.col("_u"))
    salts = F.ceil(F.col("_n") / HUB).cast("int")
    hubs = least.filter(F.col("_n") > HUB).select(F.col("_u").alias("_h"), salts.alias("_s"))
    dealt = edges.join(hubs, edges[on] == hubs["_h"], "left")
    dealt = dealt.withColumn("_s", F.when(F.col("_s").isNull(), 0).otherwise(F.pmod(F.xxhash64("a", "b"), F.col("_s")))).drop("_h")
    every = least.withColumn("_t", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("_n")
    return dealt.join(every, (F.col(on) == F.col("_u")) & (F.col("_s") == F.col("_t"))).drop("_s", "_t")


def large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Links every larger neighbour of a node to the least neighbour."""
    both = edges.select("a", "b", F.lit(0).alias("_own")).union(edges.select("b", "a", F.lit(1)))
    number = [F.sum("_own").alias("_n")] if hubs else []
    least = both.groupBy(F.col("a").alias("_u")).agg(F.min("b").alias("_m"), *number)
    least = least.withColumn("_m", F.least("_u", "_m"))
    least = least.filter("_n > 0") if hubs else least
    return _with_least(edges, "b", least).select("a", F.col("_m").alias("b")).distinct()


def small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    number = [F.count("*").alias("_n")] if hubs else []
    least = edges.groupBy(F.col("a").alias("_u")).agg(F.min("b").alias("_m"), *number)
    moved = _with_least(edges, "a", least).select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b")
    return moved.union(least.select("_u", "_m")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, but for the least of its component, with that least node."""
    now = stash(_toward_less(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new[0] == 0 or new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new
        hubs = new[0] > HUB
        now = stash(small_star(large_star(now, hubs), hubs), "edges")
