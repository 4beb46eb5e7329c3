"""Lengths and numbers of shortest paths, by a breadth-first walk from many nodes at once.

A round takes the frontier, pairs of a start and a node at distance k, to the nodes at distance k + 1: a join with the
relationships (parallel ones are one pair with a count), a sum by start and node, and an anti-join with what was visited. A path
to a node at distance k + 1 is one to a neighbour at distance k and one relationship more, so the sums count the shortest paths.
Each frontier is written to the shared folder, and the next round reads it: plans stay short, and lost executors lose nothing.

Starts with the same neighbours (and as many relationships with each) are one class: whatever is farther away is as far from each
of them, by as many paths, as no shortest path comes back to its start. So the walk begins at the neighbours of one start of each
class, and its others join at the end, after the nodes that nobody asked for are left out: starts around one hub, which all
reach each other, make pairs only there. Equal classes are told by two 64-bit hashes' sums over the neighbours and their number.

Shortest paths between different nodes never use a relationship or node twice, so they are trails. A start doesn't reach
itself. A null id reaches nothing; repeated starts count once; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators import hubs
from tarnweave.sources.graph import Graph
from tarnweave.sources.shared import stash

#: Numbers of paths grow as powers of the degrees.
COUNT = "decimal(38,0)"


def reached(graph: Graph, starts: DataFrame, types: Sequence[str] = (), directed: bool = False, most: int | None = None) -> DataFrame:
    """(start_id, node_id, length, n_paths) for each start (column id) and every other node that it reaches, by at most `most`
    relationships if that is given. Rounds go on until a frontier is empty."""
    return expanded(*walked(graph, starts, types, directed, most)).select("start_id", "node_id", "length", "n_paths")


def expanded(members: DataFrame, found: DataFrame) -> DataFrame:
    """What walked() gives, or rows of it with more columns, as a row for each start and node."""
    return hubs.meet(members, found.withColumnRenamed("_class", "_of"), "_class", "_of", "node_id", F.col("start_id") != F.col("node_id")).drop("_class", "_of")


def walked(graph: Graph, starts: DataFrame, types: Sequence[str] = (), directed: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(_class, start_id) of the starts that have neighbours, and (_class, node_id, length, n_paths) of what each class reaches,
    its own starts perhaps among it."""
    rels = graph.rels if directed else graph.undirected()
    rels = rels.filter(F.col("type").isin(*types)) if types else rels
    pairs = rels.filter("start <> end").groupBy(F.col("start").alias("_s"), F.col("end").alias("_e")).agg(F.count("*").cast("long").alias("_k"))
    pairs = stash(pairs, "pairs")
    first = starts.filter("id IS NOT NULL").distinct().join(pairs, F.col("id") == F.col("_s"))
    total = lambda seed: F.sum(F.xxhash64("_e", "_k", F.lit(seed)).cast("decimal(20,0)"))
    told = first.groupBy(F.col("id").alias("start_id")).agg(F.count("*").alias("_n"), total(1).alias("_a"), total(2).alias("_b"))
    told = stash(told, "starts")
    by = ["_n", "_a", "_b"]
    classes = stash(told.groupBy(*by).agg(F.min("start_id").alias("_class")), "classes")
    members = stash(told.join(classes, by).select("_class", "start_id"), "members")
    near = classes.join(pairs, F.col("_class") == F.col("_s")).select("_class", F.col("_e").alias("node_id"), F.col("_k").cast(COUNT).alias("n_paths"))
    visited = [stash(near if most is None or most > 0 else near.limit(0), "frontier")]
    while most is None or len(visited) < most:
        met = hubs.meet(visited[-1], pairs, "node_id", "_s", "_e")
        ahead = met.groupBy("_class", F.col("_e").alias("node_id")).agg(F.sum(F.col("n_paths") * F.col("_k").cast("decimal(20,0)")).cast(COUNT).alias("n_paths"))
        # without directions, what is next to a frontier lies in it, in the one before or in the one after
        before = reduce(DataFrame.union, [v.select("_class", "node_id") for v in (visited if directed else visited[-2:])])
        ahead = stash(ahead.join(before, ["_class", "node_id"], "left_anti"), "frontier")
        if ahead.isEmpty():
            break
        visited.append(ahead)
    found = reduce(DataFrame.union, [v.select("_class", "node_id", F.lit(k).alias("length"), "n_paths") for k, v in enumerate(visited, 1)])
    return members, found
