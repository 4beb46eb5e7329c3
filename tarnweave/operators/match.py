"""Pattern matching as joins: a small fluent API whose every step adds a join or filter to a DataFrame.

A match has flat columns `<variable>_<property>`, so unused properties never leave the scans. Nothing runs until an
action. Joins run in the order of the steps, from the rows that are bound already: begin with the selective end.

    Match.nodes(graph, "c", "Customer", where=name_like("c", "(?i).*smith.*")).both("r", "o", "Order").returns(...)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.operators import hubs
from tarnweave.sources.adjacency import AdjacentGraph
from tarnweave.sources.graph import NODE, OWN_ENDS, PROVENANCE, REL, Graph
from tarnweave.sources.shared import stash

#: The deepest trail that is expanded: each step is a join with all relationships.
MOST_HOPS = 4
#: Rows that a listing shows unless told otherwise.
LIMIT = 20


def matches(value: Column, pattern: str) -> Column:
    """Whether the whole string matches, dots matching line ends and (?i) folding all letters. Null stays null."""
    flags = "(?us)" if "(?i)" in pattern else "(?s)"
    return value.rlike(rf"{flags}\A(?:{pattern})\z")


def name_like(var: str, pattern: str) -> Column:
    return matches(F.col(f"{var}_name"), pattern)


def prop(var: str, name: str, kind: str = "string") -> Column:
    """An open property of a variable, as a value of the type: null where it is absent or has no such value."""
    return F.try_variant_get(F.col(f"{var}_properties"), f"$['{name}']", kind)


def contains_word(var: str, word: str) -> Column:
    """Case-blind substring search: what the pattern (?i).*word.* finds, without a regular expression."""
    return F.contains(F.lower(F.col(f"{var}_name")), F.lit(word.lower()))


def has_labels(labels: Column, wanted: Sequence[str]) -> Column:
    """All of them. Null labels have none."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(labels, x), F.lit(False)) for x in wanted], F.lit(True))


class Match:
    """Rows of bound variables."""

    def __init__(self, graph: Graph, frame: DataFrame, at: str):
        self.graph, self.frame, self.at = graph, frame, at

    @classmethod
    def nodes(cls, graph: Graph, var: str, *labels: str, where: Column | None = None) -> Match:
        return cls(graph, _nodes(graph, var, labels, where, graph.first), var)

    def _expand(self, rels: DataFrame, rel: str, to: str, labels: Sequence[str], types: Sequence[str], where: Column | None, near: str, far: str, how: str, start: str | None) -> Match:
        end = _nodes(self.graph, to, labels, None)
        if how == "inner" and isinstance(self.graph, AdjacentGraph):
            way = "in" if near == "end" else "out" if rels is self.graph.rels else "both"
            frame = self.graph.meet(self.frame, f"{start or self.at}_id", rel, way, types).join(end, F.col(f"{rel}_{far}") == F.col(f"{to}_id"))
            return Match(self.graph, frame.filter(where) if where is not None else frame, to)
        rels = rels.filter(F.col("type").isin(*types)) if types else rels
        rels = rels.select(*[F.col(c).alias(f"{rel}_{c}") for c in (*REL, *OWN_ENDS) if c in rels.columns])
        met = F.col(f"{start or self.at}_id") == F.col(f"{rel}_{near}")
        if how == "inner":
            # the bound rows meet their relationships first, and only what they reach meets the far nodes
            frame = self.frame.join(rels, met).join(end, F.col(f"{rel}_{far}") == F.col(f"{to}_id"))
            return Match(self.graph, frame.filter(where) if where is not None else frame, to)
        # where the pattern is optional, a relationship and its far node match as a unit
        reached = rels.join(end, F.col(f"{rel}_{far}") == F.col(f"{to}_id"))
        reached = reached.filter(where) if where is not None else reached
        return Match(self.graph, self.frame.join(reached, met, how), to)

    def out(self, rel: str, to: str, *labels: str, types: Sequence[str] = (), where: Column | None = None, start: str | None = None) -> Match:
        """(at)-[rel]->(to)"""
        return self._expand(self.graph.rels, rel, to, labels, types, where, "start", "end", "inner", start)

    def into(self, rel: str, to: str, *labels: str, types: Sequence[str] = (), where: Column | None = None, start: str | None = None) -> Match:
        """(at)<-[rel]-(to)"""
        return self._expand(self.graph.rels, rel, to, labels, types, where, "end", "start", "inner", start)

    def both(self, rel: str, to: str, *labels: str, types: Sequence[str] = (), where: Column | None = None, start: str | None = None, ends: bool = False) -> Match:
        """(at)-[rel]-(to): every relationship once from each end, a loop once. ends: <rel>_own_start and <rel>_own_end too, the
        ids that the relationship itself has for its ends; adjacency lists don't have those."""
        if ends and isinstance(self.graph, AdjacentGraph):
            raise ValueError("adjacency lists don't have the relationships' own ends")
        return self._expand(self.graph.undirected(ends) if ends else self.graph.undirected(), rel, to, labels, types, where, "start", "end", "inner", start)

    def optional_out(self, rel: str, to: str, *labels: str, types: Sequence[str] = (), where: Column | None = None, start: str | None = None) -> Match:
        """As out(); rows without a match stay, with nulls. `where` is part of the pattern."""
        return self._expand(self.graph.rels, rel, to, labels, types, where, "start", "end", "left", start)

    def where(self, condition: Column) -> Match:
        return Match(self.graph, self.frame.filter(condition), self.at)

    def exists(self, types: Sequence[str] = (), undirected: bool = True) -> Match:
        """Rows whose node has such a relationship."""
        return self._semi(types, undirected, "left_semi")

    def missing(self, types: Sequence[str] = (), undirected: bool = True) -> Match:
        """Rows whose node has none."""
        return self._semi(types, undirected, "left_anti")

    def _semi(self, types: Sequence[str], undirected: bool, how: str) -> Match:
        rels = self.graph.undirected() if undirected else self.graph.rels
        rels = rels.filter(F.col("type").isin(*types)) if types else rels
        return Match(self.graph, self.frame.join(rels.select(F.col("start").alias("_start")), F.col(f"{self.at}_id") == F.col("_start"), how), self.at)

    def trails(self, to: str, *labels: str, least: int = 1, most: int = 3, types: Sequence[str] = (), directed: bool = False, names: bool | Callable[[Column], Column] = True, where: Column | None = None) -> Match:
        """All trails of `least` to `most` relationships, none used twice; nodes may repeat. Adds path_node_ids, path_rels
        (type and provenance), path_ids and length, the last node as `to`, and path_nodes (names) where `names` asks
        for them; a function there is of each name, and is done once for a node and not for each trail.

        Where the last node has labels or a condition (`where`, on its columns), halves of the trails are walked from both ends
        and meet in the middle; the walk takes ids only, and the nodes are read once for the names, at its end. Each half is
        written to the shared folder before the next hop, so no hop is walked twice. Trails to any node are as many as hubs make
        them, so those of the last hop are not written: each relationship brings its far node along."""
        if not 0 <= least <= most <= MOST_HOPS:
            raise ValueError(f"trails have up to {MOST_HOPS} relationships: {least} to {most}")
        rels = self.graph.rels if directed else self.graph.undirected()
        rels = rels.filter(F.col("type").isin(*types)) if types else rels
        step = rels.select(F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("id").alias("_r"), F.struct("type", *PROVENANCE).alias("_p"))
        ends = _nodes(self.graph, to, labels, where)
        first = _halves(self.frame, f"{self.at}_id")
        named = names if callable(names) else lambda x: x
        if not labels and where is None:
            first = first.withColumn("path_nodes", F.array(named(F.col(f"{self.at}_name")))) if names else first
            every = _walked(first, step, ends, to, least, most, named)
            return Match(self.graph, every.withColumn("length", F.size("path_ids")).drop("_end"), to)
        every = _met(first, _halves(ends.select(f"{to}_id"), f"{to}_id").drop(f"{to}_id"), step, least, most)
        every = every.withColumn("length", F.size("path_ids")).join(ends, F.col("_end") == F.col(f"{to}_id")).drop("_end")
        return Match(self.graph, _named(self.graph, stash(every, "trails"), named) if names else every, to)

    def nearest(self, to: str, *labels: str, types: Sequence[str] = (), directed: bool = False, most: int | None = None, where: Column | None = None) -> Match:
        """Every other node that the bound one reaches, as `to`, with `length`, the relationships of the shortest paths there, and
        n_paths, how many those are. No path is listed, so there is no bound on their lengths but `most`. Where the nodes have labels
        or a condition (`where`, on their columns), the others are left out before each start's rows are made."""
        from tarnweave.operators.shortest import expanded, walked

        members, found = walked(self.graph, self.frame.select(F.col(f"{self.at}_id").alias("id")), types, directed, most)
        found = found.join(_nodes(self.graph, to, labels, where), F.col("node_id") == F.col(f"{to}_id"))
        frame = expanded(members.join(self.frame, F.col("start_id") == F.col(f"{self.at}_id")), found)
        return Match(self.graph, frame.drop("start_id", "node_id"), to)

    def shortest(self, start: str) -> Match:
        """Of trails, those as short as any between their ends; start: the variable that they begin at."""
        w = Window.partitionBy(f"{start}_id", f"{self.at}_id")
        least = self.frame.withColumn("_least", F.min("length").over(w))
        return Match(self.graph, least.filter(F.col("length") == F.col("_least")).drop("_least"), self.at)

    def returns(self, *columns: Column | str, rel: str | Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        """The columns, with the provenance of `rel` where they don't name it themselves; of several relationships, that of
        each under its own name. `limit` takes the first rows in the order of all columns that can be ordered, so that it
        is the same rows each time."""
        out = self.frame.select(*columns)
        if rel is not None and not isinstance(rel, str):
            out = self.frame.select(*columns, *[F.col(f"{r}_{c}") for r in rel for c in PROVENANCE if f"{r}_{c}" not in out.columns])
        elif rel is not None:
            more = [F.col(f"{rel}_{c}").alias(c) for c in PROVENANCE if c not in out.columns]
            out = self.frame.select(*columns, *more)
        if limit is not None:
            out = out.orderBy(*[c for c, kind in out.dtypes if "map<" not in kind and "variant" not in kind]).limit(limit)
        return out


def _nodes(graph: Graph, var: str, labels: Sequence[str], where: Column | None, among: DataFrame | None = None) -> DataFrame:
    nodes = among if among is not None else graph.nodes
    nodes = nodes.filter(has_labels(F.col("labels"), labels)) if labels else nodes
    nodes = nodes.select(*[F.col(c).alias(f"{var}_{c}") for c in NODE if c in nodes.columns])
    return nodes.filter(where) if where is not None else nodes


_PATH_RELS = "array<struct<type:string,evidence:string,source_file:string,chunk_id:string,confidence:double>>"


def _halves(frame: DataFrame, key: str) -> DataFrame:
    """The rows as trails without relationships."""
    return frame.withColumns({"path_node_ids": F.array(key), "path_rels": F.array().cast(_PATH_RELS), "path_ids": F.array().cast("array<string>"), "_end": F.col(key)})


def _hop(now: DataFrame, step: DataFrame, back: bool = False) -> DataFrame:
    """One more relationship at the end of each trail, or before its start, which is then `_end`."""
    near, far = ("_e", "_s") if back else ("_s", "_e")
    return _longer(now.join(step, (F.col("_end") == F.col(near)) & _unused()), far, back)


def _unused() -> Column:
    """A trail's relationships are different."""
    return ~F.array_contains("path_ids", F.col("_r"))


def _longer(met: DataFrame, far: str, back: bool = False) -> DataFrame:
    """Trails with the relationship that each has met, and its far node's name where trails have names."""
    put = (lambda a, x: F.concat(F.array(x), a)) if back else (lambda a, x: F.concat(a, F.array(x)))
    more = {"path_nodes": put(F.col("path_nodes"), F.col("_name"))} if "path_nodes" in met.columns else {}
    return met.withColumns({
        "path_node_ids": put(F.col("path_node_ids"), F.col(far)),
        "path_rels": put(F.col("path_rels"), F.col("_p")),
        "path_ids": put(F.col("path_ids"), F.col("_r")),
        **more,
        "_end": F.col(far),
    }).drop("_s", "_e", "_r", "_p", "_name")


def _walked(first: DataFrame, step: DataFrame, ends: DataFrame, to: str, least: int, most: int, named: Callable[[Column], Column]) -> DataFrame:
    """Trails of all lengths, with the node as `to` where they end. Shorter ones are written, and the next hop reads them."""
    at_end = F.col("_end") == F.col(f"{to}_id")
    reached = step.join(ends, F.col("_e") == F.col(f"{to}_id")).withColumn("_name", named(F.col(f"{to}_name")))
    found = [first.join(ends, at_end)] if least == 0 else []
    for k in range(1, most + 1):
        longer = _longer(hubs.meet(first, reached, "_end", "_s", "_r", _unused()), "_e")
        if k == most:
            found.append(longer)
            break
        first = stash(longer.select(*first.columns), "hops")
        found += [first.join(ends, at_end)] if k >= least else []
    return reduce(DataFrame.unionByName, found)


def _met(first: DataFrame, last: DataFrame, step: DataFrame, least: int, most: int) -> DataFrame:
    """Trails of all lengths from the rows of `first` to those of `last`: of n relationships, the first half (rounded up) is
    walked from the start and the others back from the end. The last hop from the start takes only relationships that another
    half goes on from without them, so it leaves no hub toward nodes from which no end is near enough, and none toward those
    that only the way back leads from."""
    backs = [last]
    for _ in range(most // 2):
        backs.append(stash(_hop(backs[-1], step, back=True), "backs"))
    fronts, longest = [first], (most + 1) // 2
    for k in range(1, longest + 1):
        own = step
        if k == longest:
            near = reduce(DataFrame.union, [b.select(F.col("_end").alias("_near"), F.col("path_ids").alias("_used")) for b in backs])
            own = step.join(near, (F.col("_e") == F.col("_near")) & ~F.array_contains("_used", F.col("_r")), "left_semi")
        front = _hop(fronts[-1], own)
        once = k == longest and sum(least <= n <= most for n in (2 * k - 1, 2 * k)) < 2  # nothing else reads it
        fronts.append(front if once else stash(front, "fronts"))
    found = []
    for n in range(least, most + 1):
        front, back = fronts[(n + 1) // 2], backs[n // 2]
        back = back.select(F.col("path_node_ids").alias("_n"), F.col("path_rels").alias("_p"), F.col("path_ids").alias("_i"), F.col("_end").alias("_middle"))
        both = front.join(back, (F.col("_end") == F.col("_middle")) & ~F.arrays_overlap("path_ids", "_i"))
        both = both.withColumns({
            "path_node_ids": F.concat("path_node_ids", F.slice("_n", 2, F.greatest(F.size("_n") - 1, F.lit(0)))),
            "path_rels": F.concat("path_rels", "_p"),
            "path_ids": F.concat("path_ids", "_i"),
            "_end": F.element_at("_n", -1),
        })
        found.append(both.drop("_n", "_p", "_i", "_middle"))
    return reduce(DataFrame.unionByName, found)


def _named(graph: Graph, trails: DataFrame, named: Callable[[Column], Column]) -> DataFrame:
    """trails with path_nodes, what `named` makes of the names of path_node_ids, which are looked up once for each different path."""
    paths = trails.select(F.col("path_node_ids").alias("_path")).distinct()
    places = paths.select("_path", F.posexplode("_path").alias("_at", "_id"))
    names = graph.nodes.select(F.col("id").alias("_n"), named(F.col("name")).alias("_name"))
    known = places.join(names, F.col("_id") == F.col("_n")).groupBy("_path").agg(F.sort_array(F.collect_list(F.struct("_at", "_name"))).alias("_names"))
    joined = trails.join(known, F.col("path_node_ids") == F.col("_path"))
    return joined.withColumn("path_nodes", F.transform("_names", lambda x: x["_name"])).drop("_path", "_names")


def degrees(graph: Graph) -> DataFrame:
    """(id, n_out, n_in, n_neighbors) of every node; loops count out and in, and the node as its own neighbour. The
    relationships are read once."""
    end = lambda a, b, out: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    ends = graph.rels.select(F.inline(F.array(end("start", "end", 1), end("end", "start", 0))))
    # by pairs first: repeated relationships of two nodes shrink before they meet in one key
    pairs = ends.groupBy("id", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    counted = pairs.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("n_neighbors"))
    zero = {"n_out": 0, "n_in": 0, "n_neighbors": 0}
    return graph.nodes.select("id").join(counted, "id", "left").fillna(zero)


def low_confidence(confidence: Column, least: float = 0.7) -> Column:
    """Whether a statement needs a warning: its confidence is known and below the bound."""
    return F.coalesce(confidence < least, F.lit(False))
