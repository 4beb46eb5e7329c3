"""Adjacency lists, shortest paths, trails met in the middle and range joins, each against a plain version."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import hubs, match, ranges, shortest
from tarnweave.operators.match import Match
from tarnweave.operators.shortest import reached
from tarnweave.sources import adjacency
from tarnweave.sources.graph import NODE, REL, Graph, from_tables, open_object

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def graph(spark, names, rels):
    """names: id to label. rels: (id, type, start, end)."""
    nodes = spark.createDataFrame([(n, [label], f"N{n}", 1, {}) for n, label in names.items()], "id string, labels array<string>, name string, leiden_community long, properties map<string,string>")
    kind = "id string, type string, start string, end string, evidence string, source_file string, chunk_id string, confidence double, run_id string, properties map<string,string>"
    rels = spark.createDataFrame([(*r, f"e{r[0]}", "f", None, 0.5, None, {"k": r[0]}) for r in rels], kind)
    opened = open_object(F.col("properties"))
    return Graph(nodes.withColumn("properties", opened).select(*NODE), rels.withColumn("properties", opened).select(*REL))


def random_rels(seed, n_nodes, n):
    """Loops, parallel relationships, and a hub, node 0."""
    rng = random.Random(seed)
    rels = [(f"r{k}", rng.choice("PQ"), str(rng.randrange(n_nodes)), str(rng.randrange(n_nodes))) for k in range(n)]
    rels += [(f"h{k}", "P", "0", str(rng.randrange(n_nodes))) for k in range(2 * n_nodes)] + [("l", "Q", "3", "3"), ("p1", "P", "1", "2"), ("p2", "P", "1", "2")]
    return rels


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark, {str(k): "XYZ"[k % 3] for k in range(30)}, random_rels(1, 30, 40))


COLUMNS = ("x_id", "r_id", "r_type", "r_start", "r_end", "r_evidence", "r_confidence", "y_id", "y_labels")


@pytest.mark.parametrize("most", [4096, 7])
def test_expansions_through_lists_equal_edge_joins(spark, g, tmp_path, most):
    own = adjacency.write(g, f"file://{tmp_path}/{most}", f"own_{most}", buckets=3, most=most)
    assert (own.hubs is not None) == (most == 7)
    if own.hubs is not None:
        sizes = own.hubs.groupBy("id", "way", "type").agg(F.count("*").alias("n"), F.max(F.size("ends")).alias("most")).collect()
        assert max(r.n for r in sizes) > 5 and max(r.most for r in sizes) <= 7
    for step in ("out", "into", "both"):
        for types, labels in ((), ()), (("Q",), ("Y",)):
            take = lambda graph: getattr(Match.nodes(graph, "x", "X"), step)("r", "y", *labels, types=types)  # noqa: B023, E731
            want = rows(take(g).frame.select(*COLUMNS))
            assert want and rows(take(own).frame.select(*COLUMNS)) == want
    two = lambda graph: rows(Match.nodes(graph, "x", "X").both("q", "m").out("r", "y").frame.select("q_id", *COLUMNS))
    assert two(own) == two(g)
    back = adjacency.read(spark, f"file://{tmp_path}/{most}", f"own_{most}", g.rels, own.hubs is not None)
    assert rows(Match.nodes(back, "x").both("r", "y").returns("x_id", "r_id")) == rows(Match.nodes(g, "x").both("r", "y").returns("x_id", "r_id"))


def test_nothing_is_exchanged_below_an_expansion(spark, g, tmp_path):
    own = adjacency.write(g, f"file://{tmp_path}/plain", "plain", buckets=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = own.meet(Match.nodes(own, "x", "X").frame, "x_id", "r", "both", ())
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def breadth_first(rels, start, directed, types=None, most=None):
    near = collections.defaultdict(list)
    for _, t, a, b in rels:
        if a != b and (types is None or t in types):
            near[a].append(b)
            if not directed:
                near[b].append(a)
    far, count, now, k = {start: 0}, {start: 1}, [start], 0
    while now and (most is None or k < most):
        k += 1
        ahead = collections.Counter()
        for x in now:
            for y in near[x]:
                if y not in far:
                    ahead[y] += count[x]
        far |= dict.fromkeys(ahead, k)
        count |= ahead
        now = list(ahead)
    return [(start, y, k, count[y]) for y, k in far.items() if y != start]


@pytest.mark.parametrize(("directed", "types", "most"), [(False, None, None), (True, None, None), (False, ("Q",), None), (True, ("P",), 2)])
def test_shortest_paths(spark, directed, types, most):
    chain = [(f"c{k}", "Q", str(100 + k), str(101 + k)) for k in range(9)] + [("d", "Q", "104", "106"), ("d2", "Q", "103", "104")]
    rels = random_rels(5, 25, 25) + chain
    own = graph(spark, {x: "X" for r in rels for x in r[2:]}, rels)
    starts = spark.createDataFrame([("0",), ("7",), ("100",), ("100",), (None,), ("nowhere",)], "id string")
    got = [(r.start_id, r.node_id, r.length, int(r.n_paths)) for r in reached(own, starts, types or (), directed, most).collect()]
    want = [x for s in ("0", "7", "100") for x in breadth_first(rels, s, directed, types, most)]
    assert sorted(got) == sorted(want) and (most or max(x[2] for x in got) > 4)
    assert reached(own, starts.limit(0)).count() == 0


def test_nearest_gives_the_rows_of_shortest_trails(g):
    old = Match.nodes(g, "a", "X").trails("z", least=1, most=3, names=False).where(F.col("a_id") != F.col("z_id")).shortest("a")
    want = rows(old.frame.groupBy("a_id", "z_id").agg(F.min("length"), F.count("*")))
    new = Match.nodes(g, "a", "X").nearest("z", most=3).frame
    assert rows(new.select("a_id", "z_id", "length", F.col("n_paths").cast("long"))) == want
    assert "path_ids" not in new.columns and "array" not in str([f.dataType for f in reached(g, g.nodes.select("id")).schema])


@pytest.mark.parametrize(("least", "most", "directed", "types"), [(1, 3, False, ()), (0, 4, True, ()), (2, 4, False, ("Q",)), (1, 1, False, ()), (0, 0, False, ()), (2, 2, True, ("P",))])
def test_trails_meet_in_the_middle(spark, least, most, directed, types):
    own = graph(spark, {str(k): "XYZ"[k % 3] for k in range(12)}, random_rels(2, 12, 6)[:20] + [("l", "Q", "3", "3"), ("p1", "P", "1", "2"), ("p2", "P", "1", "2")])
    what = ("x_id", "z_id", "path_node_ids", "path_ids", "path_nodes", "length", F.to_json("path_rels"))
    how = {"least": least, "most": most, "directed": directed, "types": types}
    plain = Match.nodes(own, "x", "X").trails("z", **how).where(F.array_contains("z_labels", "Y"))
    assert rows(Match.nodes(own, "x", "X").trails("z", "Y", **how).frame.select(*what)) == rows(plain.frame.select(*what))
    assert rows(Match.nodes(own, "x", "X").trails("z", where=F.array_contains("z_labels", "Y"), **how).frame.select(*what)) == rows(plain.frame.select(*what))


def test_no_hop_leaves_a_hub_for_nodes_too_far_from_the_end(spark, monkeypatch):
    """Suppliers to regions: the hop out of a nation takes the region only, not the nation's customers."""
    written = {}
    real = match.stash
    monkeypatch.setattr(match, "stash", lambda df, name: written.setdefault(f"{name}{len(written)}", real(df, name)))
    g = from_tables(spark, SF)
    found = Match.nodes(g, "a", "Supplier").trails("z", "Region", least=1, most=4, types=("IN_REGION", "IN_NATION"))
    assert found.frame.count() > 0
    found = Match.nodes(g, "a", "Supplier").trails("z", "Region", least=1, most=3, types=("IN_REGION", "IN_NATION"))
    assert found.frame.count() == 10 and [k.rstrip("0123456789") for k in written].count("fronts") == 3
    hops = []
    real_hop = match._hop
    monkeypatch.setattr(match, "_hop", lambda now, step, back=False: hops.append(real_hop(now, step, back)) or hops[-1])
    Match.nodes(g, "a", "Supplier").trails("z", "Region", least=1, most=3, types=("IN_REGION", "IN_NATION"))
    back, first, second = hops
    assert back.count() == 25 and first.count() == 10
    ends = {r[0].partition(":")[0] for r in second.select("_end").collect()}
    assert ends and "c" not in ends and "s" not in ends


@pytest.mark.parametrize(("width", "levels"), [(None, 8), (0.5, 8), (3.0, 1), (100.0, 0), (1e-3, 3)])
def test_range_join_gives_each_pair_once(spark, width, levels):
    rng = random.Random(4)
    some = lambda n: [(k, a := rng.choice([rng.uniform(-50, 50), rng.randint(-5, 5)]), a + rng.choice([0, 0, rng.expovariate(1), rng.expovariate(0.02), -1])) for k in range(n)]
    odd = [(900, None, 1.0), (901, 1.0, None), (902, math.nan, 1.0), (903, -math.inf, math.inf), (904, 2.0, 2.0), (904, 2.0, 2.0), (905, 1e15, 1e18), (906, -1e300, -5.0)]
    left, right = some(120) + odd, some(90) + odd
    a = spark.createDataFrame([(k, float(x) if x is not None else None, float(y) if y is not None else None) for k, x, y in left], "i int, a double, b double").repartition(3)
    b = spark.createDataFrame([(k, float(x) if x is not None else None, float(y) if y is not None else None) for k, x, y in right], "j int, c double, d double")
    ok = lambda x, y: x is not None and y is not None and x <= y
    want = sorted((k, m) for k, x, y in left if ok(x, y) for m, u, v in right if ok(u, v) and x <= v and u <= y)
    got = ranges.overlapping(a, b, ("a", "b"), ("c", "d"), width, levels)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    few = ranges.overlapping(a, b, ("a", "b"), ("c", "d"), width, levels, condition=F.col("i") < F.col("j"))
    assert sorted((r.i, r.j) for r in few.collect()) == [x for x in want if x[0] < x[1]]


def test_range_join_of_nothing_and_of_clashing_names(spark):
    a = spark.createDataFrame([(1, 2.0)], "i int, a double")
    b = a.select(F.col("i").alias("j"), F.col("a").alias("c"))
    assert ranges.overlapping(a, b.limit(0), ("a", "a"), ("c", "c")).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        ranges.overlapping(a, a, ("a", "a"), ("a", "a"))


def test_a_hub_is_dealt_and_its_last_hop_is_not_written(spark, monkeypatch):
    """Trails over a hub are as many as the square of its relationships: they must not be written, nor come from one task."""
    written = {}
    monkeypatch.setattr(match, "stash", lambda df, name, real=match.stash: written.setdefault(f"{name}{len(written)}", real(df, name)))
    monkeypatch.setattr(hubs, "ROWS", 8)
    monkeypatch.setattr(hubs.meet, "__defaults__", (None, 8))
    own = graph(spark, {"n": "N", **{f"x{k}": "X" for k in range(60)}}, [(f"r{k}", "P", f"x{k}", "n") for k in range(60)])
    m = Match.nodes(own, "a", "X").trails("z", least=1, most=2, names=F.lower)
    got = rows(m.frame.select("a_id", "z_id", F.array_join("path_ids", ","), F.array_join("path_nodes", ",")))
    want = [(f"x{a}", "n", f"r{a}", f"nx{a},nn") for a in range(60)] + [(f"x{a}", f"x{b}", f"r{a},r{b}", f"nx{a},nn,nx{b}") for a in range(60) for b in range(60) if a != b]
    assert got == sorted(want, key=repr)
    assert sum(df.count() for df in written.values()) == 60
    assert m.frame.filter("length = 2").groupBy(F.spark_partition_id()).count().count() > 1


def test_no_hop_goes_where_only_its_own_relationship_leads_back(spark, monkeypatch):
    """From suppliers to nations: a customer is next to a nation, but by the relationship that led to it."""
    g, hops = from_tables(spark, SF), []
    real_hop = match._hop
    monkeypatch.setattr(match, "_hop", lambda now, step, back=False: hops.append(real_hop(now, step, back)) or hops[-1])
    found = Match.nodes(g, "a", "Supplier").trails("z", least=1, most=3, types=("IN_REGION", "IN_NATION"), where=F.array_contains("z_labels", "Nation"))
    assert found.frame.groupBy("length").count().orderBy("length").collect()
    assert {r[0][0] for r in hops[-1].select("_end").collect()} == {"r"}


@pytest.mark.parametrize("rows_of_a_salt", [1024, 3])
def test_range_join_looks_only_where_something_lives(spark, monkeypatch, rows_of_a_salt):
    """All rows are in the coarsest bins: where nothing lives there, they must not meet there, as that is the square of them."""
    monkeypatch.setattr(hubs.meet, "__defaults__", (None, rows_of_a_salt))
    binned, real = [], ranges._bins
    monkeypatch.setattr(ranges, "_bins", lambda *args: binned.append(real(*args)) or binned[-1])
    a = spark.range(400).select(F.col("id").alias("i"), F.col("id").cast("double").alias("a"))
    b = spark.range(400).select(F.col("id").alias("j"), (F.col("id") - 0.25).alias("c"), (F.col("id") + 0.25).alias("d"))
    assert ranges.overlapping(a, b, ("a", "a"), ("c", "d")).count() == 400
    assert sum(df.count() for df in binned) <= 3 * 400
    long = spark.createDataFrame([(400, 0.0, 1e9), (401, 7.0, 20.0)], "j long, c double, d double")
    assert ranges.overlapping(a, b.union(long), ("a", "a"), ("c", "d")).count() == 400 + 400 + 14
    assert ranges.overlapping(b.union(long), a, ("c", "d"), ("a", "a")).count() == 400 + 400 + 14


def test_starts_around_one_hub_are_walked_once(spark, monkeypatch):
    """Leaves that reach each other by their hub are as many pairs as the square of them: no frontier may hold these."""
    written = {}
    monkeypatch.setattr(shortest, "stash", lambda df, name, real=shortest.stash: written.setdefault(f"{name}{len(written)}", real(df, name)))
    names = {"n": "N", "m": "N", **{f"x{k}": "X" for k in range(50)}, **{f"y{k}": "Y" for k in range(50)}}
    rels = [(f"r{v}", "P", v, "n") for v in names if v not in "nm"] + [("m1", "P", "n", "m"), ("m2", "P", "m", "n"), ("o", "P", "x0", "m"), ("p", "P", "x1", "n")]
    own = graph(spark, names, rels)
    m = Match.nodes(own, "a", "X").nearest("z", most=3, where=F.array_contains("z_labels", "X"))
    got = rows(m.frame.select("a_id", "z_id", "length", F.col("n_paths").cast("long")))
    want = [(f"x{k}", *r[1:]) for k in range(50) for r in breadth_first(rels, f"x{k}", False, most=3) if r[1][0] == "x"]
    assert got == sorted(want, key=repr) and len(got) == 50 * 49
    assert sum(df.count() for name, df in written.items() if name.startswith("frontier")) < 500
    assert rows(reached(own, own.nodes.select("id"), most=0)) == []


@pytest.mark.parametrize("most", [4096, 7])
def test_lists_of_some_columns_are_made_with_one_exchange(spark, g, tmp_path, monkeypatch, most):
    plans, real = [], adjacency._bucketed
    monkeypatch.setattr(adjacency, "_bucketed", lambda df, *args: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *args))
    own = adjacency.write(g, f"file://{tmp_path}/{most}", f"some_{most}", buckets=3, most=most, kept=("confidence",), of_nodes=("id", "labels"))
    take = lambda graph: Match.nodes(graph, "x", "X").both("r", "y", "Y").frame
    columns = ("x_id", "r_type", "r_start", "r_end", "r_confidence", "y_id", "y_labels")
    assert rows(take(own).select(*columns)) == rows(take(g).select(*columns))
    assert not {"r_id", "r_evidence", "r_properties", "y_name"} & set(take(own).columns)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1]
