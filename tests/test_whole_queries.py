"""Queries from every supplier and customer, against walks over the order tables in Python."""

import collections

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def got(spark, name):
    return collections.Counter(map(tuple, __spark_entry__.queries()[name](spark, SF).collect()))


def trails(tables):
    """(first, names, ids, types, last) of all trails of 1 to 3 relationships from suppliers."""
    names = {f"{k}:{i}": n for k, t, own in (("r", "region", "r_regionkey"), ("n", "nation", "n_nationkey"), ("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey")) for i, n in tables(t, own, f"{t[0]}_name")}
    rels = [(f"nr:{a}", "IN_REGION", f"n:{a}", f"r:{b}") for a, b in tables("nation", "n_nationkey", "n_regionkey")]
    rels += [(f"cn:{a}", "IN_NATION", f"c:{a}", f"n:{b}") for a, b in tables("customer", "c_custkey", "c_nationkey")]
    rels += [(f"sn:{a}", "IN_NATION", f"s:{a}", f"n:{b}") for a, b in tables("supplier", "s_suppkey", "s_nationkey")]
    steps = collections.defaultdict(list)
    for i, t, a, b in rels:
        steps[a].append((i, t, b))
        steps[b].append((i, t, a))
    now, out = [(x, [names[x]], [], [], x) for x in names if x[0] == "s"], []
    for _ in range(3):
        now = [(x, [*n, names[b]], [*ids, i], [*types, t], b) for x, n, ids, types, last in now for i, t, b in steps[last] if i not in ids]
        out += now
    return out


def test_trails_from_every_supplier(spark, tables):
    found = trails(tables)
    assert {x[0] for x in found} == {f"s:{i}" for (i,) in tables("supplier", "s_suppkey")}
    want = collections.Counter((x, ">".join(n), ">".join(t), len(ids)) for x, n, ids, t, last in found if last[0] == "r")
    assert got(spark, "e2_paths_1_3_all") == want
    want = collections.Counter((x, ",".join(ids), ",".join(n).upper()) for x, n, ids, _, _ in found if len(ids) < 3)
    assert got(spark, "list_comprehension_all") == want


def test_parts_of_every_customer(spark, tables):
    customer = {o: k for o, k in tables("orders", "o_orderkey", "o_custkey")}
    known, parts = {k for (k,) in tables("customer", "c_custkey")}, {k for (k,) in tables("part", "p_partkey")}
    want = {(f"c:{customer[o]}", f"p:{p}") for o, p in tables("lineitem", "l_orderkey", "l_partkey") if customer.get(o) in known and p in parts}
    assert got(spark, "distinct_neighbors_all") == collections.Counter(want)
