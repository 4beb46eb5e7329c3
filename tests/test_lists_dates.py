"""Functions of lists and of dates, nulls and ends of months included; a relationship's own ends."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import dates, lists
from tarnweave.operators.match import Match
from tarnweave.sources.adjacency import adjacent
from tarnweave.sources.graph import from_tables

CASES = [([1, 2, 3], False, True, False, False), ([5], True, True, False, True), ([], True, False, True, False), ([1], False, False, True, False), ([3, None], None, True, False, None), ([3, 4, None], None, True, False, False), ([1, None], False, None, None, None), (None, None, None, None, None)]


def test_predicates(spark):
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(CASES)], "k int, x array<int>")
    big = lambda v: v > 1
    x = F.col("x")
    got = df.select("k", lists.every(x, big), lists.some(x, big), lists.none(x, big), lists.single(x, big)).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CASES]


def test_spans(spark):
    cases = [(1, 4, [1, 2, 3, 4]), (4, 1, []), (2, 2, [2]), (None, 2, None), (2, None, None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a int, b int")
    got = df.select("k", lists.span(F.col("a"), F.col("b")).alias("up"), lists.span(F.col("b"), F.col("a"), -1).alias("down")).orderBy("k").collect()
    assert [r.up for r in got] == [x[2] for x in cases]
    assert [r.down for r in got] == [None if x[2] is None else x[2][::-1] for x in cases]
    with pytest.raises(ValueError):
        lists.span(F.lit(1), F.lit(2), 0)


def test_durations_lead_from_one_date_to_the_other(spark):
    begin = datetime.date(2019, 11, 27)
    days = [begin + datetime.timedelta(k) for k in (0, 1, 2, 3, 4, 33, 63, 64, 93, 94, 95, 124, 460, 461, 462)]
    rows = [(a, b) for a in days for b in days] + [(None, days[0]), (days[0], None)]
    took = dates.between(F.col("a"), F.col("b"))
    df = spark.createDataFrame(rows, "a date, b date").withColumn("d", took)
    got = df.withColumn("again", dates.plus(F.least("a", "b"), F.abs("d.months"), F.abs("d.days"))).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.d is None
            continue
        assert r.again == max(r.a, r.b)
        assert r.d.months >= 0 and r.d.days >= 0 if r.a <= r.b else r.d.months <= 0 and r.d.days <= 0
        assert abs(r.d.days) <= 31
    known = {(r.a, r.b): tuple(r.d) for r in got if r.d}
    assert known[datetime.date(2019, 11, 30), datetime.date(2020, 2, 29)] == (3, 0)
    assert known[datetime.date(2020, 2, 29), datetime.date(2019, 11, 30)] == (-3, 0)


def test_own_ends_are_those_of_the_relationship(spark):
    g = from_tables(spark, "/root/testdata/sf0.001")
    own = {r.id: (r.start, r.end) for r in g.rels.filter("type = 'IN_REGION'").collect()}
    rows = Match.nodes(g, "a").both("r", "b", types=["IN_REGION"], ends=True).frame.collect()
    assert len(rows) == 2 * len(own)
    for r in rows:
        assert (r.r_own_start, r.r_own_end) == own[r.r_id] and {r.a_id, r.b_id} == set(own[r.r_id])
    with pytest.raises(ValueError):
        Match.nodes(adjacent(g), "a").both("r", "b", ends=True)
