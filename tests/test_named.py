"""Named questions from SQL, and calls that are dispatched."""

import json

import pytest
from pyspark.sql import functions as F

from tarnweave.operators.match import Match
from tarnweave.plans import named
from tarnweave.plans.named import Question, Registry
from tarnweave.sources.graph import NODE, REL, Graph


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([("a", "Alpha"), ("b", "O'Hara"), ("c", None)], "id string, name string").selectExpr("id", "array('X') AS labels", "name", "4L AS leiden_community", "parse_json('{}') AS properties")
    rels = spark.createDataFrame([("1", "P", "a", "b", 0.9), ("2", "Q", "b", "a", 0.5), ("3", "P", "c", "a", None)], "id string, type string, start string, end string, confidence double")
    rels = rels.selectExpr("*", "'said' AS evidence", "'f' AS source_file", "'1' AS chunk_id", "'r' AS run_id", "parse_json('{}') AS properties")
    return Graph(nodes.select(*NODE), rels.select(*REL))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_calls_from_sql_have_the_plan_of_the_pattern(g, spark):
    Registry(g)
    called = spark.sql("SELECT source, relation, target FROM connected_to('Alpha')")
    plain = Match.nodes(g, "a", where=F.col("a_name") == "Alpha").both("r", "b").returns(F.col("a_name").alias("source"), F.col("r_type").alias("relation"), F.col("b_name").alias("target"))
    assert rows(called, "*") == rows(plain, "*") == [("Alpha", "P", "O'Hara"), ("Alpha", "P", None), ("Alpha", "Q", "O'Hara")]
    shape = lambda df: [line.lstrip(" :+-").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if line.strip()]
    assert sorted(x for x in shape(called) if x in ("Join", "Generate")) == sorted(x for x in shape(plain) if x in ("Join", "Generate"))
    assert "outer" not in called._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("who", ["x' OR '1' = '1", "Alpha'; DROP VIEW connected_to_rows; --", ":who", "", "\\"])
def test_a_hostile_argument_is_only_a_value(g, who):
    own = Registry(g)
    assert own.ask("connected_to", who=who).count() == 0
    assert own.ask("connected_to", who="O'Hara").count() == 2


def test_questions_of_ones_own_and_the_list(g):
    own = Registry(g, [Question("old", "gone", lambda g: g.nodes.select("id"), "id = x", {"x": "string"})])
    own.register(Question("old", "Nodes of a community.", lambda g: g.nodes.select("id", "leiden_community"), "leiden_community = c", {"c": "bigint"}))
    assert rows(own.ask("old", c=4), "id") == [("a",), ("b",), ("c",)]
    listed = own.listed().collect()
    assert [(r.name, json.loads(r.parameters)) for r in listed] == [("old", {"type": "object", "properties": {"c": {"type": "integer"}}, "required": ["c"]})]
    for name, kind in (("a b", "string"), ("x", "string; DROP"), ("x)", "int")):
        with pytest.raises(ValueError, match="not a"):
            Question("q", "", lambda g: g.nodes, "true", {name: kind})
    with pytest.raises(ValueError, match="columns"):
        own.register(Question("q", "", lambda g: g.nodes, "true", {"name": "string"}))
    for call in (lambda: own.ask("none"), lambda: own.ask("old"), lambda: own.ask("old", c=1, d=2)):
        with pytest.raises(ValueError, match="unknown|takes"):
            call()


def test_dispatch(g, spark):
    calls = [(1, "connected_to", {"who": "Alpha"}), (2, "nothing", {}), (3, None, None), (4, "statements_of", {"node": "a", "least": "0.8"}), (5, "statements_of", {"node": "a"}), (6, "statements_of", {"node": "a", "least": "high"}), (7, "connected_to", {"who": "nobody"}), (8, "connected_to", None), (1, "connected_to", {"who": "Alpha"})]
    got = Registry(g).dispatch(spark.createDataFrame(calls, "call_id int, name string, arguments map<string,string>")).collect()
    errors = {r.call_id: r.error for r in got if r.error}
    assert errors == {2: "unknown question: nothing", 3: "unknown question: ", 5: "missing: least", 6: "missing: least", 8: "missing: who"}
    found = sorted((r.call_id, json.loads(r.row)["target_id"]) for r in got if r.row)
    assert found == [(1, "b")] * 4 + [(1, "c")] * 2 + [(4, "b")]
    assert all("confidence" in json.loads(r.row) for r in got if r.row)


def test_many_calls_begin_at_the_nodes_that_they_name(g, spark, monkeypatch):
    """Before, each question's pattern was made of the whole graph, and the calls picked its rows."""
    written, real = [], named.stash
    monkeypatch.setattr(named, "stash", lambda df, name: written.append(real(df, name)) or written[-1])
    calls = [(k, "connected_to", {"who": w}) for k, w in enumerate(["Alpha", "nobody", "Alpha"])] + [(9, "statements_of", {"node": "a", "least": "0.8"})]
    got = Registry(g).dispatch(spark.createDataFrame(calls, "call_id int, name string, arguments map<string,string>"))
    assert sorted((r.call_id, json.loads(r.row)["target_id"]) for r in got.collect()) == [(0, "b"), (0, "b"), (0, "c"), (2, "b"), (2, "b"), (2, "c"), (9, "b")]
    assert [rows(x, "id") for x in written] == [[("a",)], [("a",)]]
    whole = Question("all_of", "", lambda g: Match.nodes(g, "a").out("r", "b").returns("a_id", "b_id"), "a_id = x", {"x": "string"})
    got = Registry(g, [whole]).dispatch(spark.createDataFrame([(1, "all_of", {"x": "a"})], "call_id int, name string, arguments map<string,string>"))
    assert [json.loads(r.row) for r in got.collect()] == [{"a_id": "a", "b_id": "b"}]
