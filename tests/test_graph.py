"""Patterns on a small graph: a loop, parallel relationships, a cycle, a node without relationships, null properties."""

import pytest
from pyspark.sql import functions as F

from tarnweave.operators.match import Match, degrees, low_confidence, matches, name_like
from tarnweave.plans.ask import NOT_FOUND, Engine, by_name, regression
from tarnweave.sources import graph as sources
from tarnweave.sources.graph import Graph

NODES = [("a", ["X"], "Alpha"), ("b", ["X", "Y"], "beta\nline"), ("c", ["Y"], None), ("d", [], "Дельта"), ("e", ["X"], "lonely")]
RELS = [("1", "P", "a", "b", "said", 0.7), ("2", "P", "b", "c", "", None), ("3", "Q", "c", "a", None, 0.8), ("4", "Q", "a", "a", "loop", 0.9)]


@pytest.fixture(scope="module")
def g(spark):
    empty = sources.open_object(F.create_map().cast("map<string,string>"))
    nodes = spark.createDataFrame(NODES, "id string, labels array<string>, name string").withColumns({"leiden_community": F.lit(4).cast("bigint"), "properties": empty})
    rels = spark.createDataFrame(RELS, "id string, type string, start string, end string, evidence string, confidence double")
    rels = rels.withColumns({"source_file": F.lit("f.pdf"), "chunk_id": F.lit("c_1"), "run_id": F.lit(None).cast("string"), "properties": sources.open_object(F.create_map(F.lit("k"), F.col("id")))})
    return Graph(nodes, rels)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_undirected_counts_loops_once(g):
    assert g.undirected().count() == 7


@pytest.mark.parametrize(("length", "n"), [(1, 7), (2, 10), (3, 12)])
def test_trails_use_no_relationship_twice(g, length, n):
    found = Match.nodes(g, "x").trails("z", least=length, most=length)
    assert found.frame.count() == n
    assert all(len(set(r.path_ids)) == length and len(r.path_nodes) == length + 1 for r in found.frame.collect())


def test_trails_from_zero_and_too_long(g):
    assert Match.nodes(g, "x").trails("z", least=0, most=1).frame.count() == 5 + 7
    with pytest.raises(ValueError, match="up to"):
        Match.nodes(g, "x").trails("z", most=9)


def test_optional_keeps_nodes_without_outgoing(g):
    got = Match.nodes(g, "x").optional_out("r", "y").returns("x_id", "r_id")
    assert rows(got) == sorted([("a", "1"), ("a", "4"), ("b", "2"), ("c", "3"), ("d", None), ("e", None)], key=repr)


def test_optional_condition_belongs_to_the_pattern(g):
    got = Match.nodes(g, "x").optional_out("r", "y", where=F.col("r_confidence") > 0.75).returns("x_id", "r_id")
    assert rows(got) == sorted([("a", "4"), ("b", None), ("c", "3"), ("d", None), ("e", None)], key=repr)


def test_labels_and_types(g):
    assert rows(Match.nodes(g, "x", "X", "Y").returns("x_id")) == [("b",)]
    assert rows(Match.nodes(g, "x").into("r", "y", types=["P"]).returns("x_id", "y_id")) == [("b", "a"), ("c", "b")]


def test_names_match_as_a_whole(g, spark):
    assert rows(Match.nodes(g, "x", where=name_like("x", "(?i).*LINE")).returns("x_id")) == [("b",)]
    assert rows(Match.nodes(g, "x", where=name_like("x", "(?i)дель.*")).returns("x_id")) == [("d",)]
    assert spark.range(1).select(matches(F.lit("abc\n"), "abc"), matches(F.lit(None).cast("string"), "a")).first() == (False, None)


def test_exists_missing_degrees(g):
    assert rows(Match.nodes(g, "x").missing().returns("x_id")) == [("d",), ("e",)]
    assert rows(Match.nodes(g, "x").exists(["Q"], undirected=False).returns("x_id")) == [("a",), ("c",)]
    assert rows(degrees(g)) == sorted([("a", 2, 2, 3), ("b", 1, 1, 2), ("c", 1, 1, 2), ("d", 0, 0, 0), ("e", 0, 0, 0)])


def test_provenance_of_several_relationships(g):
    got = Match.nodes(g, "x", "X").out("r", "y", types=["P"]).out("q", "z").returns("x_id", "q_confidence", rel=("r", "q"))
    assert got.columns == ["x_id", "q_confidence", "r_evidence", "r_source_file", "r_chunk_id", "r_confidence", "q_evidence", "q_source_file", "q_chunk_id"]
    assert rows(got.select("x_id", "r_evidence", "q_confidence")) == [("a", "said", None), ("b", "", 0.8)]


def test_shortest_trails(g):
    got = Match.nodes(g, "x").trails("z", least=1, most=3, names=False).shortest("x")
    assert "path_nodes" not in got.frame.columns
    assert rows(got.returns("x_id", "z_id", "length")) == sorted([("a", "a", 1), ("a", "b", 1), ("a", "c", 1), ("b", "a", 1), ("c", "a", 1), ("b", "c", 1), ("c", "b", 1), *[("b", "b", 3)] * 2, *[("c", "c", 3)] * 2], key=repr)


def test_unknown_labels_and_types(g):
    g.require(("X", "Y"), ("P",))
    for labels, types in ((("Z",), ()), ((), ("P", "R"))):
        with pytest.raises(ValueError, match="unknown"):
            g.require(labels, types)


def test_joins_begin_at_the_bound_rows(g):
    """The relationships meet the start's rows before the far nodes, and both directions come from one scan."""
    frame = Match.nodes(g, "x", "X", where=F.col("x_name") == "Alpha").both("r", "y", "Y").frame
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert "r_end" in joins[0] and "r_start" in joins[1] and len(joins) == 2
    assert plan.count("Generate inline") == 1 and "Union" not in plan


def test_provenance_is_added(g):
    assert Match.nodes(g, "x").out("r", "y").returns("x_id", rel="r").columns == ["x_id", "evidence", "source_file", "chunk_id", "confidence"]
    assert rows(g.rels.select("id", low_confidence(F.col("confidence"), 0.75))) == [("1", True), ("2", False), ("3", False), ("4", False)]


def test_dump_and_parquet_round_trips(g, spark, tmp_path):
    for back in (lambda p: (g.dump(p), sources.load_dump(spark, p))[1], lambda p: (g.write(p), sources.read(spark, p))[1]):
        got = back(f"{tmp_path}/{id(back)}")
        for a, b in ((g.nodes, got.nodes), (g.rels, got.rels)):
            plain = [c for c in a.columns if c != "properties"]
            assert rows(a.select(*plain, F.to_json("properties"))) == rows(b.select(*plain, F.to_json("properties")))


def test_catalog(g):
    assert rows(g.labels()) == [("X", 3), ("Y", 2)]
    assert rows(g.property_keys()) == [("P", "k", 2), ("Q", "k", 2)]


class Scripted:
    def __init__(self, *outcomes):
        self.outcomes, self.feedback = list(outcomes), []

    def __call__(self, question, schema, history, feedback):
        self.feedback.append(feedback)
        outcome = self.outcomes.pop(0)
        if isinstance(outcome, Exception):
            raise outcome
        return outcome


def test_answers_retry_with_feedback(g, spark):
    full, none = spark.range(2), spark.range(0)
    for outcomes, answer, words in (
        ((full,), 2, []),
        ((none, full), 2, ["Take another way"]),
        ((none, none, full), 2, ["Take another way", "letter case"]),
        ((ValueError("bad plan"), full), 2, ["bad plan"]),
        ((none, none, none), NOT_FOUND, ["Take another way", "letter case"]),
        ((RuntimeError("gone"), full), "It can't be answered: gone", []),
    ):
        script = Scripted(*outcomes)
        engine = Engine(g, script)
        got = engine.ask("q?")
        assert (len(got) if isinstance(answer, int) else got[0]) == answer
        assert all(w in f for w, f in zip(words, script.feedback[1:]))
        assert len(engine.history) == int(isinstance(answer, int))


def test_answers_by_name_and_limits(g):
    engine = Engine(g, by_name(g))
    assert '"source":"Alpha"' in engine.ask('What is "alph" connected to?')[0]
    assert [s.status for s in engine.spans] == ["empty", "rows"]
    with pytest.raises(ValueError, match="empty"):
        engine.ask("  ")


def test_late_answers_are_cut(g):
    import time

    engine = Engine(g, lambda *x: time.sleep(3), seconds=0.2)
    assert "more than" in engine.ask("q")[0]


def test_regression_report(spark):
    cases = spark.createDataFrame([(1, "q", 'Yes. "quote" файл: a.pdf'), (2, "r", "No. файл: b.pdf")], "case_id int, question string, expected string")
    actual = spark.createDataFrame([(1, "Yes, see a.pdf", 0.1)], "case_id int, actual string, seconds double")
    assert rows(regression(cases, actual).select("case_id", "has_source")) == [(1, True), (2, False)]
