"""Typed open properties, and graphs as one document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators.match import Match, prop
from tarnweave.sources import document
from tarnweave.sources import graph as sources
from tarnweave.sources.graph import NODE, REL, Graph

OPEN = {
    "a": {"n": 7, "x": 2.5, "ok": True, "tags": ["p", "q"], "deep": {"k": [1, {"z": None}]}, "s": 'quote " and \\ and } and {'},
    "b": {"n": "seven", "ok": False, "none": None}, "c": {}, "d": {"big": 12345678901234, "neg": -0.125, "ünï": "漢字\n\t"},
}


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(k, ["X", "Y"] if k == "a" else ["X"], f"N{k}" if k != "c" else None, 4 if k == "a" else None, json.dumps(v)) for k, v in OPEN.items()], "id string, labels array<string>, name string, leiden_community long, p string")
    rels = spark.createDataFrame([("1", "T", "a", "b", "e", "f", None, 0.5, "r", '{"w": 1}'), ("2", "T", "b", "b", None, "f", "c", None, None, '{"w": [1.5]}')], "id string, type string, start string, end string, evidence string, source_file string, chunk_id string, confidence double, run_id string, p string")
    return Graph(nodes.withColumn("properties", F.parse_json("p")).select(*NODE), rels.withColumn("properties", F.parse_json("p")).select(*REL))


def plain(df):
    out = []
    for r in df.withColumn("properties", F.to_json("properties")).collect():
        own = {k: v for k, v in json.loads(r.properties).items() if v is not None}
        out.append({**r.asDict(), "properties": own})
    return sorted(out, key=lambda r: r["id"])


def same(a, b):
    return plain(a.nodes) == plain(b.nodes) and plain(a.rels) == plain(b.rels)


def test_values_keep_their_types_in_every_round_trip(g, spark, tmp_path):
    path = f"file://{tmp_path}"
    g.dump(f"{path}/lines")
    g.write(f"{path}/parquet")
    document.save_document(g, f"{path}/one.json")
    for got in (sources.load_dump(spark, f"{path}/lines"), sources.read(spark, f"{path}/parquet"), document.load_document(spark, f"{path}/one.json")):
        assert same(got, g)
        assert got.nodes.filter("id = 'a'").select(*[F.try_variant_get("properties", f"$.{k}", kind) for k, kind in (("n", "int"), ("x", "double"), ("ok", "boolean"), ("tags", "array<string>"))]).first() == (7, 2.5, True, ["p", "q"])
    whole = json.loads((tmp_path / "one.json").read_text())
    assert {n["id"]: {k: v for k, v in n["properties"].items() if k not in ("name", "leiden_community")} for n in whole["nodes"]} == {k: {x: y for x, y in v.items() if y is not None} for k, v in OPEN.items()}
    assert whole["relationships"][0]["properties"] == {"evidence": "e", "source_file": "f", "confidence": 0.5, "run_id": "r", "w": 1}


def test_types_in_the_catalogue(g):
    got = {(r.kind, r.key, r.type): r.n for r in g.property_types().collect()}
    assert got["X", "n", "INTEGER"] == 1 and got["X", "n", "STRING"] == 1 and got["Y", "tags", "LIST"] == 1 and got["X", "deep", "MAP"] == 1
    assert got["X", "ok", "BOOLEAN"] == 2 and got["X", "x", "FLOAT"] == 1 and got["X", "big", "INTEGER"] == 1 and got["X", "name", "STRING"] == 3
    assert got["T", "w", "INTEGER"] == got["T", "w", "LIST"] == 1 and got["T", "confidence", "FLOAT"] == 1 and not any(k == "none" for _, k, _ in got)
    assert {(r.kind, r.key): r.n for r in g.property_keys().collect()}["X", "n"] == 2
    assert "tags: ARRAY<STRING>" in {r.kind: r.schema for r in g.property_schemas().collect()}["Y"]


def test_access_by_type(g):
    got = Match.nodes(g, "a", "X", where=prop("a", "n", "int") > 6).returns("a_id", prop("a", "ünï").alias("u"), prop("a", "n").alias("n"), limit=5)
    assert [tuple(r) for r in got.collect()] == [("a", None, "7")]
    assert g.nodes.select(F.col("properties").alias("x_properties")).filter(prop("x", "ünï") == "漢字\n\t").count() == 1


def test_a_column_stands_before_an_open_property_of_its_name(spark):
    nodes = spark.createDataFrame([("a", ["X"], "column", None, '{"name": "open", "leiden_community": 3, "k": 1}')], "id string, labels array<string>, name string, leiden_community long, p string")
    own = nodes.withColumn("properties", F.parse_json("p")).select(F.to_json(sources.all_properties(sources.NODE_OWN)))
    assert json.loads(own.first()[0]) == {"name": "column", "k": 1}


def big(n, seed=0):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice('ab "\\{}[]:,é\n') for _ in range(rng.randrange(60)))
    nodes = [{"id": f"n{k}", "labels": ["A"] * (k % 3), "properties": {text() + str(j): rng.choice([text(), k, k / 4, True, [text(), {"x": text()}]]) for j in range(3)}} for k in range(n)]
    rels = [{"id": f"r{k}", "type": "T", "properties": {"w": text()}, "start": f"n{k}", "end": f"n{k + 1}"} for k in range(n)]
    return nodes, rels


@pytest.mark.parametrize("how", [{"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
@pytest.mark.parametrize("first", ["nodes", "relationships"])
def test_any_cut_of_a_document_gives_its_elements(spark, tmp_path, how, first):
    nodes, rels = big(90)
    nodes[70]["properties"]["long"] = '}"{' * 4000  # across several ranges
    whole = {"version": {"nodes": [1]}, "other": [{"id": "no"}], "nodes": nodes, "relationships": rels, "end": "]}"}
    whole = dict(sorted(whole.items(), key=lambda x: x[0] != first))
    (tmp_path / "d.json").write_text(json.dumps(whole, **how) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("2500b", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = document.elements(spark, f"file://{tmp_path}/d.json").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        for section, rows in (("nodes", nodes), ("relationships", rels)):
            assert sorted((json.loads(r.text) for r in got if r.section == section), key=lambda x: x["id"]) == sorted(rows, key=lambda x: x["id"])


def test_a_large_document_is_read_by_several_tasks(spark, tmp_path):
    one = json.dumps({"id": "@", "labels": ["A"], "properties": {"t": "some text } \\\" { " * 400}})
    with open(tmp_path / "large.json", "w") as f:
        f.write('{"relationships": [],\n"nodes": [')
        for k in range(28_000):
            f.write((",\n" if k else "") + one.replace("@", str(k)))
        f.write("]}")
    assert (tmp_path / "large.json").stat().st_size > 200 << 20
    path = f"file://{tmp_path}/large.json"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    try:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 6
        got = document.load_document(spark, path)
        assert got.nodes.select("id").distinct().count() == 28_000 and got.rels.count() == 0
        assert got.nodes.filter(F.length(F.try_variant_get("properties", "$.t", "string")) == 17 * 400).count() == 28_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_a_failed_write_leaves_what_was_there(g, spark, tmp_path):
    broken = Graph(g.nodes.withColumn("name", F.raise_error(F.lit("no"))), g.rels)
    with pytest.raises(Exception, match="no"):
        document.save_document(broken, f"file://{tmp_path}/x.json")
    assert list(tmp_path.iterdir()) == []
    document.save_document(g, f"file://{tmp_path}/x.json")
    kept = (tmp_path / "x.json").read_text()
    with pytest.raises(Exception, match="no"):
        document.save_document(broken, f"file://{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == kept
    document.save_document(Graph(g.nodes.limit(0), g.rels.limit(0)), f"file://{tmp_path}/x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"nodes": [], "relationships": []}
    empty = document.load_document(spark, f"file://{tmp_path}/x.json")
    assert empty.nodes.count() == empty.rels.count() == 0
