"""Spans of questions, jobs and streams; the report, written whatever happens."""

import glob

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import text
from tarnweave.plans import metrics
from tarnweave.plans.ask import NOT_FOUND, Engine
from tarnweave.sources.graph import from_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    return from_tables(spark, SF)


def test_questions_leave_spans(g, spark, tmp_path):
    def translate(question, schema, history, feedback):
        if question == "broken":
            raise RuntimeError("gone")
        return spark.range(3) if question == "three" else spark.range(0)

    engine = Engine(g, translate, attempts=2, exports=f"{tmp_path}/spans")
    assert len(engine.ask("three")) == 3 and engine.ask("none") == [NOT_FOUND] and "gone" in engine.ask("broken")[0]
    seen = [(r.name, r.question, r.status, r.rows) for r in engine.metrics().collect()]
    assert seen == [("attempt", "three", "rows", 3), ("attempt", "none", "empty", 0), ("attempt", "none", "empty", 0), ("attempt", "broken", "broken", None), ("question", "three", "rows", 3), ("question", "none", "empty", 0), ("question", "broken", "failed", 0)]
    assert all(s.seconds >= 0 for s in engine.spans)
    engine.export()
    engine.export()
    assert spark.read.parquet(f"{tmp_path}/spans").count() == 7 and not engine.spans and not engine.asked


def test_query_texts_are_checked_and_kept(g):
    texts = ["DELETE FROM x", "SELECT имя FROM {nodes}", "SELECT name FROM {nodes} WHERE name = 'Имя' OR name = 'AFRICA'"]
    engine = Engine(g, lambda q, s, h, f: texts[[x in f for x in ("writes", "Latin")].index(True) + 1 if f else 0])
    assert engine.ask("q") == ['{"name":"AFRICA"}']
    assert [s.status for s in engine.spans] == ["failed", "failed", "rows"]
    assert list(engine.history) == [("q", texts[2])]


@pytest.mark.parametrize(
    ("query", "reads"),
    [("SELECT 1", True), (" (select 'insert into' AS x)", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("INSERT INTO t SELECT 1", False), ("FROM t INSERT INTO u SELECT 1", False), ("SELECT reflect('java.lang.System', 'exit')", False), ("SHOW TABLES", False), ("", False)],
)
def test_texts_that_only_read(spark, query, reads):
    assert spark.range(1).select(text.selects(F.lit(query))).first()[0] is reads


def test_failing_job_leaves_a_span(spark):
    spans = []
    with pytest.raises(Exception, match="no"):
        metrics.measured(spark.range(3).select(F.raise_error(F.lit("no"))), lambda df: df.collect(), spans, "job")
    metrics.measured(spark.range(3), lambda df: df.collect(), spans, "job")
    assert [(s.status, s.rows) for s in spans] == [("failed", None), ("rows", 3)]


def test_streams_leave_spans(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in")
    spans = []
    listener = metrics.StreamSpans(spans)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("seen", F.max("id").alias("most"))
        q = stream.writeStream.format("memory").queryName("spanned").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert ("spanned", "rows", 5) in [(s.name, s.status, s.rows) for s in spans] and any("'most': 4" in s.note for s in spans)
    assert spans[-1].status == "ended"


def test_report_is_written_whatever_happens(spark, tmp_path):
    cases = spark.createDataFrame([(2, "b", "B"), (1, "a", "A"), (3, "c", None), (4, "stop", "D")], "case_id int, question string, expected string")

    def ask(question):
        if question == "stop":
            raise KeyboardInterrupt
        if question == "b":
            raise ValueError("no")
        return ["x", "y"] if question == "a" else []

    spans = []
    with pytest.raises(KeyboardInterrupt):
        metrics.run_cases(cases, ask, f"{tmp_path}/report", spans)
    (part,) = glob.glob(f"{tmp_path}/report/part-*")
    report = open(part, encoding="utf-8").read()
    one = "ВОПРОС {}:\n{}\n\nОТВЕТ ТЕКУЩИЙ:\n{}\n\nПРАВИЛЬНЫЙ ОТВЕТ:\n{}\n\nВРЕМЯ ОТВЕТА:\n0.00 сек\n\n" + "-" * 40 + "\n\n"
    assert report == one.format(1, "a", "x\ny", "A") + one.format(2, "b", metrics.FAILED + " ValueError: no", "B") + one.format(3, "c", metrics.NO_ANSWER, "")
    assert [s.status for s in spans] == ["rows", "failed", "empty"]
