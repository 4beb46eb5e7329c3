"""What questions, jobs and streams took and gave: spans, a table of them, and the report of a run of cases.

Rows are counted by the job that makes them (DataFrame.observe), not by another one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import astuple, dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

T = TypeVar("T")

#: The parts of a report (fixed values of the interchange format).
QUESTION, ACTUAL, EXPECTED, TOOK, UNIT = "ВОПРОС", "ОТВЕТ ТЕКУЩИЙ", "ПРАВИЛЬНЫЙ ОТВЕТ", "ВРЕМЯ ОТВЕТА", "сек"
NO_ANSWER, FAILED = "ОТВЕТ НЕ ПОЛУЧЕН (пусто)", "ОШИБКА ПРИ ВЫПОЛНЕНИИ ЗАПРОСА:"
RULE = "-" * 40


@dataclass
class Span:
    """What one step took and gave. rows is null where the step ended before it had any."""

    name: str
    seconds: float
    status: str
    note: str = ""
    rows: int | None = None
    question: str = ""


def span_table(spark: SparkSession, spans: Iterable[Span]) -> DataFrame:
    return spark.createDataFrame([astuple(s) for s in spans], "name string, seconds double, status string, note string, rows bigint, question string")


def export(spark: SparkSession, spans: list[Span], path: str | None) -> None:
    """Appends the spans to the Parquet table at path and forgets them; without a path, they stay."""
    if path and spans:
        sent = list(spans)
        span_table(spark, sent).coalesce(1).write.mode("append").parquet(path)
        del spans[: len(sent)]


def measured(df: DataFrame, action: Callable[[DataFrame], T], spans: list[Span], name: str, question: str = "") -> T:
    """action(df), and a span with the rows that passed. A failing action leaves a span too, and raises."""
    seen, began = Observation(), time.monotonic()
    try:
        out = action(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    except Exception as e:
        spans.append(Span(name, time.monotonic() - began, "failed", str(e)[:200], None, question))
        raise
    took, rows = time.monotonic() - began, int(seen.get.get("rows", 0))
    spans.append(Span(name, took, "rows" if rows else "empty", "", rows, question))
    return out


class StreamSpans(StreamingQueryListener):
    """A span for each batch of the session's streams and one for the end of each; add it with spark.streams.addListener()."""

    def __init__(self, spans: list[Span]):
        self.spans, self._began = spans, {}

    def onQueryStarted(self, event) -> None:
        self._began[str(event.runId)] = (event.name or str(event.id), time.monotonic())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {k: r.asDict() for k, r in p.observedMetrics.items()}
        note = f"batch {p.batchId}" + "".join(f", {k}: {v}" for k, v in sorted(metrics.items()))
        self.spans.append(Span(p.name or str(p.id), p.batchDuration / 1000, "rows" if p.numInputRows else "empty", note, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name, began = self._began.pop(str(event.runId), (str(event.id), time.monotonic()))
        self.spans.append(Span(name, time.monotonic() - began, "failed" if event.exception else "ended", (event.exception or "")[:200]))


def rendered(number: Column, question: Column, actual: Column, expected: Column, seconds: Column) -> Column:
    """One case of a report. An answer that is missing or empty is said to be; other nulls are empty."""
    answer = F.when(F.coalesce(actual, F.lit("")) == "", NO_ANSWER).otherwise(actual)
    parts = ((QUESTION + " %s:", F.coalesce(question, F.lit(""))), (ACTUAL + ":", answer), (EXPECTED + ":", F.coalesce(expected, F.lit(""))))
    text = "\n\n".join(f"{head}\n%s" for head, _ in parts) + f"\n\n{TOOK}:\n%.2f {UNIT}\n\n{RULE}\n"
    return F.format_string(text, number.cast("string"), *[value for _, value in parts], F.coalesce(seconds, F.lit(0.0)).cast("double"))


def run_cases(cases: DataFrame, ask: Callable[[str], list[str]], path: str, spans: list[Span] | None = None) -> None:
    """Asks the question of each case (case_id, question, expected) by case_id and writes the report as text. What a question raises
    stands in its place; when the run itself is broken off, the report of the cases so far is written all the same."""
    done, spark = [], cases.sparkSession
    try:
        for case in cases.select("case_id", "question", "expected").orderBy("case_id").toLocalIterator():
            began, status = time.monotonic(), "rows"
            try:
                answer = "\n".join(ask(case.question))
            except Exception as e:
                answer, status = f"{FAILED} {type(e).__name__}: {e}", "failed"
            took = time.monotonic() - began
            done.append((len(done) + 1, case.question, answer, case.expected, took))
            if spans is not None:
                spans.append(Span("case", took, status if answer else "empty", answer[:200] if status == "failed" else "", None, case.question))
    finally:
        table = spark.createDataFrame(done, "number int, question string, actual string, expected string, seconds double")
        one = table.coalesce(1).sortWithinPartitions("number")
        one.select(rendered(*[F.col(k) for k in table.columns])).write.mode("overwrite").text(path)
