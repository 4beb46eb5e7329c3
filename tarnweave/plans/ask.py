"""Questions to the graph: a translator makes a plan of a question, the runner runs it, with feedback and another try.

A translator is any callable `(question, schema, history, feedback)` that gives a frame, or the text of a query: that is run as
SQL if it only reads and has no letters but Latin ones outside of its quoted strings, and what is wrong with it goes back as feedback otherwise. The
translator given here knows a few forms of question; translation by a language model can be plugged in.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.text import json_row, latin_only, selects
from tarnweave.operators.match import LIMIT, Match, matches
from tarnweave.plans.metrics import Span, export, measured, span_table
from tarnweave.sources.graph import Graph

ATTEMPTS, SECONDS, HISTORY = 3, 300.0, 6
NOT_FOUND = "Nothing was found."
#: What comes before the source in an expected answer (fixed value of the interchange format).
SOURCE_WORD = "файл"
Translator = Callable[[str, str, list[tuple[str, str]], str], DataFrame | str]


def by_name(graph: Graph) -> Translator:
    """Finds what is connected to a named node. First the name as it is; after feedback, names that contain it."""

    def translate(question: str, schema: str, history: list[tuple[str, str]], feedback: str) -> DataFrame:
        quoted = re.search(r"[\"'«](.+?)[\"'»]", question)
        name = quoted[1] if quoted else (question.split() or [""])[-1].strip("?.!")
        column = F.col("n_name")
        same = column == name if not feedback else matches(column, f"(?i).*{re.escape(name)}.*")
        found = Match.nodes(graph, "n", where=same).both("r", "m")
        return found.returns(F.col("n_name").alias("source"), F.col("r_type").alias("relation"), F.col("m_name").alias("target"), rel="r", limit=LIMIT)

    return translate


@dataclass
class Engine:
    graph: Graph
    translate: Translator
    attempts: int = ATTEMPTS
    seconds: float = SECONDS
    limit: int = LIMIT
    history: deque = field(default_factory=lambda: deque(maxlen=HISTORY))
    spans: list[Span] = field(default_factory=list)
    asked: list[Span] = field(default_factory=list)
    exports: str | None = None

    def schema(self) -> str:
        """Labels and types with their counts, as text."""
        labels = ", ".join(f"{r[0]} ({r[1]})" for r in self.graph.labels().orderBy("label").collect())
        types = ", ".join(f"{r[0]} ({r[1]})" for r in self.graph.rel_types().orderBy("type").collect())
        return f"Nodes: {labels}\nRelationships: {types}"

    def metrics(self) -> DataFrame:
        """The spans of the attempts and of the questions, as far as they are not exported."""
        return span_table(self.graph.nodes.sparkSession, self.spans + self.asked)

    def export(self) -> None:
        """Appends the spans to the table that `exports` names, if it names any, and forgets them."""
        for spans in (self.spans, self.asked):
            export(self.graph.nodes.sparkSession, spans, self.exports)

    def frame(self, made: DataFrame | str) -> DataFrame:
        """The frame of what a translator made. Raises ValueError where a text may not run."""
        if isinstance(made, DataFrame):
            return made
        spark, text = self.graph.nodes.sparkSession, F.lit(made)
        reads, latin = spark.range(1).select(selects(text), latin_only(F.regexp_replace(text, "'[^']*'", "''"))).first()
        if not reads:
            raise ValueError("the query writes; it may only read")
        if not latin:
            raise ValueError("the query has letters that are not Latin outside of its strings")
        return spark.sql(made, nodes=self.graph.nodes, rels=self.graph.rels)

    def ask(self, question: str) -> list[str]:
        """JSON rows of the first attempt that finds any, at most `limit`; otherwise NOT_FOUND, or what went wrong."""
        if not question.strip():
            raise ValueError("the question is empty")
        spark = self.graph.nodes.sparkSession
        tag, pool = f"ask-{id(self)}-{time.monotonic_ns()}", ThreadPoolExecutor(1)
        work = pool.submit(self._attempts, question, tag)
        began, status, rows = time.monotonic(), "failed", None
        try:
            found, answer = work.result(self.seconds)
            status, rows = ("rows", len(answer)) if found else ("empty" if answer == [NOT_FOUND] else "failed", 0)
            return answer
        except Late:
            spark.interruptTag(tag)
            status = "late"
            return [f"It took more than {self.seconds:g} seconds."]
        finally:
            self.asked.append(Span("question", time.monotonic() - began, status, "", rows, question))
            pool.shutdown(wait=False, cancel_futures=True)

    def _attempts(self, question: str, tag: str) -> tuple[bool, list[str]]:
        self.graph.nodes.sparkSession.addTag(tag)
        feedback = ""
        for attempt in range(1, self.attempts + 1):
            began, before = time.monotonic(), len(self.spans)
            try:
                made = self.translate(question, self.schema(), list(self.history), feedback)
                frame = self.frame(made)
                answer = frame.limit(self.limit).select(json_row(*frame.columns).alias("row"))
                rows = [r.row for r in measured(answer, DataFrame.collect, self.spans, "attempt", question)]
                if rows:
                    self.history.append((question, made if isinstance(made, str) else " ".join(frame.columns)))
                    return True, rows
                feedback = "No rows. Take another way." if attempt == 1 else "No rows again. Look for names that contain the word, in any letter case."
            except Exception as e:
                again = isinstance(e, (ValueError, PySparkException))
                del self.spans[before:]
                self.spans.append(Span("attempt", time.monotonic() - began, "failed" if again else "broken", str(e)[:200], None, question))
                if not again:
                    return False, [f"It can't be answered: {e}"]
                feedback = f"It failed: {str(e)[:200]}"
        return False, [NOT_FOUND]


def regression(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected and actual answers side by side: case_id, question, expected, actual, and whether the actual one has the
    expected source. Cases without an actual answer stay."""
    source = F.regexp_extract("expected", rf"{SOURCE_WORD}: *(\S+)", 1)
    both = cases.join(actual.select("case_id", "actual", "seconds"), "case_id", "left")
    return both.withColumn("has_source", F.coalesce(F.contains(F.col("actual"), source) & (source != ""), F.lit(False)))
