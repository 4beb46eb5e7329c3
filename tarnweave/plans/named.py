"""Named questions with parameters, as SQL table functions of the session.

A named question is a pattern, given as a frame over the graph, and a condition on its columns and the parameters. register() makes a
temporary view of the pattern and a temporary SQL function over it, so SELECT * FROM <name>(...) runs the pattern's own plan: Spark puts
both in line, and the condition reaches the scans. Arguments are values that Spark binds; no text of theirs becomes part of a query.

dispatch() answers many calls at once: each goes to the function that it names, and a call of an unknown name, or one that
lacks an argument, gives an error row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators.match import Match
from tarnweave.sources.graph import PROVENANCE, Graph
from tarnweave.sources.shared import stash

_NAME = re.compile(r"[a-z][a-z0-9_]*\Z")
_KIND = re.compile(r"(string|int|bigint|double|boolean|date|timestamp)\Z")


@dataclass(frozen=True)
class Question:
    """rows: the pattern for a graph. where: a condition on its columns and the parameters, in SQL; written by whoever defines the
    question, not by callers. parameters: names and types; none is also a column of the pattern. begins: where the condition
    wants the node that the pattern's first variable is to have a property equal to a parameter, these two, as (property,
    parameter): many calls at once then begin at the nodes that they name, and not at all nodes."""

    name: str
    about: str
    rows: Callable[[Graph], DataFrame]
    where: str
    parameters: dict[str, str] = field(default_factory=dict)
    begins: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        for name in (self.name, *self.parameters):
            if not _NAME.match(name):
                raise ValueError(f"not a plain name: {name}")
        for kind in self.parameters.values():
            if not _KIND.match(kind):
                raise ValueError(f"not a type of parameters: {kind}")


def _connected(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a").both("r", "b")
    return m.returns(F.col("a_name").alias("source"), F.col("r_type").alias("relation"), F.col("b_name").alias("target"), F.col("b_id").alias("target_id"), rel="r")


def _statements(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a").out("r", "b")
    return m.returns(F.col("a_id").alias("source_id"), F.col("r_type").alias("relation"), F.col("b_id").alias("target_id"), rel="r")


#: Questions that any graph can be asked.
QUESTIONS = (
    Question("connected_to", "What is connected to a node of this name, in any direction.", _connected, "source = who", {"who": "string"}, ("name", "who")),
    Question("statements_of", "Relationships from a node, of at least this confidence.", _statements, "source_id = node AND confidence >= least", {"node": "string", "least": "double"}, ("id", "node")),
)


class Registry:
    """The named questions of one graph in its session."""

    def __init__(self, graph: Graph, questions: Iterable[Question] = QUESTIONS):
        self.graph, self.spark = graph, graph.nodes.sparkSession
        self.questions: dict[str, Question] = {}
        for q in questions:
            self.register(q)

    def register(self, q: Question) -> None:
        """Makes q callable from SQL; a question of its name before is replaced."""
        frame = q.rows(self.graph)
        clash = {c.lower() for c in frame.columns} & set(q.parameters)
        if clash:
            raise ValueError(f"parameters with names of columns: {', '.join(sorted(clash))}")
        frame.createOrReplaceTempView(f"{q.name}_rows")
        given = ", ".join(f"{n} {kind}" for n, kind in q.parameters.items())
        made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        columns = ", ".join(f"`{c}`" for c in frame.columns)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {q.name}({given}) RETURNS TABLE({made}) RETURN SELECT {columns} FROM {q.name}_rows WHERE {q.where}")
        self.questions[q.name] = q

    def listed(self) -> DataFrame:
        """(name, about, parameters): what can be asked; the parameters as a JSON schema."""
        kinds = {"string": "string", "date": "string", "timestamp": "string", "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean"}
        rows = []
        for q in self.questions.values():
            own = ", ".join(f'"{n}": {{"type": "{kinds[kind]}"}}' for n, kind in q.parameters.items())
            rows.append((q.name, q.about, f'{{"type": "object", "properties": {{{own}}}, "required": [{", ".join(f"{chr(34)}{n}{chr(34)}" for n in q.parameters)}]}}'))
        return self.spark.createDataFrame(rows, "name string, about string, parameters string")

    def ask(self, name: str, **arguments: object) -> DataFrame:
        """The rows of one question."""
        q = self.questions.get(name)
        if q is None:
            raise ValueError(f"unknown question: {name}")
        if set(arguments) != set(q.parameters):
            raise ValueError(f"{name} takes {', '.join(q.parameters) or 'nothing'}")
        return self.spark.sql(f"SELECT * FROM {name}({', '.join(f':{n}' for n in q.parameters)})", args=arguments)

    def dispatch(self, calls: DataFrame) -> DataFrame:
        """calls: call_id, name, arguments (map of strings). Rows: call_id, row (JSON, null for errors), error. A call whose
        question finds nothing gives no row; an argument that is no value of its type, or null, is missing."""
        calls = calls.select("call_id", "name", "arguments")
        known = self.spark.createDataFrame([(q.name, list(q.parameters)) for q in self.questions.values()], "known string, wanted array<string>")
        checked = calls.join(F.broadcast(known), F.col("name") == F.col("known"), "left")
        values = {q.name: {n: F.col("arguments")[n].try_cast(kind) for n, kind in q.parameters.items()} for q in self.questions.values()}
        given = reduce(lambda a, q: F.when(F.col("name") == q, F.array_compact(F.array(*[F.when(v.isNotNull(), n) for n, v in values[q].items()]).cast("array<string>"))).otherwise(a), values, F.array().cast("array<string>"))
        missing = F.array_except("wanted", given)
        error = F.when(F.col("known").isNull(), F.concat(F.lit("unknown question: "), F.coalesce("name", F.lit("")))).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        checked = checked.withColumn("error", error)
        out = [checked.filter("error IS NOT NULL").select("call_id", F.lit(None).cast("string").alias("row"), "error")]
        for q in self.questions.values():
            mine = checked.filter((F.col("error").isNull()) & (F.col("name") == q.name)).select("call_id", *[v.alias(n) for n, v in values[q.name].items()])
            if q.begins is not None:
                out.append(self._answered(q, mine).select("call_id", "row", F.lit(None).cast("string").alias("error")))
                continue
            made = self.spark.sql(f"SELECT c.call_id, to_json(struct(r.*), map('ignoreNullFields', 'false')) AS row FROM {{mine}} c, LATERAL {q.name}({', '.join(f'c.{n}' for n in q.parameters)}) r", mine=mine)
            out.append(made.select("call_id", "row", F.lit(None).cast("string").alias("error")))
        return reduce(DataFrame.union, out)

    def _answered(self, q: Question, mine: DataFrame) -> DataFrame:
        """(call_id, row) of the calls of a question that begins at nodes they name: these nodes are found and written first, so
        that Spark knows how few they are, and the pattern is walked from them only."""
        own, wanted = q.begins
        named = mine.select(F.col(wanted).alias("_wanted")).distinct()
        nodes = self.graph.nodes
        first = stash(nodes.join(named, nodes[own] == F.col("_wanted"), "left_semi"), "named")
        rows = q.rows(replace(self.graph, first=first))
        return self.spark.sql(f"SELECT c.call_id, to_json(struct(r.*), map('ignoreNullFields', 'false')) AS row FROM {{mine}} c JOIN (SELECT * FROM {{rows}}) r ON {q.where}", mine=mine, rows=rows)
