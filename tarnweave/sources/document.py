"""A graph as one JSON document, {"nodes": [...], "relationships": [...]}, read by many tasks and written whole or not at all.

Reading. Spark's text source cuts the file into byte ranges, at closing braces. Where a range begins, nothing tells whether that is
inside a string or how deep, so the document goes by twice:

1. Each range tells whether it has an odd number of quotes and, for a start outside or inside a string, by how much it goes deeper. From
   these few numbers of each range follow the states in which all of them begin.
2. Each range, knowing its state, cuts out the elements of the two arrays. An element that lies across ranges comes in pieces,
   which are put together by the range that it begins in.

The elements are written to the shared folder, and the graph reads them there. No task holds more than a batch of a range and one
element. White space and the order of the two arrays don't matter; other members of the document are skipped; an element that
isn't an object of the known form gives null columns, as JSON lines do.

Writing. Elements are written in parts by all tasks, then the parts are copied behind one another into a file beside the goal, which
is renamed at the end. If anything fails, parts and file go and what was at the goal stays.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.sources.graph import NODE_DUMP, REL_DUMP, Graph, loaded
from tarnweave.sources.shared import stash

_KEY = re.compile(rb'"([^"\\]*)"\s*:\s*\Z')
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_TURN = np.zeros(256, np.int8)
_TURN[[ord("{"), ord("[")]] = 1
_TURN[[ord("}"), ord("]")]] = -1


class State(NamedTuple):
    """Where a range begins: inside a string or not, how deep, in which array, and in which range its first element began."""

    quoted: bool
    depth: int
    section: str | None
    opened: int


def turns(data: np.ndarray, quoted: bool) -> tuple[np.ndarray, bool]:
    """Places of brackets and braces outside strings, and whether the end is inside one. Nothing is escaped before the data: it begins
    behind a brace."""
    quotes = np.flatnonzero(data == _QUOTE)
    slashes = data == _BACKSLASH
    if slashes.any() and len(quotes):
        other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))  # the last place that is no backslash
        before = np.where(quotes > 0, other[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    at = np.flatnonzero(_TURN[data])
    inside = (np.searchsorted(quotes, at) + quoted) % 2 == 1
    return at[~inside], (len(quotes) + quoted) % 2 == 1


def array_at(data: bytes, at: int) -> str | None:
    """The name of the member whose value, an array, begins at a place; None if it is an object or has no name."""
    found = _KEY.search(data, max(0, at - 1000), at) if data[at : at + 1] == b"[" else None
    return found[1].decode("utf-8", "replace") if found else None


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(range, bytes) of each batch, with the braces at which the lines were cut."""
    for batch in batches:
        starts = batch.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(starts[1:] != starts[:-1]) + 1, [len(starts)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi > lo:
                yield int(starts[lo]), "}".join([*batch.column(0).slice(lo, hi - lo).to_pylist(), ""]).encode()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, for a start outside (0) and inside (1) a string: whether the end is inside one, how much deeper it is, the least
    depth, and the last array or object that begins at each depth, all from the range's start."""
    found: dict[int, list[dict]] = {}
    for start, data in _ranges(batches):
        both = found.setdefault(start, [{"quoted": bool(q), "depth": 0, "least": 0, "arrays": {}} for q in (0, 1)])
        array = np.frombuffer(data, np.uint8)
        for own in both:
            at, own["quoted"] = turns(array, own["quoted"])
            turn = _TURN[array[at]].astype(np.int64)
            depth = own["depth"] + np.cumsum(turn)
            for level in np.unique(before := depth - turn) if len(at) else ():
                if level <= own["least"] + 1:  # deeper ones are inside elements
                    opens = at[(before == level) & (turn > 0)]
                    if len(opens):
                        own["arrays"][int(level)] = array_at(data, int(opens[-1]))
            own["least"] = int(min(own["least"], depth.min(initial=own["least"])))
            own["depth"] = int(depth[-1]) if len(at) else own["depth"]
    rows = [(s, q, x["quoted"], x["depth"], x["least"], list(x["arrays"].items())) for s, both in found.items() for q, x in enumerate(both)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.string())), strict=True)],
        ["start", "given", "quoted", "depth", "least", "arrays"],
    )


def states(rows: list) -> dict[int, State]:
    """The state in which each range begins, from the summaries of all."""
    by = {(r.start, r.given): r for r in rows}
    now, out = State(False, 0, None, -1), {}
    for start in sorted({r.start for r in rows}):
        out[start] = now
        r = by[start, int(now.quoted)]
        depth = now.depth + r.depth
        section = r.arrays.get(1 - now.depth, now.section)
        opened = now.opened if now.depth + r.least >= 3 and now.depth >= 3 else start
        now = State(r.quoted, depth, section, opened)
    return out


def elements(spark: SparkSession, path: str, sections: tuple[str, ...] = ("nodes", "relationships")) -> DataFrame:
    """(section, text): the elements of these arrays of the document, which are written to the shared folder."""
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("start"))
    rows = lines.mapInArrow(_summaries, "start long, given int, quoted boolean, depth long, least long, arrays map<long,string>").collect()
    known = spark.sparkContext.broadcast(states(rows))  # a state for each range of the file

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        out: list[tuple[str | None, int | None, int, str]] = []

        def close() -> None:
            """What is left of a range belongs to an element that goes on."""
            if own and own["depth"] >= 3 and own["pieces"]:
                out.append((own["section"], own["opened"], own["start"], b"".join(own["pieces"]).decode()))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["section", "opened", "at", "text"])
            out.clear()
            return made

        for start, data in _ranges(batches):
            if not own or own["start"] != start:
                close()
                s = known.value[start]
                own = {"start": start, "quoted": s.quoted, "depth": s.depth, "section": s.section, "opened": s.opened, "pieces": [], "whole": False}
            array = np.frombuffer(data, np.uint8)
            at, own["quoted"] = turns(array, own["quoted"])
            turn = _TURN[array[at]].astype(np.int64)
            depth = own["depth"] + np.cumsum(turn)
            before = depth - turn
            begin = 0  # of the element that is open
            events = np.flatnonzero((((before == 1) | (before == 2)) & (turn > 0)) | ((before == 3) & (turn < 0)))
            for k in events.tolist():
                place = int(at[k])
                if before[k] == 1:
                    own["section"] = array_at(data, place)
                elif before[k] == 2:
                    begin, own["opened"], own["whole"] = place, start, True
                else:
                    text = b"".join([*own["pieces"], data[begin : place + 1]]).decode()
                    out.append((own["section"], None if own["whole"] else own["opened"], start, text))
                    own["pieces"] = []
            own["depth"] = int(depth[-1]) if len(at) else own["depth"]
            if own["depth"] >= 3:
                own["pieces"].append(data[begin:])
            if len(out) >= 1000:
                yield batch()
        close()
        yield batch()

    pieces = lines.mapInArrow(cut, "section string, opened long, at long, text string").filter(F.col("section").isin(*sections))
    pieces = stash(pieces, "pieces")
    whole = pieces.filter("opened IS NULL").select("section", "text")
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    across = pieces.filter("opened IS NOT NULL").groupBy("section", "opened").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).select("section", "text")
    return stash(whole.union(across), "elements")


def load_document(spark: SparkSession, path: str) -> Graph:
    """The graph of one JSON document in one uncompressed file."""
    every = elements(spark, path)
    of = lambda section, schema: every.filter(F.col("section") == section).select(F.from_json("text", schema).alias("x")).select("x.*")
    return loaded(of("nodes", NODE_DUMP), of("relationships", REL_DUMP))


def save_document(graph: Graph, path: str) -> None:
    """Writes the graph as one document; a file that is there is replaced when the new one is whole."""
    spark = graph.nodes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(conf)
    folder, name = path.rstrip("/").rpartition("/")[::2]
    work = f"{folder}/.{name}-{uuid.uuid4().hex}"
    try:
        parts = []
        for section, rows in (("nodes", graph.dump_nodes()), ("relationships", graph.dump_rels())):
            rows.select(F.concat(F.lit(","), "value")).write.text(f"{work}/{section}")
            parts.append((section, sorted(f.getPath().toString() for f in fs.listStatus(at(f"{work}/{section}")) if f.getPath().getName().startswith("part-") and f.getLen())))
        out = fs.create(at(f"{work}/whole"), True)
        try:
            for k, (section, files) in enumerate(parts):
                out.write(bytearray(f'{"," if k else "{"}\n"{section}": [\n'.encode()))
                for j, file in enumerate(files):
                    one = fs.open(at(file))
                    try:
                        one.seek(int(not j))  # the first element has no comma before it
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(one, out, 1 << 20, False)
                    finally:
                        one.close()
                out.write(bytearray(b"]"))
            out.write(bytearray(b"}\n"))
        finally:
            out.close()
        if fs.exists(at(path)):
            fs.delete(at(path), False)
        if not fs.rename(at(f"{work}/whole"), at(path)):
            raise OSError(f"{path} can't be put in place")
    finally:
        fs.delete(at(work), True)
