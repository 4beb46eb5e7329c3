"""Finding every window that an earlier document has, in a few narrow passes over the documents.

A window is `width` units (words or bytes) of one document. Neighbouring windows with one anchor are a run (see
winnow). Equal windows have equal anchors, so:

1. A count-min sketch of all anchors, merged from the partitions, tells which may repeat.
2. Runs with such an anchor are grouped exactly, by anchor and content. Of each content the earliest run is known.
   All windows of any later one are in the earliest one too.
3. Earliest runs that share their anchor with another content are compared window by window (`resolve`), in units of
   bounded size however many contents a common anchor has.
4. A last pass over the documents, each joined with its list of earliest runs, marks what is covered.

Texts are shuffled once, for that join. Nothing that grows with the input but the bounded sketches is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.llm import buckets, common, sketch, winnow
from tarnweave.llm.common import spare, stash

#: Text bytes of a vectorised step, which takes about a hundred times as much memory. A longer text takes several steps, of
#: this many bytes or words.
BLOCK_BYTES, PIECE_BYTES, PIECE_WORDS = 1 << 19, 1 << 19, 1 << 17
#: Stretches that one step compares at least, unless the task has fewer: each has some hundred units.
STEP = 20_000
#: A null id comes after all others.
LAST = (1 << 63) - 1


class Kind(NamedTuple):
    """What a window is made of. within: an earlier place of the same document counts as earlier."""

    words: bool
    width: int
    gram: int
    within: bool


class Found(NamedTuple):
    """The runs of one block of texts, or of a piece of a long one, with what is needed to go on. base: the first unit of
    the piece, which the rolling hash counts from; runs count from the block's first. last: whether no piece follows."""

    rows: pa.RecordBatch
    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    base: int
    units: int
    last: bool
    rolling: winnow.Rolling
    runs: winnow.Runs
    sig: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = winnow.scatter(out * np.uint64(0x9E3779B97F4A7C15) + p.view(np.uint64) + np.uint64(1))
    return out


def found(batch: pa.RecordBatch, kind: Kind) -> Iterator[Found]:
    """batch: _d (document's order), _t (hash of the text), _text. A long text comes in pieces that overlap by all but one
    unit of a window, so each window is in one piece."""
    for rows, data, at in common.blocks(iter([batch]), "_text", BLOCK_BYTES):
        if kind.words:
            starts, ends, text = common.word_bounds(data, at)
            n = len(starts)
        else:
            starts = ends = np.zeros(0, np.int64)
            text = np.repeat(np.arange(rows.num_rows), np.diff(at))
            n = len(data)
        step = PIECE_WORDS if kind.words else PIECE_BYTES
        if len(data) <= 2 * BLOCK_BYTES:
            step = max(n, 1)
        for base in range(0, max(n, 1), step):
            upto = min(n, base + step + kind.width - 1)
            if kind.words:
                units = winnow.word_units(data, starts[base:upto], ends[base:upto])
                others = winnow.other_units(units)
            else:
                units, others = winnow.byte_units(data[base:upto]), winnow.byte_units(data[base:upto], 1)
            runs = winnow.runs(winnow.Rolling(units), text[base:upto], kind.width, kind.gram)
            rolling = winnow.Rolling(others, 1)  # contents are told by other hashes than anchors
            sig = rolling(runs.first, runs.first + runs.count + kind.width - 1)
            runs = runs._replace(first=runs.first + base)
            doc = rows.column("_d").to_numpy()[runs.text]
            place = np.zeros(len(doc), np.int64)
            if kind.within:
                begin = np.searchsorted(text, np.arange(rows.num_rows)) if kind.words else at[:-1]
                place = (rows.column("_t").to_numpy()[runs.text] >> 33 << 32 & (1 << 63) - 1) | (runs.first - begin[runs.text])
            yield Found(rows, data, at, starts, ends, text, base, upto - base, base + step >= n, rolling, runs, sig, doc, place)


def anchors(kind: Kind) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """Keys for the sketch; where only other documents count, each once for a text."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for f in found(batch, kind):
            if kind.within:
                yield f.runs.anchor
            elif len(f.sig):
                order = np.lexsort((f.runs.anchor, f.runs.text))
                a, t = f.runs.anchor[order], f.runs.text[order]
                yield a[np.append(True, (a[1:] != a[:-1]) | (t[1:] != t[:-1]))]

    return keys


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_runs(docs: DataFrame, kind: Kind, may: Broadcast) -> DataFrame:
    """(anchor, sig, d, p) of the runs whose anchor may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in found(batch, kind):
                on = may.value(f.runs.anchor)
                yield pa.RecordBatch.from_arrays([long(f.runs.anchor[on]), long(f.sig[on]), long(f.doc[on]), long(f.place[on])], ["anchor", "sig", "d", "p"])

    return docs.mapInArrow(run, "anchor long, sig long, d long, p long")


def contents(docs: DataFrame, kind: Kind, may: Broadcast, first: Broadcast, shared: Broadcast, payload: Callable[[Found, np.ndarray], pa.Array]) -> DataFrame:
    """The earliest runs with shared anchors (and perhaps a few others), with what `resolve` compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in found(batch, kind):
                on = np.flatnonzero(may.value(f.runs.anchor) & shared.value(mixed(f.runs.anchor)))
                on = on[first.value(mixed(f.runs.anchor[on], f.sig[on], f.doc[on], f.place[on]))]
                for i in range(0, len(on), 20_000):
                    k = on[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [long(f.runs.anchor[k]), long(f.sig[k]), long(f.doc[k]), long(f.place[k]), pa.array(f.runs.count[k].astype(np.int32)), payload(f, k)],
                        ["anchor", "sig", "d", "p", "n", "payload"],
                    )

    return docs.mapInArrow(run, "anchor long, sig long, d long, p long, n int, payload binary")


def earliest(table: pa.Table) -> pa.Table:
    """One row for each anchor and content, the earliest, in the order of documents and places."""
    anchor, sig, d, p = (table.column(c).to_numpy() for c in ("anchor", "sig", "d", "p"))
    order = np.lexsort((p, d, sig, anchor))
    a, s = anchor[order], sig[order]
    order = order[np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))]
    order = order[np.lexsort((p[order], d[order]))]
    return table.take(pa.array(order))


def stretches(on: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last place of each stretch of true values, cut at edges (places where one begins anew)."""
    begins, ends = on.copy(), on.copy()
    begins[1:] &= ~on[:-1]
    ends[:-1] &= ~on[1:]
    inner = edges[(edges > 0) & (edges < len(on))]
    cut = inner[on[inner] & on[inner - 1]]
    begins[cut], ends[cut - 1] = True, True
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def compared(rows: DataFrame, sizes: DataFrame, kind: Kind, most: int, resolve: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(d, mark, lo, hi): windows lo to hi of an earliest run that an earlier document (or place) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in buckets.whole_units(batches, ("anchor",), STEP):
            table = earliest(table)
            n = table.column("n").to_numpy()
            edges = np.append(0, np.cumsum(n))
            lo, hi = stretches(resolve(table), edges)
            at = np.searchsorted(edges, lo, "right") - 1
            mark = table.column("p" if kind.within else "sig").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(table.column("d").to_numpy()[at]), pa.array(mark), pa.array((lo - edges[at]).astype(np.int32)), pa.array((hi - edges[at]).astype(np.int32)),
            ], ["d", "mark", "lo", "hi"])

    return buckets.units(rows, ("anchor",), "sig", most, sizes).mapInArrow(run, "d long, mark long, lo int, hi int")


def covered(f: Found, kind: Kind, may: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which units of the piece are in a window that is earlier elsewhere. lists: of each text, its earliest runs."""
    on = np.flatnonzero(may)
    mark = (f.place if kind.within else f.sig.view(np.int64))[on]
    text = f.runs.text[on]
    values, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
    own_mark, lo, hi = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    own = np.repeat(np.arange(len(sizes)), sizes)
    key = lambda t, m: mixed(t.astype(np.int64), m)
    mine, theirs = key(text, mark), key(own, own_mark.astype(np.int64, copy=False))
    whole = ~np.isin(mine, theirs)
    starts, ends = [f.runs.first[on[whole]]], [f.runs.first[on[whole]] + f.runs.count[on[whole]]]
    part = np.flatnonzero(hi > lo)
    if len(part) and not whole.all():
        order = np.argsort(mine, kind="stable")
        left, right = np.searchsorted(mine[order], theirs[part]), np.searchsorted(mine[order], theirs[part], "right")
        for step in range(int((right - left).max(initial=0))):  # a document may hold a content several times
            ok = left + step < right
            run = on[order[(left + step)[ok]]]
            starts.append(f.runs.first[run] + lo[part[ok]])
            ends.append(f.runs.first[run] + hi[part[ok]])
    return winnow.covered(np.concatenate(starts) - f.base, np.concatenate(ends) + kind.width - 1 - f.base, f.units)


def mark(
    df: DataFrame,
    key: str,
    text: str,
    kind: Kind,
    payload: Callable[[Found, np.ndarray], pa.Array],
    resolve: Callable[[pa.Table], np.ndarray],
    finish: Callable[[Found, np.ndarray], list[pa.Array]],
    schema: str,
    most: int = buckets.MOST,
) -> DataFrame:
    """df without the text, with the columns of `schema` that `finish` makes of each block and its covered units."""
    made = T.StructType.fromDDL(schema)
    new = made.fieldNames()
    others = [c for c in df.columns if c.lower() != text.lower() and c.lower() not in [n.lower() for n in new]]
    df, own = in_order(df, key)
    d, t = F.coalesce(F.col(own).cast("long"), F.lit(LAST)), F.xxhash64(text)
    docs = df.select(d.alias("_d"), t.alias("_t"), F.col(text).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    step = (kind.width - kind.gram + 2) / 2 * (6 if kind.words else 1)
    may = sketch.build(docs, anchors(kind), sketch.bits_for(size / step), 2)
    earliest_runs = repeated_runs(docs, kind, may).groupBy("anchor", "sig").agg(F.min(F.struct("d", "p")).alias("x"))
    firsts = stash(earliest_runs.select("anchor", "sig", "x.d", "x.p"), "firsts")
    sizes = stash(firsts.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1"), "shared")
    as_keys = lambda names: lambda batch: iter([mixed(*(batch.column(c).to_numpy() for c in names))])
    first = sketch.build(firsts, as_keys(("anchor", "sig", "d", "p")), sketch.bits_for(firsts.count()), 1)
    shared = sketch.build(sizes.select("anchor"), as_keys(("anchor",)), sketch.bits_for(sizes.count()), 1)
    parts = compared(contents(docs, kind, may, first, shared, payload), sizes, kind, most, resolve)
    lists = firsts.select("d", F.col("p" if kind.within else "sig").alias("mark"), F.lit(0).alias("lo"), F.lit(0).alias("hi")).union(parts)
    lists = lists.groupBy(F.col("d").alias("_own")).agg(F.collect_list(F.struct("mark", "lo", "hi")).alias("_runs"))
    joined = docs_with(df, d, t, text, others).join(lists, F.col("_d") == F.col("_own"), "left").drop("_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None
        for batch in batches:
            for f in found(batch, kind):
                mask = np.zeros(len(f.text), bool) if mask is None else mask
                mask[f.base : f.base + f.units] |= covered(f, kind, may.value(f.runs.anchor), f.rows.column("_runs"))
                if not f.last:
                    continue
                yield pa.RecordBatch.from_arrays([*(f.rows.column(f"_o{i}") for i in range(len(others))), *finish(f, mask)], [*(f"_o{i}" for i in range(len(others))), *new])
                mask = None

    kept = [T.StructField(f"_o{i}", df.schema[c].dataType) for i, c in enumerate(others)]
    out = joined.mapInArrow(run, T.StructType([*kept, *made]))
    return out.select(*[F.col(f"_o{i}").alias(c) for i, c in enumerate(others)], *new)


def in_order(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df, and the column by whose whole numbers its documents are ordered: the key, or for a key of another type one more column,
    which grows with it. The different keys are sorted by ranges, and written, so that all passes see the same numbers."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df, key
    (own,) = spare(df, "_order")
    ids = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct().orderBy("_id")
    ids = stash(ids.select("_id", F.monotonically_increasing_id().alias(own)), "ids")
    return df.join(ids, df[key] == ids["_id"], "left").select(*[df[f"`{c}`"] for c in df.columns], own), own


def docs_with(df: DataFrame, d: F.Column, t: F.Column, text: str, others: list[str]) -> DataFrame:
    """The other columns under names of our own, so that none can clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others)], d.alias("_d"), t.alias("_t"), F.col(f"`{text}`").alias("_text"))


def per_text(mask: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's units are marked."""
    return np.bincount(text[mask], minlength=n).astype(np.int64)
