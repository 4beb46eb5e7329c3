"""Benchmark decontamination: a suffix automaton of the test items reads every training text.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, so punctuation and layout don't matter. A window is
`width` words in a row of an item; an item with fewer words (but any) is one window as a whole. A word of a text is hit if it lies
inside an occurrence of a window.

1. Items are cut into words and dealt to shards of at most `most_words` words. A task makes the automaton of each (see
   automaton), which is at most some hundred bytes a word, so what is broadcast is bounded whatever the benchmark's size.
2. The texts go by once for each shard, in narrow passes without a shuffle. Only stretches of words that all come in items, each two
   neighbours as neighbours there, can hold a window; the automaton reads those and tells the longest match at every word.
3. Runs of hit words are spans. They are taken out of the text, or the whole text is, if more than `coverage` of it is hit.

Cases: a null text or item has no words; an empty benchmark hits nothing; repeated items count once if their ids are equal, and
each otherwise; an item with a null id hits words, but is not listed; ids of any type are told by their strings; a text is read
whole, in blocks of words; an input column named like an output column (in any letter case) is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.llm import automaton, winnow
from tarnweave.llm.automaton import Automaton
from tarnweave.llm.common import blocks, lower_ascii, release, spare, stash

#: What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shard's items: its automaton has 50 MB at most.
MOST_WORDS = 1 << 18
#: A longer item is cut into pieces of so many words that overlap by all but one word of a window.
PIECE = 1 << 15
BLOCK_BYTES, STEP_WORDS = 1 << 20, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_MADE = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<first: long, last: long>>"


def shards(items: DataFrame, item_id: str, text: str, width: int, most_words: int) -> list[bytes]:
    """The automata of the items, pickled."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), BETWEEN), "")
    piece = min(PIECE, max(width, most_words // 2))
    whole = items.select(F.col(item_id).cast("string").alias("id"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(piece - width + 1))
    pieces = whole.select("id", F.posexplode(F.transform(starts, lambda k: F.slice("words", k + 1, F.lit(piece)))).alias("k", "words"))
    pieces = stash(pieces.filter(F.size("words") > 0), "items")
    mark = F.xxhash64(F.coalesce("id", F.lit("")), "k", F.array_join("words", " "))
    total, n = pieces.agg(F.sum(F.size("words"))).first()[0] or 0, 1
    while total > most_words * n or n > 1 and pieces.groupBy(F.pmod(mark, F.lit(n))).agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).first()[0] > most_words:
        n *= 2

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        names = [None if x is None or x != x else x for x in rows["id"]]
        own = automaton.build(names, [[w.encode() for w in words] for words in rows["words"]], width)
        return pd.DataFrame({"shard": rows["shard"][:1], "made": [pickle.dumps(own)]})

    made = pieces.withColumn("shard", F.pmod(mark, F.lit(n))).groupBy("shard").applyInPandas(make, "shard long, made binary")
    made = stash(made, "automata")
    return [bytes(r.made) for k in [r.shard for r in made.select("shard").collect()] for r in made.filter(F.col("shard") == k).collect()]


@lru_cache(1)
def _loaded(blob: bytes) -> Automaton:
    return pickle.loads(blob)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte of every word of lower-cased texts, and the index of its text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = at[1:-1]
    cut = edges[inside[edges] & inside[edges + 1]]  # two texts that touch
    begins[cut] = ends[cut] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(at, starts, "right") - 1


def same_words(own: Automaton, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words are those that their places say, byte by byte."""
    size = ends - starts
    out = size == own.word_at[ids + 1] - own.word_at[ids]
    some = np.flatnonzero(out)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size[some])])
        shift = np.arange(first[-1]) - np.repeat(first[:-1], size[some])
        equal = data[np.repeat(starts[some], size[some]) + shift] == own.word_bytes[np.repeat(own.word_at[ids[some]], size[some]) + shift]
        out[some] = np.logical_and.reduceat(equal, first[:-1])
    return out


def hits(own: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit; and of each word that ends a window, its place and the two states that tell the items; and the
    longest match at every word of a stretch, as (place, words)."""
    ids = np.concatenate([np.zeros(0, np.int64), *(automaton.known_words(own, winnow.word_units(data, starts[k : k + STEP_WORDS], ends[k : k + STEP_WORDS])) for k in range(0, len(starts), STEP_WORDS))])
    first, last = automaton.stretches(own, ids, text)
    inside = np.repeat(first, last - first) + (np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first))
    if len(inside):
        ids[inside[~same_words(own, ids[inside], data, starts[inside], ends[inside])]] = -1
    place, state, match = automaton.walk(own, ids, first, last)
    size, full, short = automaton.windows(own, state, match)
    some = size > 0
    turns = np.zeros(len(starts) + 1, np.int64)
    np.add.at(turns, place[some] - size[some] + 1, 1)
    np.add.at(turns, place[some] + 1, -1)
    return np.cumsum(turns[:-1]) > 0, np.stack([place[some], full[some], short[some]], 1), place, match


def scan(df: DataFrame, text: str, blob: Broadcast[bytes], n_kept: int) -> DataFrame:
    """df, whose columns after the first n_kept are `text` and those of _MADE, with what this shard hits added."""
    made = T.StructType.fromDDL(_MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(blob.value)
        for rows, data, at in blocks(batches, text, BLOCK_BYTES):
            data = _LOWER[data]
            starts, ends, doc = word_bounds(data, at)
            hit, ending, place, match = hits(own, data, starts, ends, doc)
            n = rows.num_rows
            begin = np.searchsorted(doc, np.arange(n + 1))
            before = rows.columns[n_kept + 1 :]
            longest = before[2].to_numpy(zero_copy_only=False).copy()
            np.maximum.at(longest, doc[place], match)
            for k, known in enumerate(before[4].to_pylist()) if len(before[4].flatten()) else ():
                for span in known:
                    hit[begin[k] + span["first"] : begin[k] + span["last"]] = True
            named = [set(x) for x in before[3].to_pylist()]
            for k, full, short in np.unique(np.column_stack([doc[ending[:, 0]], ending[:, 1:]]), axis=0).tolist() if len(ending) else ():
                named[k].update(own.names[i] for i in automaton.items_of(own, full, short) if own.names[i] is not None)
            fresh = hit & np.concatenate([[True], ~hit[:-1] | (doc[1:] != doc[:-1])])[: len(hit)]
            over = hit & np.concatenate([~hit[1:] | (doc[1:] != doc[:-1]), [True]])[-len(hit) :] if len(hit) else hit
            a, z = np.flatnonzero(fresh), np.flatnonzero(over) + 1
            spans = pa.StructArray.from_arrays([pa.array(a - begin[doc[a]]), pa.array(z - begin[doc[a]])], ["first", "last"])
            columns = [
                pa.array(np.diff(begin)),
                pa.array(np.bincount(doc[hit], minlength=n)),
                pa.array(longest),
                pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[a], np.arange(n + 1)), pa.int32()), spans),
            ]
            yield pa.RecordBatch.from_arrays([*rows.columns[: n_kept + 1], *columns], names)
        release()

    kept = df.schema.fields[: n_kept + 1]
    names = [*(f.name for f in kept), *made.names]
    return df.mapInArrow(run, T.StructType([*kept, *made.fields]))


def find(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    coverage: float = 0.2,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """df with n_words, n_hit (words inside occurrences), longest (words of the longest match of any stretch that can hold a
    window), items (ids of the items with occurring windows, sorted strings), spans (runs of hit words, `last` excluded) and
    rejected (more than `coverage` of the words are hit). clean() takes the spans out."""
    if width < 1 or most_words < 2 * width:
        raise ValueError("windows have one word at least, and a shard has two windows")
    made = T.StructType.fromDDL(_MADE)
    out = [*made.names, "rejected"]
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in out or c == text])
    (own,) = spare(df, "_whole")
    kept = [c for c in df.columns if c.lower() not in out]
    start = [F.lit(0).cast("long").alias(n) for n in made.names[:3]] + [F.array().cast(f.dataType).alias(f.name) for f in made.fields[3:]]
    found = df.select(*[f"`{c}`" for c in kept], F.coalesce(F.col(text), F.lit("")).alias(own), *start)
    parts = shards(items, item_id, item_text, width, most_words) or [pickle.dumps(automaton.build([], [], width))]
    for k, blob in enumerate(parts):
        if k:
            found = stash(found, "scanned")
        found = scan(found, own, df.sparkSession.sparkContext.broadcast(blob), len(kept))
    rejected = F.col("n_hit") > coverage * F.col("n_words")
    return found.select(*[f"`{c}`" for c in kept], *made.names, rejected.alias("rejected"))


def clean(df: DataFrame, text: str = "text", spans: str = "spans", rejected: str = "rejected") -> DataFrame:
    """What find() gives, with the hit words, and what lies between them, out of the texts; rejected ones go."""

    def cut(whole: str | None, at: list) -> str | None:
        if whole is None or not len(at):
            return whole
        raw = whole.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = word_bounds(_LOWER[data], np.array([0, len(data)]))
        out, done = [], 0
        for s in at:
            out.append(raw[done : starts[s["first"]]])
            done = int(ends[s["last"] - 1])
        return b"".join([*out, raw[done:]]).decode()

    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in blocks(batches, text, BLOCK_BYTES):
            k = rows.schema.get_field_index(text)
            kept = [cut(x, y) for x, y in zip(rows.column(k).to_pylist(), rows.column(spans).to_pylist(), strict=True)]
            yield rows.set_column(k, rows.schema.field(k), pa.array(kept, rows.schema.field(k).type))

    return df.filter(~F.col(rejected)).mapInArrow(run, schema)
