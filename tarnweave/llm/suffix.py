"""Suffix-array dedup by longest-previous-factor arrays.

In suffix order, the nearest suffixes before and after one that start earlier in the corpus (previous and next smaller
position) share the longest prefixes with it that occur earlier. Where that longest previous factor has `width` bytes,
these bytes are a later copy and are removed; the first stays.

No text is sorted whole. Stretches that can hold a repeat are found by their anchors (see passages); the suffixes of
the different stretches with one anchor are sorted together, to the depth of `width` bytes.

Cases: a null or empty text has no bytes; texts shorter than the width keep all bytes; removal may cut a character, so
the kept text is binary; rows with one id are told apart by their texts' hashes (equal rows are one document); null
ids come last; ids that are no whole numbers, such as text, come in Spark's order; an empty table gives an empty one; output columns replace input ones of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.llm import passages

WIDTH, GRAM = 100, 32


def ranked(keys: np.ndarray) -> np.ndarray:
    """Each key's rank among the different keys."""
    order = np.argsort(keys)
    at = keys[order]
    fresh = np.zeros(len(at), np.uint32)
    fresh[1:] = at[1:] != at[:-1]
    out = np.empty(len(at), np.uint32)
    out[order] = np.cumsum(fresh, dtype=np.uint32)
    return out


def prefix_ranks(data: np.ndarray, depth: int, at: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The rank of each suffix (of those in `at`) by its first `depth` bytes, by doubling; equal prefixes have equal ranks, and
    what lies past the end is less than any byte. With it, the ranks of all suffixes at the lengths on the way."""
    n = len(data)
    padded = np.append(data.astype(np.uint16) + 1, np.zeros(depth + 8, np.uint16)).astype(np.uint64)
    known = min(7, depth)
    keys = np.zeros(n, np.uint64)
    for k in range(known):  # nine bits for each byte
        keys = keys << np.uint64(9) | padded[k : n + k]
    levels = []
    while known < depth:
        rank = ranked(keys) + np.uint32(1)
        levels.append((known, np.append(rank, np.uint32(0))))
        step = min(known, depth - known)
        far = np.append(rank, np.zeros(step, np.uint32)).astype(np.uint64)
        known += step
        own = slice(None) if known < depth or at is None else at
        keys = rank[own].astype(np.uint64) << np.uint64(32) | far[step : n + step][own]
    if at is not None and not levels:
        keys = keys[at]
    return ranked(keys), levels


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes the suffixes at a and b share, `depth` at most: by the ranks' lengths from the longest down, then by
    bytes."""
    n, out = len(data), np.zeros(len(a), np.int32)
    for length, rank in reversed(levels):
        while True:
            same = (out + length <= depth) & (np.take(rank, np.minimum(a + out, n)) == np.take(rank, np.minimum(b + out, n)))
            out[same] += length
            if 2 * length < depth or not same.any():  # only the longest may fit more than once
                break
    padded = np.append(data.astype(np.int16), np.int16(-1))
    for _ in range(min(7, depth)):
        x, y = np.take(padded, np.minimum(a + out, n)), np.take(padded, np.minimum(b + out, n))
        same = (out < depth) & (x == y) & (x >= 0)
        if not same.any():
            break
        out[same] += 1
    return out


def shared_with_earlier(lcp: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Of suffixes in suffix order: the longest prefix shared with the nearest one before that has a smaller position.
    lcp[i]: what i shares with i - 1. Candidates jump over those that jumped before: all between have larger positions."""
    n = len(position)
    at = np.arange(-1, n - 1)
    share = lcp.copy()
    if n:
        share[0] = 0
    active = np.flatnonzero((at >= 0) & (share > 0))
    active = active[position[at[active]] > position[active]]
    while len(active):
        via = at[active]
        new_at, new_share = at[via], np.minimum(share[active], share[via])
        new_share[new_at < 0] = 0
        at[active], share[active] = new_at, new_share
        on = (new_at >= 0) & (new_share > 0)
        active, new_at = active[on], new_at[on]
        active = active[position[new_at] > position[active]]
    return share


def previous_factors(data: np.ndarray, depth: int, at: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array of the suffixes at `at` (in order of position): how many of their first bytes, up to
    `depth`, also begin at an earlier one of them."""
    rank, levels = prefix_ranks(data, depth, at)
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(len(order), np.int32)
    same = rank[order][1:] == rank[order][:-1]
    lcp[1:][same] = depth
    apart = np.flatnonzero(~same)
    lcp[1 + apart] = common_prefixes(data, levels, at[order[apart]], at[order[apart + 1]], depth)
    before = shared_with_earlier(lcp, order)
    after = shared_with_earlier(np.append(0, lcp[:0:-1]).astype(np.int32), order[::-1])[::-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.maximum(before, after)
    return out


def spans(f: passages.Found, k: np.ndarray, width: int) -> pa.Array:
    """The bytes of runs k."""
    n = f.runs.count[k] + width - 1
    edges = np.append(0, np.cumsum(n))
    at = np.arange(edges[-1]) - np.repeat(edges[:-1] - f.runs.first[k], n)
    return pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(f.data[at].tobytes())])


def earlier(table: pa.Table, width: int) -> np.ndarray:
    """Of all windows of the rows (in order of position), which have an earlier copy."""
    n = table.column("n").to_numpy()
    data = np.frombuffer(b"".join(table.column("payload").to_pylist()), np.uint8)
    edges = np.append(0, np.cumsum(n + width - 1))[:-1]
    begins = np.append(0, np.cumsum(n))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1] - edges, n)
    return previous_factors(data, width, at) >= width


def finish(f: passages.Found, mask: np.ndarray) -> list[pa.Array]:
    n = f.rows.num_rows
    begins, ends = passages.stretches(mask, f.at[1:-1])
    of = np.searchsorted(f.at, begins, "right") - 1
    kept = f.data[~mask]
    removed = passages.per_text(mask, f.text, n)
    edges = np.append(0, np.cumsum(np.diff(f.at) - removed)).astype(np.int32)
    kept_text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(kept.tobytes())])
    place = pa.StructArray.from_arrays([pa.array((begins - f.at[of]).astype(np.int32)), pa.array((ends - f.at[of]).astype(np.int32))], ["begin", "end"])
    where = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), place)
    return [pa.array(np.diff(f.at)), pa.array(removed), where, kept_text]


def remove_later_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """df without the text, with n_bytes, n_removed, spans (of the removed bytes) and kept_bytes."""
    kind = passages.Kind(False, width, min(GRAM, width), True)
    return passages.mark(
        df, key, text, kind, lambda f, k: spans(f, k, width), lambda table: earlier(table, width), finish,
        "n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>, kept_bytes binary",
    )
