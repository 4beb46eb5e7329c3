"""Substring dedup: windows of words that a smaller document has are removed.

A count-min sketch, merged from the partitions' sketches, overestimates how many documents have the anchor of a
window; a second pass groups exactly only windows whose estimate is 2 or more. A window repeats only if its anchor
does, so none is lost (see passages). What is counted are these anchors: the least 8-word hash of each window, once for
a document however many of its windows have it.

Cases: a null text has no words; texts shorter than a window keep all words; windows are compared by 64 bits of
their anchor and 64 bits of the whole, of rolling hashes with different bases over different hashes of the words; rows with one id are one document, so nothing is removed between them; null ids come last and are one
document; ids that are no whole numbers, such as text, come in Spark's order; ties keep both; an empty table gives an empty one; output columns replace input ones of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.llm import passages, winnow

WIDTH, GRAM = 50, 8


def window_hashes(f: passages.Found, k: np.ndarray, width: int) -> pa.Array:
    """Of runs k: the hash of each window, eight bytes each. (The runs are grouped by their anchor's hash, too.)"""
    n = f.runs.count[k]
    edges = np.append(0, np.cumsum(n))
    starts = np.arange(edges[-1]) - np.repeat(edges[:-1] - f.runs.first[k], n)
    starts -= f.base
    hashes = f.rolling(starts, starts + width)
    return pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(hashes.astype("<u8").tobytes())])


def earlier(table: pa.Table) -> np.ndarray:
    """Of all windows of the rows (in order of documents), which another row of a smaller document has."""
    n, d, anchor = (table.column(c).to_numpy() for c in ("n", "d", "anchor"))
    h = np.frombuffer(b"".join(table.column("payload").to_pylist()), "<u8")
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((row, anchor[row], h))
    same = np.append(False, (h[order][1:] == h[order][:-1]) & (anchor[row[order]][1:] == anchor[row[order]][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    out = np.zeros(len(h), bool)
    out[order] = d[row[order]] > d[row[order[head]]]
    return out


def finish(f: passages.Found, mask: np.ndarray, layout: bool) -> list[pa.Array]:
    n = f.rows.num_rows
    keep = np.flatnonzero(~mask)
    starts, ends, text = f.starts[keep], f.ends[keep], f.text[keep]
    data = f.data.tobytes()
    edges, removed = np.searchsorted(text, np.arange(n + 1)), passages.per_text(mask, f.text, n)
    kept = []
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        if layout and not removed[i]:
            kept.append(data[f.at[i] : f.at[i + 1]])
        elif layout:
            before = np.where(keep[a:b] > 0, f.ends[keep[a:b] - 1], 0).clip(f.at[i])
            kept.append(b"".join([data[s:e] for s, e in zip(before.tolist(), ends[a:b].tolist())]))
        else:
            kept.append(b" ".join([data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]))
    return [pa.array(np.bincount(f.text, minlength=n).astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, layout: bool = False) -> DataFrame:
    """df without the text, with n_words, n_removed and kept_text: the kept words, joined by one space, or with
    `layout` each after the white space that was before it (a text that loses nothing stays as it is)."""
    kind = passages.Kind(True, width, min(GRAM, width), False)
    return passages.mark(df, key, text, kind, lambda f, k: window_hashes(f, k, width), earlier, lambda f, mask: finish(f, mask, layout), "n_words long, n_removed long, kept_text string")
