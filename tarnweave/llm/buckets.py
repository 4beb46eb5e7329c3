"""Comparing the rows of each bucket, however large one bucket is.

A bucket of up to `most` rows is one unit. A larger one is dealt into chunks by a hash of the rows' ids, and each two
chunks are a unit: no unit holds more than about twice `most` rows, and every pair of rows meets in exactly one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.common import stash

MOST = 4096
#: Rows that one vectorised step takes at least, unless the task has fewer.
STEP = 100_000


def units(rows: DataFrame, key: Sequence[str], row: str, most: int = MOST, sizes: DataFrame | None = None) -> DataFrame:
    """rows with _i, _j (the unit's two chunks) and _c (the row's own), brought together and sorted by unit. sizes: the
    rows of each key in _n, where those are known."""
    keys = [F.col(k) for k in key]
    hot = (rows.groupBy(*keys).agg(F.count("*").alias("_n")) if sizes is None else sizes).filter(F.col("_n") > most)
    hot = stash(hot.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_chunks")), "hot")
    own = F.pmod(F.xxhash64(row), F.col("_chunks")).cast("int")
    pair = lambda j: F.struct(F.least("_c", j).alias("_i"), F.greatest("_c", j).alias("_j"))
    one = F.array(F.struct(F.lit(0).alias("_i"), F.lit(0).alias("_j")))
    dealt = rows.join(hot, list(key), "left").withColumn("_c", F.coalesce(own, F.lit(0)))
    dealt = dealt.withColumn("_p", F.explode(F.when(F.col("_chunks").isNull(), one).otherwise(F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), pair))))
    dealt = dealt.select(*rows.columns, "_p._i", "_p._j", "_c")
    at = [*keys, F.col("_i"), F.col("_j")]
    return dealt.repartition(*at).sortWithinPartitions(*at)


def whole_units(batches: Iterator[pa.RecordBatch], key: Sequence[str], step: int = STEP) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, from sorted batches, and where each unit begins and the last ends."""
    names, kept, rows = [*key, "_i", "_j"], [], 0

    def cut(table: pa.Table) -> np.ndarray:
        fresh = np.zeros(table.num_rows, bool)
        fresh[:1] = True
        for n in names:
            x = table.column(n).to_numpy()
            fresh[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(fresh), table.num_rows)

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            rows += batch.num_rows
        if rows >= step:
            table = pa.Table.from_batches(kept).combine_chunks()
            at = cut(table)
            if len(at) > 2:
                yield table.slice(0, at[-2]), at[:-1]
            kept, rows = table.slice(at[-2]).to_batches(), table.num_rows - int(at[-2])
    if rows:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, cut(table)


def small_pairs(at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the units of at most `most` rows, some at a time."""
    size = np.diff(at)
    unit = np.repeat(np.arange(len(size)), size)
    first = at[0] + np.flatnonzero(size[unit] <= most)
    end = at[1:][unit[first - at[0]]]
    for d in range(1, most):
        on = first + d < end
        if not on.any():
            return
        first, end = first[on], end[on]
        yield first, first + d


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, where each place has a root's place, after joining a's with b's; changes `label`."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def joined(n: int, near: Callable[[int, int], tuple[np.ndarray, np.ndarray]], step: int = 256) -> np.ndarray:
    """A root's place for each of n rows, one for all that links join. near(i, j): the links of rows i to j with later rows."""
    label = np.arange(n)
    for i in range(0, n, step):
        merge_labels(label, *near(i, min(n, i + step)))
    return label


def stars(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's id with the least id of those that its links join, where that is another one. Buckets that hold the
    same group mostly give the same links so, and the different ones are few."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    to = least[label]
    return ids[to != ids], to[to != ids]
