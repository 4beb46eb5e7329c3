"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors whose signs agree on all hyperplanes of a table meet in its bucket, where cosines are computed in double
precision. A pair counts only in the first table that it shares, so links are counted once. The number of planes
grows with the logarithm of the rows, which keeps buckets of unrelated vectors small, and the number of tables follows
from it, so that a pair at the threshold is missed with at most `miss` probability (closer pairs more seldom).

Equal vectors are one row from the start, with a count; equal vectors link with each other.

Cases: a vector that is null, empty, zero or has null or non-finite components links with nothing, nor do vectors of
different lengths; repeated rows are other vectors; a null id takes part but is never a component id (null if a
component has no other); an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm import buckets
from tarnweave.llm.common import join_hot, stash
from tarnweave.llm.components import components

#: A bucket of unrelated vectors has about so many rows.
FILL = 8
#: Rows of a matrix product at a time.
STEP = 256


def shape(rows: int, least: float, miss: float) -> tuple[int, int]:
    """Planes for each table, and tables."""
    planes = min(48, max(8, math.ceil(math.log2(max(rows, 2) / FILL))))
    meet = (1 - math.acos(least) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


@lru_cache(4)
def hyperplanes(size: int, planes: int, tables: int, seed: int) -> np.ndarray:
    return np.rint(np.random.default_rng([seed, size]).standard_normal((size, planes * tables)) * 1024)


def signatures(vectors: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """A long for each vector and table. Vectors and planes are rounded to whole numbers whose sums are exact in any
    order, so a vector has the same signs wherever they are computed."""
    whole = np.rint(vectors / np.abs(vectors).max(1)[:, None] * (1 << 20))
    signs = (whole @ hyperplanes(vectors.shape[1], planes, tables, seed) >= 0).reshape(len(vectors), tables, planes)
    return signs @ (1 << np.arange(planes, dtype=np.int64))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def usable(vector: str) -> F.Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def linked(distinct: DataFrame, planes: int, tables: int, least: float, seed: int, most: int) -> DataFrame:
    """(a, b, n): a and b two distinct vectors that a bucket's links join, or b null and n the number of vectors that a
    links with in a bucket. `distinct`: _id, _n, _v."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                marks = signatures(matrix(part.column(2), int(size)), planes, tables, seed)
                for first in range(0, part.num_rows, 512):
                    own = marks[first : first + 512]
                    at = np.repeat(np.arange(first, first + len(own)), tables)
                    table = np.tile(np.arange(tables, dtype=np.int32), len(own))
                    columns = [pa.array(table), pa.array(np.full(len(at), size, np.int32)), pa.array(own.ravel())]
                    columns += [part.column(k).take(pa.array(at)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(columns, ["_t", "_s", "_mark", "_id", "_n", "_v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in buckets.whole_units(batches, ("_t", "_s", "_mark")):
            ids, n = table.column("_id").to_numpy(), table.column("_n").to_numpy()
            nth, sizes, chunk = (table.column(c).to_numpy() for c in ("_t", "_s", "_c"))
            cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
            vectors = table.column("_v").combine_chunks()
            count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for k in np.flatnonzero(np.diff(at) > 1):
                lo, hi = int(at[k]), int(at[k + 1])
                own = matrix(vectors.slice(lo, hi - lo), int(sizes[lo]))
                unit = own / np.sqrt((own * own).sum(1))[:, None]

                def close(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
                    a, b = np.nonzero(unit[i:j] @ unit[i:].T >= least)  # noqa: B023
                    a, b = a[a < b] + i, b[a < b] + i
                    if cross[lo]:  # noqa: B023
                        other = chunk[lo + a] != chunk[lo + b]  # noqa: B023
                        a, b = a[other], b[other]
                    if nth[lo] and len(a):  # noqa: B023
                        some, at_some = np.unique(np.append(a, b), return_inverse=True)
                        marks = signatures(own[some], planes, tables, seed)[:, : nth[lo]]  # noqa: B023
                        x, y = at_some[: len(a)], at_some[len(a) :]
                        new = np.ones(len(a), bool)
                        for s in range(0, len(a), 1 << 15):
                            new[s : s + (1 << 15)] = ~(marks[x[s : s + (1 << 15)]] == marks[y[s : s + (1 << 15)]]).any(1)
                        a, b = a[new], b[new]
                    np.add.at(count, lo + a, n[lo + b])  # noqa: B023
                    np.add.at(count, lo + b, n[lo + a])  # noqa: B023
                    return a, b

                label[lo:hi] = lo + buckets.joined(hi - lo, close, STEP)
            a, b = buckets.stars(ids, label)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(a, ids[some])),
                pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(some), pa.int64())]),
                pa.array(np.append(np.zeros(len(a), np.int64), count[some])),
            ], ["a", "b", "n"])

    kind = distinct.schema["_v"].dataType.simpleString()
    rows = distinct.select("_id", "_n", "_v").mapInArrow(index, f"_t int, _s int, _mark long, _id long, _n long, _v {kind}")
    return buckets.units(rows, ("_t", "_s", "_mark"), "_id", most).mapInArrow(compare, "a long, b long, n long")


def near_duplicates(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    least: float = 0.9,
    miss: float = 0.05,
    seed: int = 11,
    most: int = buckets.MOST,
) -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id (the least key that links lead
    to) and kept (key is the component's)."""
    rows = df.select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    good = rows.filter(usable("_v"))
    # equal vectors get one hash of 128 bits; the join below needs no vector
    mark = F.md5(F.to_json(F.struct("_v")))
    marked = stash(rows.select("_key", F.when(usable("_v"), mark).alias("_mark")), "marked")
    groups = stash(marked.filter("_mark is not null").groupBy("_mark").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).withColumn("_id", F.xxhash64("_mark")), "vectors")
    single = good.select(mark.alias("_mark"), "_v").groupBy("_mark").agg(F.first("_v").alias("_v"))
    distinct = stash(groups.join(single, "_mark").select("_id", "_n", "_v"), "distinct")
    planes, tables = shape(distinct.count(), least, miss)
    found = stash(linked(distinct, planes, tables, least, seed, most), "links")
    roots = components(found.filter("b is not null"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("_more"))
    named = (
        groups.join(roots, groups["_id"] == roots["node"], "left")
        .join(counts, groups["_id"] == counts["a"], "left")
        .select("_mark", F.coalesce("component", "_id").alias("_root"), "_first", (F.col("_n") - 1 + F.coalesce("_more", F.lit(0))).alias("n_links"), groups["_n"].alias("_rows"))
    )
    named = stash(named, "roots")
    least_key = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = named.join(least_key, "_root").select("_mark", "n_links", "component_id", "_rows")
    found = join_hot(marked.filter("_mark is not null"), named, "_mark", "_rows").select("_key", F.col("n_links").cast("long"), "component_id")
    alone = marked.filter("_mark is null").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return found.union(alone).select(F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)).alias("kept"))
