"""Hard-negative mining: an exact kNN join of anchors with all rows, partitioned by Voronoi cells.

A score is the inner product of two vectors of whole numbers. For it to be a distance, vectors get one more component: a row x
gets sqrt(M - |x|^2), M the largest square of a norm, an anchor q gets 0. Then |q - x|^2 = |q|^2 + M - 2 score, so the
highest scores are the nearest rows, and the triangle inequality holds.

1. Pivots are a bounded sample of rows. Every row lies in the cell of its nearest pivot, at a known distance d.
2. Anchors are dealt to blocks by their nearest pivots, at most `block` anchors in one.
3. Before any rows are compared, each anchor learns from a bounded sample of rows a score that its answers reach at least.
   With that, a block tells for each pivot the distances d that a row needs to serve any of its anchors.
4. A row goes only to the blocks that it might serve, dealt there to units of bounded size with copies of the block's
   anchors. A unit reads its rows in batches and keeps the best few of each anchor; they are merged by anchor.

The join runs twice: first rows of the anchor's own label for its positives, then rows of other labels, whose scores must
lie in a range that follows from those of the positives. Samples only tighten bounds: every result is exact.

Cases: rows with a null label or vector, an empty vector, or a component that is null or not finite, take no part; two vectors of
different lengths have no score; a null id takes part, after all others of its score, but is no anchor (a condition on it is
null); rows of one id are not each other's positives or negatives, rows that repeat another id count each; of anchor rows with one id the
first counts, in the order of label and vector; an anchor without positives, or a positive without negatives, gives no row; an empty table gives an empty
one. Ids are whole numbers; labels have any type and may be as many as rows. Scaled components have 32 bits and scores 53, beyond
which float64 isn't exact: an error says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm.common import stash

#: Anchors that share a unit at most, and rows of a unit on average.
BLOCK, UNIT = 4096, 1 << 18
#: Components of all pivots, and of all rows of the sample, at most; both are broadcast (8 bytes each).
PIVOT_CELLS, SAMPLE_CELLS = 1 << 19, 1 << 19
#: Rows that a unit compares at a time.
STEP = 4096
#: Scores of one step, of which each takes some tens of bytes.
CELLS = 1 << 20
#: Bounds give way by this share of the largest distance, as distances are rounded.
SLACK = 1e-6
LAST = (1 << 63) - 1  # a null id comes after all others


class Index(NamedTuple):
    """Pivots of one vector length: their components, the last one added, the anchors in their cells and the groups of those."""

    pivots: np.ndarray
    extra: np.ndarray
    anchors: np.ndarray
    group: np.ndarray
    largest: int


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each vector of one length, as float64, which holds all whole numbers here."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def to_pivots(x: np.ndarray, norms: np.ndarray, own: Index, anchor: bool) -> np.ndarray:
    """Distances to all pivots. Anchors have 0 as their last component."""
    last = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(0.0, own.largest - norms))
    square = norms[:, None] - 2 * (x @ own.pivots.T) + (own.pivots**2).sum(1) + (last[:, None] - own.extra) ** 2
    return np.sqrt(np.maximum(square, 0.0))


def best(scores: np.ndarray, ids: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller ids. They come in this order."""
    order = np.lexsort((ids, -scores, groups))
    own = groups[order]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    return order[np.arange(len(own)) - begin < k]


def reach(norms: np.ndarray, scores: np.ndarray, largest: int) -> np.ndarray:
    """The distance of a row with this score."""
    return np.sqrt(np.maximum(0.0, norms + largest - 2 * scores))


class Join(NamedTuple):
    """What is looked for: `k` best rows for each anchor and limit. same: rows of the anchor's label; otherwise of others, with
    scores from least[j] to most[j] for each limit j."""

    k: int
    same: bool
    share: tuple[int, int]  # per cent of a positive's score


def limits(join: Join, positives: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of each anchor and limit, as (anchors, limits). An anchor with fewer limits has an empty range for
    the rest."""
    if join.same:
        return np.full((n, 1), -np.inf), np.full((n, 1), np.inf)
    counts = positives.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    width = int(counts.max(initial=1))
    p = np.full((n, width), np.nan)
    p[np.arange(width) < counts[:, None]] = positives.flatten().to_numpy(zero_copy_only=False)
    whole = np.nan_to_num(p).astype(np.int64)
    least, most = -(-join.share[0] * whole // 100), join.share[1] * whole // 100
    return np.where(np.isnan(p), np.inf, least), np.where(np.isnan(p), -np.inf, most)


class Anchors(NamedTuple):
    """Anchors whose scores with some rows are looked at. code: the place of each one's label among `labels`."""

    x: np.ndarray
    ids: np.ndarray
    labels: dict[str, int]
    code: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Anchors:
        labels: dict[str, int] = {}
        code = [labels.setdefault(x, len(labels)) for x in batch.column("label").to_pylist()]
        return cls(matrix(batch.column("vec")), batch.column("id").to_numpy(), labels, np.array(code, np.int64))

    def serving(self, vec: np.ndarray, ids: np.ndarray, labels: list[str], join: Join, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) where the row may serve any limit of the anchor."""
        scores = self.x @ vec.T
        code = np.array([self.labels.get(x, -1) for x in labels], np.int64)
        fits = (scores >= least.min(1)[:, None]) & (scores <= most.max(1)[:, None]) & ((self.code[:, None] == code) == join.same)
        a, c = np.nonzero(fits)
        other = self.ids[a] != ids[c]
        return a[other], c[other], scores[a[other], c[other]]


def prepared(df: DataFrame, key: str, vector: str, label: str, anchors: Column, scale: int) -> DataFrame:
    """id, label (as a string), vec, size, norm (squared) and anchor of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    usable = F.col("label").isNotNull() & F.coalesce(F.size("raw") > 0, F.lit(False)) & ~F.exists("raw", bad)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("raw"), F.coalesce(anchors, F.lit(False)).alias("anchor")).filter(usable)
    whole = F.transform("raw", lambda x: F.floor(x.cast("double") * scale).try_cast("int"))
    vec = rows.select("id", "label", whole.alias("vec"), "anchor")
    return vec.select("*", F.size("vec").alias("size"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("norm"))


def sampled(rows: DataFrame, size: int, cells: int, seed: int) -> DataFrame:
    """The first rows in the order of a hash, as many as have `cells` components together."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id", "vec"), "id").limit(max(1, cells // size))


def grouped(counts: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """A group for each pivot, so that pivots near each other share one while it has at most `most` anchors."""
    group, left, n = np.full(len(counts), -1), set(np.flatnonzero(counts).tolist()), 0
    while left:
        seed = max(left, key=lambda k: (counts[k], -k))
        total = 0
        for k in sorted(left, key=lambda j: (between[seed, j], j)):
            if total and total + counts[k] > most:
                break
            group[k], total = n, total + counts[k]
        left -= set(np.flatnonzero(group == n).tolist())
        n += 1
    return group


def in_cells(rows: DataFrame, index: Broadcast[Index], anchor: bool) -> DataFrame:
    """rows with pivot and d, and for anchors all distances in far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for whole in batches:
            for k in range(0, whole.num_rows, STEP):
                batch = whole.slice(k, STEP)
                d = to_pivots(matrix(batch.column("vec")), batch.column("norm").to_numpy(), own, anchor)
                near = d.argmin(1)
                columns = [*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])]
                names = [*batch.schema.names, "pivot", "d"]
                if anchor:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel())))
                    names.append("far")
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds + ", pivot int, d double" + (", far array<double>" if anchor else ""))


def bounded(anchors: DataFrame, sample: Broadcast[tuple], join: Join, largest: int) -> DataFrame:
    """anchors with near and wide: at each pivot, the least and greatest d of rows that may serve the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, ids, labels = sample.value
        for whole in batches:
            step = max(1, CELLS // len(vec))
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                own, norms = Anchors.of(batch), batch.column("norm").to_numpy()
                least, most = limits(join, batch.column("positives"), batch.num_rows)
                a, c, s = own.serving(vec, ids, labels, join, least, most)
                for j in range(least.shape[1]):  # what the sample has already is a bound for the whole
                    on = np.flatnonzero((s >= least[a, j]) & (s <= most[a, j]))
                    top = on[best(s[on], ids[c[on]], a[on], join.k)]
                    rows, at, n = np.unique(a[top], return_index=True, return_counts=True)
                    enough = n >= join.k
                    least[rows[enough], j] = s[top[at[enough] + join.k - 1]]
                empty = least > most
                low = np.where(empty, np.inf, least).min(1)
                high = np.where(empty, -np.inf, most).max(1)
                slack = SLACK * np.sqrt(norms + 2.0 * largest) + SLACK
                outer = np.where(low == -np.inf, np.inf, reach(norms, np.where(np.isinf(low), 0, low), largest)) + slack
                inner = np.where(high == np.inf, 0.0, reach(norms, np.where(np.isinf(high), 0, high), largest)) - slack
                none = low == np.inf
                far = matrix(batch.column("far"))
                near = np.maximum(far - outer[:, None], inner[:, None] - far)
                wide = far + outer[:, None]
                near[none], wide[none] = np.inf, -np.inf
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(v.ravel())) for v in (near, wide)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "near", "wide"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, kinds + ", near array<double>, wide array<double>")


def compared(units: DataFrame, join: Join) -> DataFrame:
    """The best of each unit: anchor, limit (which positive), score, id. A unit's anchors come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"unit": None}

        def results() -> Iterator[pa.RecordBatch]:
            if state["unit"] is not None and len(state["score"]):
                a, ids = state["a"], state["id"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(state["own"].ids[a]), pa.array(state["j"].astype(np.int32)), pa.array(state["score"].astype(np.int64)), pa.array(ids, mask=ids == LAST)], ["anchor_id", "limit", "score", "id"]
                )

        def take(part: pa.RecordBatch) -> None:
            c_id = part.column("id").fill_null(LAST).to_numpy()
            least, most = state["least"], state["most"]
            a, c, s = state["own"].serving(matrix(part.column("vec")), c_id, part.column("label").to_pylist(), join, least, most)
            got = [(state["a"], state["j"], state["score"], state["id"])]
            for j in range(least.shape[1]):
                on = np.flatnonzero((s >= least[a, j]) & (s <= most[a, j]))
                got.append((a[on], np.full(len(on), j), s[on], c_id[c[on]]))
            a, j, s, ids = (np.concatenate(x) for x in zip(*got, strict=True))
            pick = best(s, ids, a * least.shape[1] + j, join.k)
            state["a"], state["j"], state["score"], state["id"] = a[pick], j[pick], s[pick], ids[pick]
            slot = state["a"] * least.shape[1] + state["j"]
            slots, at, n = np.unique(slot, return_index=True, return_counts=True)
            full = n >= join.k
            least.ravel()[slots[full]] = state["score"][at[full] + join.k - 1]

        def begin(part: pa.RecordBatch, unit: tuple) -> None:
            least, most = limits(join, part.column("positives"), part.num_rows)
            none = np.zeros(0, np.int64)
            state.update(unit=unit, own=Anchors.of(part), least=least, most=most, a=none, j=none, score=np.zeros(0), id=none)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            names = ("block", "salt", "row")
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], 1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                unit, row = tuple(keys[lo, :2]), keys[lo, 2]
                part = batch.slice(lo, hi - lo)
                if not row:
                    if waiting and waiting[0][0] != unit:
                        waiting.clear()
                    waiting.append((unit, part))
                    continue
                if waiting and waiting[0][0] == unit:
                    yield from results()
                    whole = pa.Table.from_batches([p for _, p in waiting]).combine_chunks().to_batches()[0]
                    waiting.clear()
                    begin(whole, unit)
                if state["unit"] == unit:
                    step = max(1, CELLS // len(state["own"].ids))
                    for k in range(0, part.num_rows, step):
                        take(part.slice(k, step))
        yield from results()

    return units.mapInArrow(run, "anchor_id long, limit int, score long, id long")


def joined(anchors: DataFrame, rows: DataFrame, sample: Broadcast[tuple], index: Broadcast[Index], join: Join, total: int, block: int, unit: int) -> DataFrame:
    """anchor_id, limit, rank (from 1), score, id: the first k rows of each anchor and limit."""
    by_label = ["label"] if join.same else []
    own = bounded(anchors, sample, join, index.value.largest)
    # blocks of a group that has more anchors than one takes are told by a hash, blocks of a label by the label too
    key = F.xxhash64(*by_label, "group", "part")
    at_pivot = lambda values: F.array(*[F.lit(int(x)) for x in values])[F.col("pivot")]  # noqa: E731  they are 512 at most
    parts = -(-np.bincount(index.value.group[index.value.group >= 0], index.value.anchors[index.value.group >= 0]) // block)
    own = own.withColumns({"group": at_pivot(index.value.group), "part": F.pmod(F.xxhash64("id"), at_pivot(np.append(parts, 1)[index.value.group]))})
    own = stash(own.select("id", "label", "vec", "positives", "near", "wide", key.alias("block")), "anchors")
    at = own.select("block", *by_label, F.posexplode(F.arrays_zip("near", "wide")).alias("pivot", "at"))
    routes = at.groupBy("block", "pivot", *by_label).agg(F.min("at.near").alias("near"), F.max("at.wide").alias("wide")).filter("near <= wide")
    routes = stash(routes, "routes")
    salts = max(1, math.ceil(total / unit))
    salt = F.pmod(F.xxhash64("id", "vec"), F.lit(salts)).cast("int")
    sent = rows.join(routes, ["pivot", *by_label]).filter(F.col("d").between(F.col("near"), F.col("wide")))
    nothing = F.lit(None).cast("array<bigint>").alias("positives")
    sent = sent.select("block", salt.alias("salt"), F.lit(1).alias("row"), "id", "label", "vec", nothing)
    copies = own.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("row"), "id", "label", "vec", "positives")
    units = copies.unionByName(sent).repartition("block", "salt").sortWithinPartitions("block", "salt", "row")
    found = compared(units, join)
    order = Window.partitionBy("anchor_id", "limit").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= join.k)


def mine(
    df: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: int = 256,
    seed: int = 5,
    block: int = BLOCK,
    unit: int = UNIT,
    pivots: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Components are floor(scale * x). anchors: which
    rows are. An anchor's positives are the first rows of its label; for each, the first rows of other labels whose scores
    are `least` to `most` per cent of the positive's."""
    rows = stash(prepared(df, key, vector, label, anchors, scale), "rows")
    sizes = rows.groupBy("size").agg(F.max("norm").alias("largest"), F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.count_if(F.exists("vec", F.isnull)).alias("too_large")).collect()
    done = [of_one_size(rows, s, positives, negatives, (least, most), seed, block, unit, pivots) for s in sizes if s.anchors]
    if not done:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def of_one_size(rows: DataFrame, facts, positives: int, negatives: int, share: tuple[int, int], seed: int, block: int, unit: int, pivots: int | None) -> DataFrame:
    """The rows whose vectors have one length."""
    if facts.too_large or facts.largest > 1 << 53:
        raise ValueError("components or scores are too large to be exact")
    size, largest = facts["size"], int(facts.largest)
    spark = rows.sparkSession
    rows = rows.filter(F.col("size") == size).drop("size")
    # some units at least, so that small tables keep several tasks busy
    block, unit = min(block, max(64, math.ceil(facts.anchors / 8))), min(unit, max(1024, math.ceil(facts.n / 32)))
    count = pivots or max(1, min(512, round(math.sqrt(facts.n) / 4)))
    chosen = sampled(rows, size, min(PIVOT_CELLS, count * size), seed).select("vec", "norm").collect()
    points = np.array([r.vec for r in chosen]).reshape(-1, size)
    extra = np.sqrt(np.maximum(0.0, largest - np.array([r.norm for r in chosen])))
    points, unique = np.unique(points, axis=0, return_index=True)
    extra = extra[unique]
    first = spark.sparkContext.broadcast(Index(points, extra, np.zeros(len(points), int), np.zeros(len(points), int), largest))
    one = rows.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "vec", "norm")).alias("first")).select("id", "first.*")
    own = stash(in_cells(one, first, True), "anchors")
    counts = np.zeros(len(points), int)
    for r in own.groupBy("pivot").agg(F.count("*").alias("n")).collect():
        counts[r.pivot] = r.n
    between = np.stack([((points - p) ** 2).sum(1) for p in points])
    index = spark.sparkContext.broadcast(Index(points, extra, counts, grouped(counts, between, block), largest))
    celled = stash(in_cells(rows.drop("anchor"), first, False).drop("norm"), "cells")
    some = sampled(rows, size, SAMPLE_CELLS, seed + 1).select("id", "label", "vec").collect()
    taken = (np.array([r.vec for r in some]).reshape(-1, size), np.array([LAST if r.id is None else r.id for r in some], np.int64), [r.label for r in some])
    sample = spark.sparkContext.broadcast(taken)
    own = own.withColumn("positives", F.lit(None).cast("array<bigint>"))
    near = stash(joined(own, celled, sample, index, Join(positives, True, (0, 0)), facts.n, block, unit), "positives")
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    own = own.drop("positives").join(lists, F.col("id") == F.col("anchor_id"))
    own = stash(own.withColumn("positives", F.transform("p", lambda x: x["score"])).drop("p", "anchor_id"), "anchors")
    hard = joined(own, celled, sample, index, Join(negatives, False, share), facts.n, block, unit)
    names = near.select("anchor_id", (F.col("rank") - 1).alias("limit"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(names, ["anchor_id", "limit"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
