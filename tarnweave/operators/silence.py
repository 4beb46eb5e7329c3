"""Silence left out of recordings: energy of frames, two thresholds, and least lengths of gaps and of speech.

A recording comes as chunks of samples of any length; frames run across them. A frame at or above `high` is speech, one below `low`
is silence, one between them is what the frame before is; before the first that is either, it is silent. Speech that less than
`least_gap` silent frames part is one segment, and segments of less than `least_speech` frames are silence.

No recording has to fit a task: chunks are dealt by ranges of (recording, order), frames by blocks, and what goes over the whole of a
recording is one row for a range, and one for a run of frames that are alike.

Chunks without a recording or an order take no part; null and empty ones hold no samples. A null sample, or one that is no
number, is zero. Chunks of the same order follow one another by their samples, so reruns agree. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.sources.shared import stash


@dataclass(frozen=True)
class Gate:
    """size: samples a frame. high, low: mean squares. least_speech, least_gap: frames."""

    size: int = 480
    high: float = 0.0009
    low: float = 0.0004
    least_speech: int = 3
    least_gap: int = 10

    def __post_init__(self) -> None:
        if self.size < 1 or self.least_speech < 1 or self.least_gap < 1 or not 0 <= self.low <= self.high:
            raise ValueError("frames and lengths are 1 or more, and low is no higher than high")


#: Frames of a block.
BLOCK = 4096


def _before(*by: str, order: tuple[str, ...]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def placed(chunks: DataFrame, by: str, order: str, samples: str) -> DataFrame:
    """(recording, place, samples, start, n): where each chunk's first sample lies in its recording, and how many it has."""
    clean = F.transform(samples, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    mine = chunks.select(F.col(by).alias("recording"), F.col(order).alias("place"), clean.alias("samples"))
    mine = mine.filter("recording IS NOT NULL AND place IS NOT NULL AND size(samples) > 0").withColumn("n", F.size("samples").cast("bigint"))
    ranges = stash(mine.repartitionByRange("recording", "place", "samples").withColumn("range", F.spark_partition_id()), "chunks")
    sums = ranges.groupBy("recording", "range").agg(F.sum("n").alias("total"))
    sums = sums.select("recording", "range", F.coalesce(F.sum("total").over(_before("recording", order=("range",))), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n").over(_before("recording", "range", order=("place", "samples"))), F.lit(0))
    at = ranges.withColumn("inside", inside).join(sums, ["recording", "range"])
    return at.select("recording", "place", "samples", (F.col("earlier") + F.col("inside")).alias("start"), "n")


def frames(chunks: DataFrame, size: int) -> DataFrame:
    """(recording, frame, energy): the mean square of each frame of placed chunks. The last frame may be shorter."""
    start, end = F.col("start"), F.col("start") + F.col("n")

    def piece(frame: Column) -> Column:
        first, last = F.greatest(frame * size, start), F.least((frame + 1) * size, end)
        part = F.slice("samples", (first - start + 1).cast("int"), (last - first).cast("int"))
        return F.struct(frame.alias("frame"), F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x).alias("power"), (last - first).alias("length"))

    touched = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
    pieces = chunks.select("recording", F.inline(F.transform(touched, piece)))
    return pieces.groupBy("recording", "frame").agg((F.sum("power") / F.sum("length")).alias("energy"))


def speech(energies: DataFrame, gate: Gate) -> DataFrame:
    """(recording, first_frame, n_frames): the segments of speech."""
    mark = F.when(F.col("energy") >= gate.high, True).when(F.col("energy") < gate.low, False)
    block = Window.partitionBy("recording", "block").orderBy("frame")
    blocks = energies.withColumn("block", F.floor(F.col("frame") / BLOCK)).withColumn("state", F.last(mark, ignorenulls=True).over(block))
    change = F.when(F.col("state").eqNullSafe(F.lag("state").over(block)), 0).otherwise(1)
    runs = blocks.withColumn("change", change).withColumn("run", F.sum("change").over(block))
    runs = runs.groupBy("recording", "block", "run").agg(F.max("state").alias("state"), F.min("frame").alias("begin"), (F.max("frame") + 1).alias("end"))
    whole = Window.partitionBy("recording").orderBy("begin")
    loud = runs.withColumn("loud", F.coalesce(F.last("state", ignorenulls=True).over(whole), F.lit(False))).filter("loud")
    near = F.col("begin") - F.lag("end").over(whole) < gate.least_gap
    segments = loud.withColumn("opens", F.when(near, 0).otherwise(1)).withColumn("segment", F.sum("opens").over(whole))
    segments = segments.groupBy("recording", "segment").agg(F.min("begin").alias("first_frame"), (F.max("end") - F.min("begin")).alias("n_frames"))
    return segments.filter(F.col("n_frames") >= gate.least_speech).select("recording", "first_frame", "n_frames")


def segments(chunks: DataFrame, by: str, order: str, samples: str, gate: Gate = Gate()) -> DataFrame:
    """(by, first_frame, n_frames): the segments of speech of each recording."""
    return speech(frames(placed(chunks, by, order, samples), gate.size), gate).withColumnRenamed("recording", by)


def without_silence(chunks: DataFrame, by: str, order: str, samples: str, gate: Gate = Gate()) -> DataFrame:
    """(by, order, start, samples): the chunks without their silent samples. A chunk that is cut gives a row for each piece that is
    left; start is its place in the recording as it was."""
    at = stash(placed(chunks, by, order, samples), "placed")
    found = speech(frames(at, gate.size), gate)
    first, last = F.col("first_frame"), F.col("first_frame") + F.col("n_frames")
    dealt = found.select("recording", F.explode(F.sequence(F.floor(first / BLOCK), F.floor((last - 1) / BLOCK))).alias("block"), first.alias("first"), last.alias("last"))
    bounds = F.struct((F.greatest("first", F.col("block") * BLOCK) * gate.size).alias("first"), (F.least("last", (F.col("block") + 1) * BLOCK) * gate.size).alias("last"))
    dealt = dealt.groupBy("recording", "block").agg(F.collect_list(bounds).alias("spans"))
    begin, end = F.col("start"), F.col("start") + F.col("n")
    wide = BLOCK * gate.size
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(begin / wide), F.floor((end - 1) / wide)))).join(dealt, ["recording", "block"])
    cut = F.filter("spans", lambda s: (s["first"] < end) & (s["last"] > begin))

    def left(s: Column) -> Column:
        a, b = F.greatest(s["first"], begin), F.least(s["last"], end)
        return F.struct(a.alias("start"), F.slice("samples", (a - begin + 1).cast("int"), (b - a).cast("int")).alias("samples"))

    return pieces.select("recording", "place", F.inline(F.transform(cut, left))).toDF(by, order, "start", samples)
