"""Count-min sketches of 64-bit keys, made in the partitions and merged by ranges of cells.

A sketch has two rows of cells; a key adds to one cell in each. Counts end at 2. The merged sketch says of a key
whether it may have been added `least` (1 or 2) times: it overestimates, and never underestimates. It is a bitmap of
2 * 2**bits bits, with bits at most `MOST_BITS`, so it may be broadcast. With far more keys than cells it still loses
none, but keeps too many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tarnweave.llm.winnow import scatter

#: 2 * 2**27 bits are 32 MB.
LEAST_BITS, MOST_BITS = 16, 27
#: Ranges of cells that are merged apart.
SHARDS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bits_for(keys: float) -> int:
    """For about so many different keys: eight cells each, where the bound allows."""
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1.0, 8 * keys))))))


def cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    down = np.uint64(64 - bits)
    return keys >> down, scatter(keys * _ODD) >> down


class Sketch:
    """A merged sketch."""

    def __init__(self, bitmaps: list[np.ndarray], bits: int):
        self.bitmaps, self.bits = bitmaps, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may have been added `least` times."""
        out = np.ones(len(keys), bool)
        for bitmap, at in zip(self.bitmaps, cells(keys, self.bits)):
            out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def build(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int) -> Broadcast:
    """The broadcast sketch of the keys (uint64, well mixed) that `keys` finds in df's batches."""
    width = 1 << (bits - SHARDS.bit_length() + 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list] = ([], [])

        def reduced(own: list[np.ndarray]) -> np.ndarray:
            """Sorted cells, each twice at most."""
            at = np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint32)
            if least == 1:
                return at[np.append(True, at[1:] != at[:-1])] if len(at) else at
            return at[np.append([True, True], at[2:] != at[:-2])] if len(at) > 2 else at

        waiting = 0
        for batch in batches:
            for got in keys(batch):
                for own, at in zip(found, cells(got, bits)):
                    own.append(at.astype(np.uint32))
                waiting += len(got)
            if waiting > 1 << 22:
                found = tuple([reduced(own)] for own in found)
                waiting = 0
        rows: dict[str, list] = {"row": [], "shard": [], "cells": []}
        for k, own in enumerate(found):
            at = reduced(own)
            edges = np.searchsorted(at, np.arange(SHARDS + 1, dtype=np.uint64) * np.uint64(width))
            for s in range(SHARDS):
                inside = at[edges[s] : edges[s + 1]] - np.uint32(s * width)
                if len(inside):
                    rows["row"].append(k)
                    rows["shard"].append(s)
                    rows["cells"].append(zstandard.compress(np.diff(inside, prepend=np.uint32(0)).astype("<u4").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(rows["row"], pa.int32()), pa.array(rows["shard"], pa.int32()), pa.array(rows["cells"], pa.binary())], list(rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def done() -> pa.RecordBatch:
            bitmap = np.packbits(count >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bitmap], pa.binary())], ["row", "shard", "bitmap"])

        for batch in batches:
            for row, shard, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (row, shard) != now:
                    if now:
                        yield done()
                    now, count = (row, shard), np.zeros(width, np.uint8)
                at = np.cumsum(np.frombuffer(zstandard.decompress(packed), "<u4").astype(np.int64))
                fresh = at[np.append(True, at[1:] != at[:-1])]
                count[fresh] = np.minimum(count[fresh] + 1, 2)
                if least > 1:
                    count[at[1:][at[1:] == at[:-1]]] = 2
        if now:
            yield done()

    parts = df.mapInArrow(part, "row int, shard int, cells binary").repartition("row", "shard").sortWithinPartitions("row", "shard")
    bitmaps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for row, shard, bitmap in parts.mapInArrow(merge, "row int, shard int, bitmap binary").toLocalIterator():
        bitmaps[row][shard * width // 8 : (shard + 1) * width // 8] = np.frombuffer(bitmap, np.uint8)
    return df.sparkSession.sparkContext.broadcast(Sketch(bitmaps, bits))
