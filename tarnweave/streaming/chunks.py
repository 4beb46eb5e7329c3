"""Streams of byte chunks: whole samples from chunks of any length, with the odd bytes carried over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def aligned(stream: DataFrame, by: str = "utt_id", order: str = "seq", data: str = "pcm", width: int = 2, idle_ms: int = 60_000) -> DataFrame:
    """(by, seq, pcm): chunks of whole samples of each utterance, in the order of arrival and `order`. What is left over is
    kept in the state, which goes `idle_ms` after the last chunk."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left = bytes(state.get[0]) if state.exists else b""
        out = []
        for seq, piece in pd.concat(list(batches)).sort_values(order)[[order, data]].itertuples(index=False):
            whole = left + bytes(piece or b"")
            cut = len(whole) - len(whole) % width
            left = whole[cut:]
            if cut:
                out.append((key[0], seq, whole[:cut]))
        state.update((left,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[by, order, data])

    key = stream.schema[by].dataType.simpleString()
    return stream.select(by, order, data).groupBy(by).applyInPandasWithState(
        step, f"{by} {key}, {order} long, {data} binary", "left binary", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def windowed(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts of events by kind in windows of event time; events later than `late` are left out."""
    from pyspark.sql import functions as F

    return events.withWatermark(ts, late).groupBy(F.window(ts, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
