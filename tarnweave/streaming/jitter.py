"""A buffer for chunks of sound that arrive out of order, in any batches: it gives them in order, as whole samples, with the
times at which they play.

State of an utterance: which chunk is next, when the sound so far ends, the odd byte left over, and the chunks that came too
early. A chunk is given as soon as all before it were. Where one is missing for `wait_ms`, the buffer goes on behind the gap; what
comes from the gap later is given as late, without a time. The state goes when the chunk marked as last was given, or after
`idle_ms` without any chunk.

The state store must keep several state variables and timers: set spark.sql.streaming.stateStore.providerClass to
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider before the query starts. Waits end in the batch that comes
after them. Batches without data see to that under a processing-time trigger; under availableNow they would go on for
ever, so turn spark.sql.streaming.noDataMicroBatches.enabled off there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: utt_id, seq (from 0), pcm (bytes), at (seconds of arrival), seconds (length), last (whether no chunk follows).
CHUNK = "utt_id string, seq long, pcm binary, at double, seconds double, last boolean"
GIVEN = "utt_id string, seq long, pcm binary, begins double, late boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Buffer(StatefulProcessor):
    def __init__(self, buffer: float, width: int, wait_ms: int, idle_ms: int):
        self.buffer, self.width, self.wait_ms, self.idle_ms = buffer, width, wait_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "next long, upto double, rest binary, timer long, gap long")
        self.early = handle.getMapState("early", "seq long", "pcm binary, at double, seconds double, last boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = list(self.now.get()) if self.now.exists() else [0, -1.0, b"", 0, -1]
        out: list[tuple] = []
        for batch in rows:
            for seq, pcm, at, seconds, last in batch[["seq", "pcm", "at", "seconds", "last"]].itertuples(index=False):
                if seq < state[0]:
                    out.append((key[0], int(seq), bytes(pcm or b""), None, True))
                elif not self.early.containsKey((int(seq),)):  # a chunk that comes twice plays once
                    self.early.updateValue((int(seq),), (bytes(pcm or b""), float(at), float(seconds), bool(last)))
        over = self._play(key, state, out)
        self._go_on(state, over, timerValues)
        yield self._rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.now.exists():
            return
        state, out, over = list(self.now.get()), [], False
        waiting = sorted(k[0] for k in self.early.keys())
        if not waiting:
            self.now.clear()  # nothing came for a long time
            return
        if state[4] == state[0]:  # the same chunk is missing as when the timer was set
            state[0] = waiting[0]
            over = self._play(key, state, out)
        state[3] = 0
        self._go_on(state, over, timerValues)
        yield self._rows(out)

    def _play(self, key: Any, state: list, out: list[tuple]) -> bool:
        """Gives what is next, as far as it is there; whether the last chunk was."""
        while self.early.containsKey((state[0],)):
            pcm, at, seconds, last = self.early.getValue((state[0],))
            self.early.removeKey((state[0],))
            begins = state[1] if state[1] >= at else at + self.buffer
            whole = bytes(state[2]) + bytes(pcm)
            cut = len(whole) - len(whole) % self.width
            out.append((key[0], state[0], whole[:cut], begins, False))
            state[:3] = [state[0] + 1, begins + seconds, whole[cut:]]
            if last:
                return True
        return False

    def _go_on(self, state: list, over: bool, timerValues: Any) -> None:
        if over:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.early.clear()
            # what still comes is late; the state goes after a while
            state[3], state[4] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms, -1
            self.handle.registerTimer(state[3])
        elif not state[3] or state[4] != state[0]:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            missing = next(iter(self.early.keys()), None) is not None
            state[3], state[4] = timerValues.getCurrentProcessingTimeInMs() + (self.wait_ms if missing else self.idle_ms), state[0] if missing else -1
            self.handle.registerTimer(state[3])
        self.now.update(tuple(state))

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["utt_id", "seq", "pcm", "begins", "late"])

    def close(self) -> None:
        pass


def played(stream: DataFrame, buffer: float = 0.05, width: int = 2, wait_ms: int = 2_000, idle_ms: int = 60_000) -> DataFrame:
    """Chunks (columns as CHUNK) in order, as GIVEN: a chunk plays when the one before ends, or, if that has passed, `buffer`
    seconds after it arrived; samples of `width` bytes stay whole. A chunk without an utterance, a number, a time or a length isn't one."""
    whole = stream.filter("utt_id IS NOT NULL AND seq >= 0 AND at IS NOT NULL AND seconds IS NOT NULL")
    rows = whole.select("utt_id", "seq", "pcm", "at", "seconds", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("utt_id").transformWithStateInPandas(Buffer(buffer, width, wait_ms, idle_ms), GIVEN, "append", "processingTime")
