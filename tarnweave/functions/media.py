"""Audio as arrays: conversions and chunks, in column functions."""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAK = 32767
SPEECH_RATE = 24_000
LISTEN_RATE = 16_000


def to_int16(samples: Column) -> Column:
    """Samples in -1 to 1 as 16-bit integers, cut toward zero; louder ones are clipped."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * PEAK).cast("smallint"))


def to_float(samples: Column, peak: int = PEAK) -> Column:
    return F.transform(samples, lambda x: x.cast("double") / peak)


def chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of `size`; the last one may be shorter. An empty array has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda i: F.slice(values, i + 1, size))
    return F.when(F.size(values) > 0, cut).otherwise(F.slice(cut, 1, 0))


def byte_chunks(data: Column, size: int) -> Column:
    """Binary cut into pieces of `size` bytes, the last one perhaps shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda i: F.substring(data, i + 1, F.lit(size)))
    return F.when(F.octet_length(data) > 0, cut).otherwise(F.slice(cut, 1, 0))


def first_channel(frames: Column) -> Column:
    return F.transform(frames, lambda x: x[0])


def flat(chunked: DataFrame, by: str, order: str, values: str) -> DataFrame:
    """(by, values): the groups' arrays put together in their order."""
    parts = F.sort_array(F.collect_list(F.struct(order, values)))
    return chunked.groupBy(by).agg(F.flatten(F.transform(parts, lambda x: x[values])).alias(values))


def aligned(df: DataFrame, by: str, order: str, data: str) -> DataFrame:
    """df with `aligned`: chunks of whole 16-bit samples. An odd byte opens the next chunk; the very last one is dropped."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.octet_length(data)).over(before), F.lit(0)) % 2 == 1
    last = F.last(F.when(F.octet_length(data) > 0, F.col(data)), ignorenulls=True).over(before)
    whole = F.concat(F.when(odd, F.substring(last, F.octet_length(last), F.lit(1))).otherwise(F.lit(b"")), F.col(data))
    return df.withColumn("_w", whole).withColumn("aligned", F.substring("_w", F.lit(1), F.octet_length("_w") - F.octet_length("_w") % 2)).drop("_w")


def sweep(first: float, last: float, seconds: float, rate: int = LISTEN_RATE, loud: float = 0.3) -> Column:
    """A tone that glides, with ramps over a tenth at both ends: the phase is the sum of the frequencies so far."""
    n = int(seconds * rate)
    if n <= 0:
        return F.array().cast("array<double>")
    step = (last - first) / max(1, n - 1)
    ramp = max(1, n // 10)

    def value(i: Column) -> Column:
        phase = (i + 1) * first + step * i * (i + 1) / 2
        edge = F.least(F.lit(1.0), (i / ramp), (F.lit(n - 1) - i) / ramp)
        return loud * F.sin(2 * math.pi * phase / rate) * edge

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: value(i.cast("double")))


def resampled(samples: Column, rate: int, to: int = LISTEN_RATE) -> Column:
    """Linear interpolation at the new rate: ceil(n * to / rate) samples."""
    n = F.ceil(F.size(samples) * F.lit(to) / F.lit(rate)).cast("int")

    def value(i: Column) -> Column:
        x = F.least(i * (rate / to), (F.size(samples) - 1).cast("double"))
        a = F.floor(x).cast("int")
        b = F.least(a + 1, F.size(samples) - 1)
        low, high = F.get(samples, a).cast("double"), F.get(samples, b).cast("double")
        return low + (high - low) * (x - a)

    return F.when(F.size(samples) == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: value(i.cast("double"))))


def schedule(df: DataFrame, by: str, order: str, arrived: str, duration: str, buffer: float = 0.05) -> DataFrame:
    """(by, order, begins): a chunk plays when the one before ends, or, if that has passed, `buffer` seconds after it
    arrives. Each step needs the one before, so an utterance is played in one task; its chunks stream through in their order, and
    only the last end is kept. A chunk without a time or length doesn't play."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, upto = None, -1.0
        for batch in batches:
            begins = []
            for key, at, length in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if (key,) != now:
                    now, upto = (key,), -1.0
                if at is None or length is None:
                    begins.append(None)
                    continue
                begins.append(upto if upto >= at else at + buffer)
                upto = begins[-1] + length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.float64())], [by, order, "begins"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ordered = df.select(by, order, arrived, duration).repartition(by).sortWithinPartitions(by, order)
    return ordered.mapInArrow(play, f"{by} {kinds[by]}, {order} {kinds[order]}, begins double")


def decode_wav(files: DataFrame, content: str = "content") -> DataFrame:
    """files with rate and samples (first channel, 16-bit or float WAV); bytes that are no WAV give nulls."""

    def one(data: bytes | None) -> tuple[int | None, list[float] | None]:
        try:
            if data is None or data[:4] != b"RIFF":
                return None, None
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, data.index(b"fmt ") + 8)
            begin = data.index(b"data")
            body = data[begin + 8 : begin + 8 + struct.unpack_from("<I", data, begin + 4)[0]]
            if (kind, bits) == (3, 32):
                x = np.frombuffer(body, "<f4").astype(float)
            elif (kind, bits) == (1, 16):
                x = np.frombuffer(body, "<i2") / (PEAK + 1)
            else:
                return None, None
            return rate, x[::channels].tolist()
        except (ValueError, struct.error):
            return None, None

    @F.pandas_udf("rate int, samples array<double>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=["rate", "samples"])

    return files.withColumn("_wav", decode(content)).select("*", "_wav.rate", "_wav.samples").drop("_wav")


def encode_wav(samples: np.ndarray, rate: int = LISTEN_RATE, floating: bool = False) -> bytes:
    """Mono WAV of 16-bit samples, or of 32-bit floats, which keep what is beyond full scale."""
    if floating:
        body = np.asarray(samples, "<f4").tobytes()
        form = struct.pack("<4sIHHIIHHH", b"fmt ", 18, 3, 1, rate, 4 * rate, 4, 32, 0) + struct.pack("<4sII", b"fact", 4, len(samples))
        return struct.pack("<4sI4s", b"RIFF", 12 + len(form) + len(body), b"WAVE") + form + struct.pack("<4sI", b"data", len(body)) + body
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * PEAK).astype("<i2").tobytes())
    return out.getvalue()


def wav(samples: Column, rate: int = LISTEN_RATE, floating: bool = False) -> Column:
    """Arrays of samples as WAV files. Null and NaN samples are silence; a null array gives null."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else encode_wav(np.nan_to_num(np.array(x, float), posinf=1, neginf=-1), rate, floating) for x in batch], dtype=object)

    return encode(samples.cast("array<double>"))
