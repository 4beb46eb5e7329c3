"""What several operators share: shared-folder tables, words, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.sources.shared import FILE_CLEANUP, clear_stashed, shared_dir, shuffles_once, stash, stash_dir  # noqa: F401 (operators take them from here)

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Text bytes that one vectorised step handles; a longer text is a step of its own.
BLOCK_BYTES = 1 << 21


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, most: int = 100_000) -> DataFrame:
    """left joined with right on `key`, which is unique in right; n: how many rows of left have it. Rows of a key with more
    than `most` are dealt to salts, so no key is one task's; the keys that are so hot are few, one for `most` rows at most."""
    salts = F.ceil(F.col(n) / most).cast("int")
    hot = right.filter(F.col(n) > most).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    dealt = left.join(hot, left[key] == hot["_hot"], "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")))).drop("_hot", "_salts")
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.greatest(salts, F.lit(1)) - 1).cast("long"))))
    return dealt.withColumn("_salt", F.col("_salt").cast("long")).join(every, [key, "_salt"]).drop("_salt")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z only, as other cases differ between engines."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each value begins and the last ends; nulls are empty."""
    kind = column.type
    column = column.cast(pa.large_binary() if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else pa.large_string())
    column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `most` text bytes, with their bytes and offsets. Every row comes once; texts stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = raw(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives the memory that was freed back to the system, which allocators don't do by themselves: a Python worker lives
    on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:  # glibc has it
        _TRIM(0)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files that no plan can read any more go at the next collection of the driver's JVM; this asks for one."""
    gc.collect()  # Python's own references to plans
    time.sleep(0.5)  # a thread of py4j's lets go of the JVM's
    spark.sparkContext._jvm.System.gc()


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte of every word of the texts, and the index of its text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    change = inside[1:] & ~inside[:-1]  # at i: a word begins at byte i
    over = inside[:-1] & ~inside[1:]
    edges = at[1:-1]
    cut = edges[inside[edges] & inside[edges + 1]]  # two texts that touch
    change[cut] = True
    over[cut] = True
    starts, ends = np.flatnonzero(change), np.flatnonzero(over)
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
