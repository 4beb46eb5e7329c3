"""Fill-in-middle transformation: texts with a middle moved to their end, so that a model learns to fill gaps.

A text is a numpy array of code points (UTF-32). Runs of ASCII letters are tokens, and so is every other code point: where
two neighbours are both letters there is no boundary, everywhere else there is one. A hash of the seed and the id draws two
boundaries, between which the middle lies, and the form:

    plain: the text     psm: <P>prefix<S>suffix<M>middle     spm: <S>suffix<P>prefix<M>middle

The work is a narrow pass without a shuffle; it holds a block of about two megabytes of texts, or one longer text.

Cases: a null text is an empty one, whose form is plain; a text that holds a marker is plain, so that the others can be
taken apart again; a null id draws from the seed alone; repeated rows draw alike; ids of any type draw by their string; an
input column named like an output column (in any letter case) is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.llm.common import blocks, spare

#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, SPM = 10, 20  # per cent of all texts that stay plain, and of the others that have the suffix first
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


class Cut(NamedTuple):
    """n: tokens of the text. The characters of prefix and middle are None where the form is plain."""

    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: bytes


def edges(codes: np.ndarray) -> np.ndarray:
    """Where the tokens of code points begin, and where the last one ends."""
    letter = (codes | 32) - np.uint32(97) < 26  # upper and lower case differ by one bit
    apart = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([np.zeros(min(1, len(codes)), np.int64), apart, [len(codes)]])


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, key: str, seed: int = 1, plain: int = PLAIN, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> Cut:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = edges(codes)
    n = len(at) - 1
    a, b, c, d = draws(seed, key)
    if not text or c % 100 >= 100 - plain or any(m in text for m in markers):
        return Cut(n, "plain", None, None, text.encode())
    first, last = sorted((int(at[a % (n + 1)]), int(at[b % (n + 1)])))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le").encode() for x in np.split(codes, (first, last)))
    p, s, m = (x.encode() for x in markers)
    if d % 100 < spm:
        return Cut(n, "spm", first, last - first, b"".join((s, suffix, p, prefix, m, middle)))
    return Cut(n, "psm", first, last - first, b"".join((p, prefix, s, suffix, m, middle)))


def transform(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    plain: int = PLAIN,
    spm: int = SPM,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """df with n (tokens), form, prefix_chars, middle_chars (null if plain) and output. Of the markers, none may hold the
    first character of another one, or its own a second time: so no text beside them can look like one."""
    firsts = [m[:1] for m in markers]
    if len(set(markers)) < 3 or not all(firsts) or any(f in m[1:] for f in firsts for m in markers):
        raise ValueError(f"markers that can't be told from what is beside them: {markers}")
    made = T.StructType.fromDDL(_MADE)
    kept = [f for f in df.schema if f.name.lower() not in made.names]
    key, own = spare(df, "_key", "_whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, own):
            keys = rows.column(key).to_pylist()
            whole = data.tobytes()
            got = [cut(whole[at[k] : at[k + 1]].decode(), x, seed, plain, spm, markers) for k, x in enumerate(keys)]
            columns = [
                pa.array([x.n for x in got], pa.int64()),
                pa.array([x.form for x in got], pa.string()),
                pa.array([x.prefix for x in got], pa.int64()),
                pa.array([x.middle for x in got], pa.int64()),
                pa.array([x.output for x in got], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *columns], [*(f.name for f in kept), *made.names])

    helpers = (F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias(key), F.coalesce(F.col(text), F.lit("")).alias(own))
    return df.select(*[f"`{f.name}`" for f in kept], *helpers).mapInArrow(run, T.StructType([*kept, *made.fields]))


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of transform() was made of."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    back = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.coalesce(back, output)
