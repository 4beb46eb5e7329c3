"""SimHash near-dedup by deletion-variant signatures.

A fingerprint's bit is 1 if it is set in over half of the document's shingle hashes. Fingerprints within `near` bits
are linked: 64 bits are cut into so few segments that one of them differs by at most one bit, and every segment is
indexed once for each of its bits, with that bit deleted. Equal variants meet in a bucket, where the distance over all
64 bits is verified. A pair counts only in the first segment's variant that it shares. A full bucket of different
fingerprints is cut again by the same rule, on the bits that are left, so buckets stay small however many there are.

Equal fingerprints are one row from the start, and a bucket gives each row's link to the least one of its group
there, never all pairs.

Cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any other; a text with fewer
words than a shingle is one shingle; repeated rows and repeated ids keep their rows; a null id takes part but is never
the component id (null if a component has no other); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm import buckets
from tarnweave.llm.common import join_hot, stash
from tarnweave.llm.components import components
from tarnweave.llm.winnow import scatter

SEED = 42
#: Shingles whose bits are counted in one step.
STEP = 1 << 16


def shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    whole, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(whole, SEED)]
    starts = [0, *(e + 1 for e in ends[: len(ends) - width])]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype("<u8", copy=False)
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprint(text: str | None, width: int) -> int:
    hashes = np.array(shingle_hashes(text, width), np.uint64)
    return int(np.packbits(2 * bits_set(hashes) > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


_FACTORS = scatter(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def several(hashes: np.ndarray, n: int) -> np.ndarray:
    """n fingerprints of the same shingles: by their hashes as they are, and by these mixed with other factors."""
    total = np.zeros(64 * n, np.int64)
    for i in range(0, len(hashes), 255):  # so many bits a byte can count
        own = hashes[i : i + 255]
        mixed = np.empty((len(own), n), "<u8")
        mixed[:, 0] = own
        mixed[:, 1:] = scatter(own[:, None] * _FACTORS[: n - 1])
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp): fp a long with the fingerprint's 64 bits. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [key, "fp"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


def segments(near: int) -> list[int]:
    """Masks of the segments: the fewest of which one has at most one of `near` wrong bits."""
    n = near // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]


def first_key(diff: np.ndarray, masks: list[int]) -> np.ndarray:
    """Of the pairs with these differing bits, the number (0 to 63) of the first variant that they share."""
    out = np.full(len(diff), -1, np.int64)
    for mask in reversed(masks):
        inside = diff & np.uint64(mask)
        wrong = np.bitwise_count(inside)
        lowest = (mask & -mask).bit_length() - 1
        place = np.bitwise_count(np.where(wrong == 1, inside, np.uint64(1)) - np.uint64(1))
        out = np.where(wrong == 0, lowest, np.where(wrong == 1, place, out))
    return out


def deletions(bits: list[int], near: int) -> dict[int, int]:
    """For each of these bits, the mask of its segment without it; of the segments, the fewest that can be, one has at
    most one of `near` wrong bits."""
    n = near // 2 + 1
    cuts = [len(bits) * i // n for i in range(n + 1)]
    parts = [bits[x:y] for x, y in zip(cuts, cuts[1:])]
    return {b: sum(1 << x for x in part if x != b) for part in parts for b in part}


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cut_again(rows: DataFrame, masks: list[int], near: int, most: int) -> DataFrame:
    """rows (fp, bit, rest) with sub and more, which part the rows of full buckets: fingerprints that meet in a bucket
    differ by at most `near` of the bits outside its segment, so these are cut into segments again, with a variant for
    each deleted bit. Buckets whose rows mostly agree outside, too, are groups of near copies, which no cut would part:
    they stay whole, as do those that aren't full (sub -1)."""
    outside = [[b for b in range(64) if not m >> b & 1] for m in masks]
    again = [deletions(own, near) for own in outside]
    flat = F.array(*[F.lit(signed(own.get(b, 0))) for own in again for b in range(64)])
    first = F.array(*[F.lit(signed(own[bits[0]])) for own, bits in zip(again, outside)])
    nth = F.element_at(F.array(*[F.lit(next(i for i, m in enumerate(masks) if m >> b & 1)) for b in range(64)]), F.col("bit") + 1)
    full = stash(rows.groupBy("bit", "rest").agg(F.count("*").alias("_n")).filter(F.col("_n") > most), "full")
    inside = rows.join(full, ["bit", "rest"]).groupBy("bit", "rest", F.col("fp").bitwiseAND(F.element_at(first, nth + 1)).alias("_m")).agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    apart = stash(inside.groupBy("bit", "rest").agg(F.max("_k").alias("_k"), F.first("_n").alias("_n")).filter("8 * _k < _n").select("bit", "rest", F.lit(True).alias("_cut")), "apart")
    variants = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.element_at(flat, nth * 64 + b + 1) != 0)
    out = rows.join(apart, ["bit", "rest"], "left").withColumn("sub", F.explode(F.when(F.col("_cut"), variants).otherwise(F.array(F.lit(-1)))))
    more = F.when(F.col("sub") < 0, F.lit(0).cast("long")).otherwise(F.col("fp").bitwiseAND(F.element_at(flat, nth * 64 + F.greatest("sub", F.lit(0)) + 1)))
    return out.select("fp", "bit", "rest", "sub", more.alias("more"))


BUCKET = ("bit", "rest", "sub", "more")


def links(prints: DataFrame, near: int = 4, most: int = buckets.MOST) -> DataFrame:
    """(a, b): pairs of different values of `fp` that join what all links within `near` bits join."""
    masks = segments(near)
    whole = [next(m for m in masks if m >> b & 1) & ~(1 << b) for b in range(64)]
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    rows = rows.withColumn("rest", F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)) for m in whole]), F.col("bit") + 1)))
    rows = cut_again(rows, masks, near, most)

    def linked(fp: np.ndarray, bit: np.ndarray, chunk: np.ndarray, cross: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        diff = fp[a] ^ fp[b]
        ok = np.flatnonzero(np.bitwise_count(diff) <= near)
        ok = ok[(chunk[a[ok]] != chunk[b[ok]]) | ~cross[a[ok]]]
        return ok[first_key(diff[ok], masks) == bit[a[ok]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in buckets.whole_units(batches, BUCKET):
            fp = table.column("fp").to_numpy().view(np.uint64)
            bit, chunk = table.column("bit").to_numpy(), table.column("_c").to_numpy()
            cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
            label = np.arange(len(fp))
            for a, b in buckets.small_pairs(at, 48):
                ok = linked(fp, bit, chunk, cross, a, b)
                buckets.merge_labels(label, a[ok], b[ok])
            for k in np.flatnonzero(np.diff(at) > 48):
                lo, hi = at[k], at[k + 1]

                def close(i: int, j: int, lo: int = lo, hi: int = hi) -> tuple[np.ndarray, np.ndarray]:
                    a, b = np.nonzero(np.bitwise_count(fp[lo + i : lo + j, None] ^ fp[None, lo + i : hi]) <= near)
                    a, b = a[a < b] + i, b[a < b] + i
                    ok = linked(fp, bit, chunk, cross, a + lo, b + lo)
                    return a[ok], b[ok]

                label[lo:hi] = lo + buckets.joined(hi - lo, close)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in buckets.stars(fp.view(np.int64), label)], ["a", "b"])

    return buckets.units(rows, BUCKET, "fp", most).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, near: int = 4, most: int = buckets.MOST) -> DataFrame:
    """One row per document: key, fp and component_id, the least key that links lead to."""
    prints = stash(fingerprints(df, key, text, width), "fingerprints")
    firsts = stash(prints.groupBy("fp").agg(F.min(key).alias("_first"), F.count("*").alias("_n")), "prints")
    roots = components(links(firsts.select("fp"), near, most))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", F.coalesce("component", "fp").alias("_root"), "_first", "_n")
    named = stash(named, "roots")
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    byprint = named.join(least, "_root").select("fp", "component_id", "_n")
    return join_hot(prints, byprint, "fp", "_n").select(key, "fp", "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, near: int = 7, most: int = buckets.MOST) -> DataFrame:
    """df's rows without all but one of each group: the one of the least key (and least text hash) stays, one of equal rows."""
    mark = F.xxhash64(key, text)
    prints = stash(fingerprints(df.select(F.struct(F.col(key).alias("id"), mark.alias("mark")).alias("_key"), F.col(text).alias("_text")), "_key", "_text", width), "fingerprints")
    first = F.min(F.struct(F.col("_key.id").isNull(), "_key.id", "_key.mark"))
    firsts = stash(prints.groupBy("fp").agg(first.alias("_first")), "prints")
    roots = components(links(firsts.select("fp"), near, most))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(F.coalesce("component", "fp").alias("_root"), "_first")
    stay = named.groupBy("_root").agg(F.min("_first").alias("x")).select(F.col("x.mark").alias("_stays"), F.col("x.id").alias("_stays_id"))
    rows = df.withColumn("_mark", mark)
    kept = rows.join(stay, (rows["_mark"] == stay["_stays"]) & rows[key].eqNullSafe(stay["_stays_id"]), "left_semi")
    return kept.dropDuplicates(["_mark"]).drop("_mark")
