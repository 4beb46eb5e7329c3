"""Exact counts of words, and of the words that follow three others, exchanged between blocks of texts.

Texts are dealt into blocks. A block sends its different words (64-bit hashes, with their training counts) to the task
that sums that range of hashes, and the sums come back in the same order; so a word is shuffled once for each block, not
for each text. The same way go followers: pairs of a context, the three words before, and the word that follows. What
comes back for a pair tells how often the context was followed by its most frequent word and by others, and whether the
pair's word is that most frequent one. Ranges are so many that each is of one size however large the input is, and
nothing is broadcast: both counts grow with the input.

A context's hash has as many bits as the input asks for, 48 at most; a word behind it has 10. Two that agree by chance
count as one follower, which makes a prediction worse and breaks nothing.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm import common, winnow
from tarnweave.llm.common import stash

BLOCK_BYTES = 14 << 20
#: Text bytes whose counts one task sums, about.
RANGE_BYTES = 4 << 20
#: Words of a follower's context, and bits of the word that follows.
BEFORE, WORD_BITS = 3, 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Counts are told in these steps where only their size matters.
LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 48, 128, 512, 4096, 65536])


_LEVEL = (np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), "right") - 1).astype(np.uint8)


def level(n: np.ndarray) -> np.ndarray:
    """The last of LEVELS up to n, by its number."""
    return np.take(_LEVEL, np.minimum(n, LEVELS[-1]))


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, as many as the largest needs, after their number."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = x.astype(np.uint8) if width == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + _PACKER.compress(planes)


def unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACKER.decompress(memoryview(x)[1:]), np.uint8).reshape(x[0], -1)
    if x[0] == 1:
        return planes[0].astype("<u8")
    out = np.zeros((planes.shape[1], 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)


def pack_alike(x: np.ndarray) -> bytes:
    """Numbers of which most are alike, whatever their size: the different ones, the most frequent first, and their places."""
    own, which, times = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(order), np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    head = pack(own[order])
    return len(head).to_bytes(4, "little") + head + pack(place[which])


def unpack_alike(x: bytes) -> np.ndarray:
    after = 4 + int.from_bytes(x[:4], "little")
    return unpack(x[4:after])[unpack(x[after:]).astype(np.int64)]


def context_bits(size: int) -> int:
    """Of a follower's context, for so many bytes of text."""
    return min(48, max(24, size.bit_length() + 6))


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the number of each place's key. The first bits of how far they are above the least
    are sorted with the places, which beats sorting places; where different keys agree there, their neighbours are sorted."""
    low = np.uint64(max(1, len(keys).bit_length()))
    least = keys.min() if len(keys) else np.uint64(0)
    up = np.uint64(64 - int(keys.max() - least).bit_length()) if len(keys) and keys.max() > least else np.uint64(0)
    both = keys - least
    both <<= up
    both >>= low
    both <<= low
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= (np.uint64(1) << low) - np.uint64(1)
    place = both.view(np.int64)
    key = keys[place]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")  # quick where most are in order
        place, key = place[order], key[order]
    fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    which = np.empty(len(keys), np.int64)
    which[place] = np.cumsum(fresh) - 1
    return key[fresh], which


class More(NamedTuple):
    """What else blocks ask for: ask gives parts with sorted different keys and their training counts, of a block's bytes,
    offsets and which texts train; answer gives a number for each of a part's different keys, of all blocks' sums; brief, of a
    block's keys and their numbers, leaves of these what comes back, as `pack_alike` packs it."""

    ask: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]
    answer: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
    brief: Callable[[np.ndarray, np.ndarray], np.ndarray]


class Words:
    """The words of a block: which text each is of, the different ones, and the followers."""

    def __init__(self, data: np.ndarray, at: np.ndarray, bits: int):
        own = LOWER[data]
        self.starts, self.ends, self.text = common.word_bounds(own, at)
        hashes = winnow.word_units(own, self.starts, self.ends)
        self.known, self.which = different(hashes)
        n = len(hashes)
        self.at = BEFORE + np.flatnonzero(self.text[BEFORE:] == self.text[: max(0, n - BEFORE)])
        context = np.zeros(len(self.at), np.uint64)
        for k in range(1, BEFORE + 1):
            context = winnow.scatter(context + hashes[self.at - k])
        pair = (context >> np.uint64(64 - bits) << np.uint64(WORD_BITS)) | (winnow.scatter(hashes[self.at] + np.uint64(1)) >> np.uint64(64 - WORD_BITS))
        self.pairs, self.pair = different(pair)


def texts(docs: DataFrame) -> DataFrame:
    """docs: _id, _train, _text. (block, part, a): the rows of each block, part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, _, _ in common.blocks(iter([batch]), "_text", BLOCK_BYTES):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], ["block", "part", "a"])
                block += 1
        common.release()

    return docs.select("_id", "_train", "_text").mapInArrow(run, "block long, part int, a binary")


def rows_of(head: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.decompress(head)).read_next_batch()


def asked(blocks: DataFrame, parts: int, bits: int, more: More | None = None) -> DataFrame:
    """(block, part, a, b): the first `parts` parts have a block's words of one range of hashes, with training counts, the
    next ones its followers, and those from 2 * parts on what `more` asks for."""

    def cut(keys: np.ndarray, counts: np.ndarray, width: int, first: int) -> Iterator[tuple[int, bytes, bytes]]:
        edges = np.searchsorted(keys, (np.arange(1, parts, dtype=object) * (1 << width) // parts).astype(np.uint64))
        edges = np.concatenate([[0], edges, [len(keys)]])
        for p in np.flatnonzero(np.diff(edges)):
            own = slice(edges[p], edges[p + 1])
            yield first + int(p), pack_sorted(keys[own]), pack(counts[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, head in zip(batch.column("block"), batch.column("a")):
                rows = rows_of(head.as_py())
                data, at = common.raw(rows.column("_text"))
                trained = rows.column("_train").to_numpy(zero_copy_only=False)
                w = Words(data, at, bits)
                train = trained[w.text]
                got = [*cut(w.known, np.bincount(w.which, weights=train, minlength=len(w.known)), 64, 0)]
                got += cut(w.pairs, np.bincount(w.pair, weights=train[w.at], minlength=len(w.pairs)), bits + WORD_BITS, parts)
                del w, train
                if more is not None:
                    got += [(2 * parts + p, pack_sorted(k), pack(n)) for p, k, n in more.ask(data, at, trained)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()] * len(got), pa.int64()), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.binary()), pa.array([x[2] for x in got], pa.binary())],
                    ["block", "part", "a", "b"],
                )
                del got
                common.release()

    return blocks.mapInArrow(run, "block long, part int, a binary, b binary")


def followed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted different followers: twice their context's state, plus 1 for the most frequent word (the least of those
    that are); and by state, how many training words were the most frequent one of all *other* times of the context, and
    how many there were. A state tells the times of the most frequent word, and of the others; 0: fewer than two times."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    context = keys >> np.uint64(WORD_BITS)
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    total, first = np.add.reduceat(counts, begin), np.maximum.reduceat(counts, begin)
    place = np.arange(len(keys))
    top = np.minimum.reduceat(np.where(counts == first[of], place, len(keys)), begin)
    rest = counts.copy()
    rest[top] = 0
    second = np.maximum.reduceat(rest, begin)
    runner = np.minimum.reduceat(np.where((rest == second[of]) & (place != top[of]), place, len(keys)), begin)
    state = np.where(total >= 2, 16 * level(first) + level(total - first), 0)
    out = 2 * state[of] + (place == top[of])
    # each training word without itself: the top one may lose its rank to the runner-up
    mine = top[of] == place
    less = first - 1
    loses = (less < second) | ((less == second) & (runner < top))
    best = np.where(mine & ~loses[of], less[of], np.where(mine, second[of], first[of]))
    apart = total[of] - 1
    seen = (counts > 0) & (apart > 0)
    lone = (16 * level(best) + level(np.maximum(apart - best, 0)))[seen]
    hits = np.bincount(lone, weights=counts[seen] * (mine & ~loses[of])[seen], minlength=256).astype(np.int64)
    return out.astype(np.uint64), hits, np.bincount(lone, weights=counts[seen], minlength=256).astype(np.int64)


def summed(words: DataFrame, parts: int, more: More | None = None) -> DataFrame:
    """(block, part, a, cell, v, n): for each block's words their training counts, for its followers what `followed` tells.
    Rows without a block: cell -1 has the range's different words and all words, the others hits and times of a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            own = [(b, unpack_sorted(x), unpack(y)) for b, x, y in held]
            known, which = different(np.concatenate([x for _, x, _ in own]))
            total = np.bincount(which, weights=np.concatenate([y for _, _, y in own]), minlength=len(known)).astype(np.int64)
            if now < parts:
                back, rows = total, [(None, b"", -1, int((total > 0).sum()), int(total.sum()))]
            elif now >= 2 * parts:
                back, rows = more.answer(now - 2 * parts, known, total), []
            else:
                back, hits, times = followed(known, total)
                rows = [(None, b"", int(c), int(hits[c]), int(times[c])) for c in np.flatnonzero(times)]
            at = 0
            for b, x, _ in own:
                got = back[which[at : at + len(x)]]
                rows.append((b, pack(got) if now < 2 * parts else pack_alike(more.brief(x, got)), 0, 0, 0))
                at += len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([now] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))],
                ["block", "part", "a", "cell", "v", "n"],
            )

        for batch in batches:
            for block, part, a, b in zip(*batch.columns):  # value by value: a batch may be large
                block, part, a, b = block.as_py(), part.as_py(), a.as_py(), b.as_py()
                if part != now and held:
                    yield from done()
                    held = []
                    common.release()
                now = part
                held.append((block, a, b))
        if held:
            yield from done()
            held = []
        common.release()

    return words.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, "block long, part int, a binary, cell long, v long, n long")


def exchange(docs: DataFrame, size: int, more: More | None = None) -> tuple[DataFrame, int, int, int, np.ndarray]:
    """docs: _id, _train, _text, of `size` bytes of text. What `each_block` reads, and its number of ranges; the training
    words and the different ones; and the probability, by state, that a word is the most frequent follower."""
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, own, -(-size // RANGE_BYTES))
    with common.shuffles_once(docs.sparkSession):
        blocks = stash(texts(docs), "texts")
        counted = stash(summed(asked(blocks, parts, context_bits(size), more), parts, more), "counts")
    words = different = 0
    hits, times = np.zeros(256), np.zeros(256)
    for cell, v, n in counted.filter("block is null").groupBy("cell").agg(F.sum("v"), F.sum("n")).collect():
        if cell < 0:
            different, words = v, n
        else:
            hits[cell], times[cell] = v, n
    both = blocks.union(counted.filter("block is not null").select("block", "part", "a"))
    dealt = both.repartition(4 * max(1, -(-size // BLOCK_BYTES)), "block")  # few tasks have several blocks, which would be one batch
    return dealt.sortWithinPartitions("block", "part"), parts, words, different, (hits + 0.5) / (times + 1)


def whole_blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[list[bytes]]]]:
    """The rows of every block, their bytes and offsets, and what came back for its words, its followers and more, packed."""
    now, head, got = None, b"", [[], [], []]

    def done() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[list[bytes]]]:
        rows = rows_of(head)
        return rows, *common.raw(rows.column("_text")), got

    for batch in batches:
        for block, part, a in zip(*batch.columns):
            block, part, a = block.as_py(), part.as_py(), a.as_py()
            if block != now:
                if now is not None:
                    yield done()
                    common.release()
                now, head, got = block, a, [[], [], []]
            else:
                got[min(2, part // parts)].append(a)
    if now is not None:
        yield done()


def unpacked(got: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *map(unpack, got)])


def each_block(batches: Iterator[pa.RecordBatch], size: int, parts: int, then: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray, list[bytes]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """then(rows, bytes, offsets, words, training count of each different word, state and hit of each follower, what came
    back for more, packed) of every block."""
    for rows, data, at, (known, pairs, more) in whole_blocks(batches, parts):
        yield then(rows, data, at, Words(data, at, context_bits(size)), unpacked(known), unpacked(pairs), more)
