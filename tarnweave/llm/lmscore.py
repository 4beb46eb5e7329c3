"""LM scoring by online logistic context mixing, in bits of bytes.

A text is the bytes of its lower-cased (A-Z) UTF-8 form and an end (byte 255, which UTF-8 never has). Each byte is eight
binary decisions. A decision is predicted in each of several hashed contexts, the last 1 to 6 bytes, from the counts of
zeros and ones after the same bits there in all training texts; a context that was seen once predicts nothing. The
predictions, log ratios of the counts, are added with weights of a gate (the longest context that predicts, whether a
word begins, and which bit it is); a map of the sum by size and bit refines it. A document then adapts: some settings of
how much shorter and longer contexts count are mixed by how well each has coded the document's bytes so far, from the
trained one on. Before a word, its bytes may be saved: a decision whether it is the word that most often follows the
last three (see wordcounts), predicted by how often it did, comes first.

Training: blocks of texts send their different (context, byte) pairs to the tasks that sum ranges of contexts, and the
states of the nodes on each pair's way come back, as with words and followers; so all contexts count, however many the
input has, and nothing is broadcast or bounded. From 1 MB of training text on a context's slot is its whole hash. Below,
there are so many slots that about eight contexts share theirs with another one, and the one seen most often has it. Only
tables of all slots that are under `TABLES` (some kilobytes of text) are made and broadcast. Then every partition learns
weights online from all its training texts, each byte predicted without itself; weights are averaged by how often a gate
was seen, the map's counts are added.

Cases: a null text is empty and has its end only; a null id counts as an empty one; repeated rows are scored, and
counted, each; texts over 1 MiB are coded in pieces that know the last six bytes before them; without training texts
every decision costs one bit and base scores take counts of 0 (log10(0.1/0.1) = 0); an empty table gives an empty one;
extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm import common, winnow, wordcounts
from tarnweave.llm.wordcounts import LEVELS, level, pack, pack_sorted, unpack, unpack_sorted

#: Contexts are the last 1 to this many bytes; pieces know eight bytes before them.
ORDERS, PAD = 6, 8
END, START = 255, 254
#: Bits of slots at least; and bytes of all tables, of 16 a slot, that are made whole.
LEAST_BITS, TABLES = 12, 32 << 20
#: A context is in the tables from so many times on.
SEEN = 2
#: Text bytes of a piece, of a step, and of a step's counting; events that one step of learning takes.
PIECE, STEP, COUNT_BYTES, LEARN = 1 << 20, 1 << 19, 2 << 20, 1 << 13
#: Pairs of a block that are sorted at once.
SORTED = 8 << 20
#: Different pairs of a context that a partition holds before it sends them; and, in bits, pairs whose costs a worker remembers.
HELD, REMEMBERED = 2_000_000, 20
#: Training bytes whose pairs one shard of each context's table has, about.
SHARD_BYTES = 8 << 20
#: Predictions are kept in steps of 1 / SCALE. Sums end at this size, so that a byte's chances can be multiplied.
SCALE, MOST_SUM = 15, np.float32(10)
#: Shorter and longer contexts; and settings of how much more or less each counts, with what they weigh at first.
PARTS = (slice(0, 4), slice(4, 6))
SETTINGS = np.array([(0, 0), (0.4, -0.4), (-0.4, 0.4)], np.float32)
AT_FIRST = np.log(np.array([0.5, 0.25, 0.25], np.float32))
#: A document adapts after so many bytes, twice as many, and so on.
FIRST = 256
GATES = (ORDERS + 1) * 2
BINS = 24
_NIBBLE = np.arange(16)
#: The four nodes of each nibble's path.
_PATH = np.stack([1 + 0 * _NIBBLE, 2 + (_NIBBLE >> 3), 4 + (_NIBBLE >> 2), 8 + (_NIBBLE >> 1)], 1)
_GAP = np.array([s in (32, *range(9, 14), END, START) for s in range(256)])


def _ratios(alone: bool) -> np.ndarray:
    """Predictions toward a decision's own bit (row) by its node's state (column); alone: without the decision itself."""
    zero, one = np.repeat(LEVELS, 16), np.tile(LEVELS, 16)
    less = lambda x: np.maximum(x - alone, 0)
    out = np.stack([np.log((less(zero) + 0.4) / (one + 0.4)), np.log((less(one) + 0.4) / (zero + 0.4))])
    return np.rint(np.clip(out, -8, 8) * SCALE).astype(np.int8)


class Symbols(NamedTuple):
    """The bytes of some pieces, each after what is before it; which of them are coded; each piece's text and first coded
    byte."""

    out: np.ndarray
    coded: np.ndarray
    text: np.ndarray
    begin: np.ndarray


def pieces(data: np.ndarray, at: np.ndarray, most: int = STEP) -> Iterator[Symbols]:
    """Some pieces at a time; all together are the texts in order."""
    sizes = np.diff(at)
    n = np.maximum(1, -(-sizes // PIECE))
    text = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    low = at[:-1][text] + nth * PIECE
    high = np.minimum(low + PIECE, at[1:][text])
    total = np.append(0, np.cumsum(high - low + 1))
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        own = slice(first, last)
        size = high[own] - low[own]
        ends = high[own] == at[1:][text[own]]
        coded_size = size + ends
        edges = np.append(0, np.cumsum(coded_size))
        coded = np.arange(edges[-1]) + np.repeat(PAD * np.arange(1, len(size) + 1), coded_size)
        out = np.full(edges[-1] + PAD * len(size), START, np.uint8)
        place = np.arange(size.sum())
        shift = np.repeat(edges[:-1] + PAD * np.arange(1, len(size) + 1) - np.append(0, np.cumsum(size))[:-1], size)
        out[place + shift] = wordcounts.LOWER[data[low[first] : high[last - 1]]]
        begin = edges[:-1]
        out[(begin + size + PAD * np.arange(1, len(size) + 1))[ends]] = END
        for k in np.flatnonzero(nth[own] > 0):
            here = begin[k] + PAD * (k + 1)
            out[here - PAD : here] = wordcounts.LOWER[data[low[first + k] - PAD : low[first + k]]]
        yield Symbols(out, coded, text[own], begin)
        first = last


def pairs(s: Symbols) -> np.ndarray:
    """Each coded byte, highest, and the six before it, the last one first, in 56 bits."""
    eight = np.ndarray(len(s.out) - 7, "<u8", s.out, strides=(1,))
    return (eight[s.coded - 8] >> np.uint64(16)) | s.out[s.coded].astype(np.uint64) << np.uint64(48)


def pairs_in_order(data: np.ndarray, at: np.ndarray, train: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `pairs`, of all pieces of the texts, with which of them train; up to `most` at a time."""
    n = len(at) - 1
    kind = np.repeat(np.tile(np.array([0, 1, 2], np.uint8), n), np.stack([np.full(n, PAD), np.diff(at), np.ones(n, np.int64)], 1).ravel())
    out = np.full(len(kind), START, np.uint8)
    out[kind == 1] = wordcounts.LOWER[data]
    out[kind == 2] = END
    coded, train = kind != 0, np.repeat(train, np.diff(at) + PAD + 1)
    eight = np.ndarray(max(0, len(out) - 7), "<u8", out, strides=(1,))
    for i in range(PAD, len(out), most):
        some = slice(i, min(i + most, len(out)))
        pair = eight[i - PAD : some.stop - PAD] >> np.uint64(16)
        pair |= out[some].astype(np.uint64) << np.uint64(48)
        yield pair[coded[some]], train[some][coded[some]]


def order_hash(pair: np.ndarray, k: int) -> np.ndarray:
    """A hash of the last k bytes before."""
    return winnow.scatter((pair & np.uint64((1 << 48) - 1)) >> np.uint64(48 - 8 * k) | np.uint64(k << 56))


def byte_of(pair: np.ndarray) -> np.ndarray:
    return pair >> np.uint64(48)


def with_places(keys: np.ndarray) -> np.ndarray:
    """The places in the order of the keys' first bits, which are sorted together with the places."""
    low = np.uint64(max(8, len(keys).bit_length()))
    both = np.sort(keys >> low << low | np.arange(len(keys), dtype=np.uint64))
    return (both & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 56 bits, each at least once, in the order of their first bits; and for each place the number of its key.
    Equal keys are found by the first bits of a product; different ones that agree there may come twice, which does no harm."""
    place = with_places(keys * np.uint64(0x9E3779B97F4A7C15))
    key = keys[place]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    key = key[fresh]
    order = with_places(key << np.uint64(8))
    rank = np.empty(len(key), np.int32)
    rank[order] = np.arange(len(key), dtype=np.int32)
    which = np.empty(len(keys), np.int32)
    which[place] = rank[np.cumsum(fresh, dtype=np.int32) - 1]
    return key[order], which


class Shape(NamedTuple):
    """How the tables are laid out: bits of slots of each context, of shards, and of a context's hash."""

    bits: tuple[int, ...]
    shard: int
    hash: int


def shape(size: int) -> Shape:
    told = min(56, max(32, size.bit_length() + 12))
    bits = min(told, max(LEAST_BITS, 2 * size.bit_length() - 8))
    return Shape((bits,) * ORDERS, max(3, (size // SHARD_BYTES).bit_length()), told)


def high_slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of a context's first four bits, and its check."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h >> np.uint64(36)).astype(np.uint8)


def low_slots(h: np.ndarray, nibble: np.ndarray, bits: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of the last four bits after the first ones, in the context's shard, and its check."""
    own = winnow.scatter(h + nibble.astype(np.uint64) + np.uint64(1))
    inside = own >> np.uint64(64 - bits + shard)
    return ((h >> np.uint64(64 - shard) << np.uint64(bits - shard)) | inside).astype(np.int64), (own >> np.uint64(12)).astype(np.uint8)


def gathered(docs: DataFrame, made: Shape) -> DataFrame:
    """(context, shard, keys, counts): the pairs of context and byte in each partition's training texts."""
    def sent(k: int, h: np.ndarray, byte: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        key = squeezed(h, made) | byte
        order = np.argsort(key)
        key, n = counted(key[order], n[order])
        edges = np.searchsorted(key >> np.uint64(made.hash + 8 - made.shard), np.arange((1 << made.shard) + 1, dtype=np.uint64))
        own = np.flatnonzero(np.diff(edges))
        cut = [slice(edges[p], edges[p + 1]) for p in own]
        columns = [pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in ([pack_sorted(key[c]) for c in cut], [pack(n[c]) for c in cut]))]
        return pa.RecordBatch.from_arrays(columns, ["context", "shard", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in held_pairs(batches):
            for k in range(ORDERS, 0, -1):  # pairs of a shorter context are sums over those of longer ones
                if k < ORDERS:
                    key, n = counted(key >> np.uint64(48 - 8 * k) << np.uint64(48 - 8 * k), n)  # still sorted
                yield sent(k - 1, order_hash(key, k), byte_of(key), n)

    return docs.filter("_train").select("_text").mapInArrow(run, "context int, shard int, keys binary, counts binary")


def held_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different pairs of the texts, sorted, with their counts: of all of a partition's texts, or of so many of them
    that the pairs stay under a bound."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = none
    for batch in batches:
        for _, data, at in common.blocks(iter([batch]), "_text", COUNT_BYTES):
            for s in pieces(data, at, COUNT_BYTES):
                held = counted(*held, *tallied(pairs(s)))
                if len(held[0]) > HELD:
                    yield held
                    held = none
    if len(held[0]):
        yield held
    common.release()


def tallied(key: np.ndarray, over: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and how often each is there. over: the array may be sorted itself."""
    key = key if over else key.copy()
    key.sort()
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.diff(np.append(begin, len(key)))


def counted(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of their counts; of arrays of sorted keys and of counts in turn."""
    key, n = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
    order = np.argsort(key, kind="stable")  # merges sorted stretches
    return summed_alike(key[order], n[order])


def summed_alike(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of sorted ones, and the sums of their counts."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(n, begin) if len(key) else n


def squeezed(h: np.ndarray, made: Shape) -> np.ndarray:
    """The bits of a context's hash that are told apart, before eight bits for a byte."""
    return h >> np.uint64(64 - made.hash) << np.uint64(8)


def states(counts: np.ndarray) -> np.ndarray:
    """Of counts by nibble: the states of the 15 nodes, in the order of the tree, after a place for the check."""
    out = np.zeros((len(counts), 16), np.uint8)
    for depth in range(4):
        own = counts.reshape(len(counts), 1 << depth, 2, 8 >> depth).sum(3)
        out[:, 1 << depth : 2 << depth] = 16 * level(own[:, :, 0]) + level(own[:, :, 1])
    return out


def part_of_table(key: np.ndarray, n: np.ndarray, context: int, made: Shape) -> np.ndarray:
    """A shard's slots, from its sorted different pairs and their counts."""
    bits, shard = made.bits[context], made.shard
    width = 1 << (bits - shard)
    table = np.zeros((width, 16), np.uint8)
    begin = np.flatnonzero(np.append(True, key[1:] >> np.uint64(8) != key[:-1] >> np.uint64(8)))
    seen = np.repeat(np.add.reduceat(n, begin), np.diff(np.append(begin, len(key)))) >= SEEN
    key, n = key[seen], n[seen]
    if not len(key):
        return table
    slots, checks, rows, times = [], [], [], []
    for low in (False, True):
        group = key >> np.uint64(4 if low else 8)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        nibble = (key & np.uint64(15) if low else key >> np.uint64(4) & np.uint64(15)).astype(np.int64)
        counts = np.bincount(16 * of + nibble, weights=n, minlength=16 * len(begin)).astype(np.int64).reshape(-1, 16)
        h = key[begin] >> np.uint64(8) << np.uint64(64 - made.hash)
        slot, check = low_slots(h, key[begin] >> np.uint64(4) & np.uint64(15), bits, shard) if low else high_slots(h, bits)
        slots.append(slot & (width - 1))
        checks.append(check)
        rows.append(states(counts))
        times.append(counts.sum(1))
    slot, row = np.concatenate(slots), np.concatenate(rows)
    row[:, 0] = np.concatenate(checks)
    order = np.argsort(np.concatenate(times), kind="stable")
    last = np.zeros(width, np.int64)
    last[slot[order]] = order + 1  # the last one has been seen most often
    some = np.flatnonzero(last)
    table[some] = row[last[some] - 1]
    return table


def merged(parts: DataFrame, made: Shape) -> DataFrame:
    """(context, shard, table)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            key, n = counted(*(x for pair in held for x in pair))
            table = part_of_table(key, n, now[0], made)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["context", "shard", "table"])

        for batch in batches:
            for context, shard, keys, counts in zip(*batch.columns):
                context, shard, keys, counts = context.as_py(), shard.as_py(), keys.as_py(), counts.as_py()
                if (context, shard) != now:
                    if held:
                        yield done()
                        common.release()
                    now, held = (context, shard), []
                held.append((unpack_sorted(keys), unpack(counts).astype(np.int64)))
        if held:
            yield done()

    return parts.repartition("context", "shard").sortWithinPartitions("context", "shard").mapInArrow(run, "context int, shard int, table binary")


class Tables:
    """The merged tables: what each node of a context has been."""

    def __init__(self, made: Shape):
        self.shape = made
        self.flat = [np.zeros((1 << b, 16), np.uint8) for b in made.bits]
        self.ready: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.costs: tuple[int, np.ndarray, np.ndarray] | None = None

    def fill(self, rows: Iterator) -> Tables:
        for context, shard, table in rows:
            width = 1 << (self.shape.bits[context] - self.shape.shard)
            self.flat[context][shard * width : (shard + 1) * width] = np.frombuffer(table, np.uint8).reshape(-1, 16)
        return self

    def predictions(self, alone: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each context: by slot and nibble, the four predictions toward the nibble's bits, in one number; and the checks.
        Made once in a worker."""
        if alone not in self.ready:
            ratios, out = _ratios(alone), []
            for flat in self.flat:
                packed = np.empty((len(flat), 16, 4), np.int8)
                for depth in range(4):
                    for node in range(1 << depth, 2 << depth):
                        for bit in (0, 1):
                            own = np.flatnonzero((_PATH[:, depth] == node) & (_NIBBLE >> 3 - depth & 1 == bit))
                            packed[:, own, depth] = np.take(ratios[bit], flat[:, node])[:, None]
                out.append((packed.view(np.uint32).ravel(), np.ascontiguousarray(flat[:, 0])))
            self.ready = {alone: out}  # the other one isn't needed any more
        return self.ready[alone]

    def inputs(self, pair: np.ndarray, alone: bool) -> tuple[list[np.ndarray], list[tuple[int, slice]], np.ndarray]:
        """Of every pair the contexts' predictions for its eight decisions, toward what the bits are; pairs are ordered by
        gate: each gate's rows, and the order. Neighbours with the same last bytes are looked up once."""
        found = []
        for k in range(1, ORDERS + 1):
            packed, checks = self.predictions(alone)[k - 1]
            short = pair >> np.uint64(48 - 8 * k)
            at = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
            own, times = pair[at], np.diff(np.append(at, len(pair)))
            byte = byte_of(own).astype(np.int64)
            h = squeezed(order_hash(own, k), self.shape) << np.uint64(56 - self.shape.hash)
            both = np.empty((len(h), 2), np.uint32)
            slots = high_slots(h, self.shape.bits[k - 1]), low_slots(h, byte >> 4, self.shape.bits[k - 1], self.shape.shard)
            for half, ((slot, check), nibble) in enumerate(zip(slots, (byte >> 4, byte & 15))):
                same = np.take(checks, slot) == check
                slot <<= 4
                slot += nibble
                np.multiply(np.take(packed, slot), same, out=both[:, half])
            found.append(np.repeat(both.view(np.uint64).ravel(), times))
        return arranged(found, pair)


def arranged(found: list[np.ndarray], pair: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, slice]], np.ndarray]:
    """The contexts' predictions for each pair as numbers, ordered by gate: each gate's rows, and the order."""
    known = np.zeros(len(pair), np.uint8)
    for k, x in enumerate(found, 1):
        known[x.view(np.uint32)[::2] != 0] = k
    gate = known + _GAP[(pair >> np.uint64(40) & np.uint64(255)).astype(np.int64)] * np.uint8(ORDERS + 1)
    order = np.argsort(gate, kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
    rows = [(g, slice(edges[g], edges[g + 1])) for g in range(GATES) if edges[g + 1] > edges[g]]
    return [np.take(x, order).view(np.int8).reshape(-1, 8).astype(np.float32) for x in found], rows, order


class Places:
    """The place of any of some sorted different keys. A slot of a table has one key, the most frequent one that wants it; those
    that aren't in their slots have a second table, and those that aren't there are searched for."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.tables = key, []
        bits, own = max(8, len(key).bit_length() + 1), np.argsort(np.minimum(n, 65535).astype(np.uint16), kind="stable").astype(np.int32)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slot_of = lambda x, f=np.uint64(factor), b=np.uint64(64 - bits): (x * f >> b).view(np.int64)
            table, slot = np.zeros(1 << bits, np.int32), slot_of(key[own])
            table[slot] = own
            own = own[table[slot] != own]
            self.tables.append((slot_of, table))

    def __call__(self, sought: np.ndarray) -> np.ndarray:
        out, lost = np.empty(len(sought), np.int32), slice(None)
        for slot_of, table in self.tables:
            own = sought[lost]
            place = np.take(table, slot_of(own))
            out[lost] = place
            wrong = np.flatnonzero(np.take(self.key, place) != own)
            lost = wrong if isinstance(lost, slice) else lost[wrong]
        out[lost] = np.searchsorted(self.key, sought[lost])
        return out


class Pairs:
    """The different pairs of a block, sorted, and how often training texts have each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, train: np.ndarray):
        self.key, self.n, have = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        held = np.empty(min(len(data) + len(at), SORTED), np.uint64)
        for pair, own in pairs_in_order(data, at, train):
            if have + len(pair) > len(held):
                self._add(held[:have])
                have = 0
            held[have : have + len(pair)] = pair << np.uint64(1) | own
            have += len(pair)
        self._add(held[:have])

    def _add(self, held: np.ndarray) -> None:
        key, n = tallied(held, True)
        key, n = summed_alike(key >> np.uint64(1), n * (key & np.uint64(1)).view(np.int64))
        self.key, self.n = counted(self.key, self.n, key, n) if len(self.key) else (key, n)

    def places(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each coded byte's pair, and where pieces begin."""
        which, done, look = np.empty(len(data) + len(at) - 1, np.int32), 0, Places(self.key, self.n)
        for pair, _ in pairs_in_order(data, at, np.zeros(len(at) - 1, bool)):
            which[done : done + len(pair)] = look(pair)
            done += len(pair)
        n = np.maximum(1, -(-np.diff(at) // PIECE))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, np.repeat(at[:-1] + np.arange(len(n)), n) + nth * PIECE

    def contexts(self, made: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each context the different keys, sorted as ranges have them, and the place of each pair's key."""
        for k in range(1, ORDERS + 1):
            short = self.key >> np.uint64(48 - 8 * k)
            at = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
            own = self.key[at]
            keys, which = wordcounts.different(squeezed(order_hash(own, k), made) | byte_of(own))
            yield keys, np.repeat(which, np.diff(np.append(at, len(short))))

    def states(self, made: Shape, got: list[bytes]) -> list[np.ndarray]:
        """Of each context the states of the eight decisions of every pair: levels of its own count and of the other one.
        got: what came back for the contexts, range by range."""
        out, k = [], 0
        for keys, which in self.contexts(made):
            rows, have = [np.zeros(0, np.uint64)], 0
            while have < len(keys):
                rows.append(wordcounts.unpack_alike(got[k]))
                have, k = have + len(rows[-1]), k + 1
            out.append(with_told(keys, np.concatenate(rows))[which])
        return out


#: What a range counts for a pair: how often it is there, how often the other branch of each decision on its way was taken, and
#: in two bits, whether the states of its first and last four decisions are not in their slots. Only the decisions' states
#: come back, a byte each.
PLACES = 10


def levels_of(back: np.ndarray) -> np.ndarray:
    """16 times the level of a decision's own count, and the level of the other one, of each decision; of what a range
    counts."""
    out, own = np.empty((back.shape[1], 8), np.uint8), back[0].copy()
    for j in range(7, -1, -1):
        out[:, j] = 16 * wordcounts.level(own) + wordcounts.level(back[1 + j])
        own += back[1 + j]
    if back[9].any():
        out[back[9] & 1 != 0, :4] = 0
        out[back[9] & 2 != 0, 4:] = 0
    return out


#: By how the bytes of neighbours differ: the decisions up to the one at which they part. And a pair's states after so many.
_UP_TO = np.array([0, *(9 - x.bit_length() for x in range(1, 256))], np.uint8)
_AFTER = np.array([(1 << 64) - (1 << 8 * k) for k in range(9)], np.uint64)


def told(keys: np.ndarray) -> np.ndarray:
    """How many of each pair's first decisions have states that the pair before tells, as it has the same context: they are
    the same nodes, and at the last of them it took the other branch."""
    out, apart = np.zeros(len(keys), np.uint8), keys[1:] ^ keys[:-1]
    out[1:] = np.where(apart < 256, np.take(_UP_TO, apart & np.uint64(255)), 0)
    return out


def without_told(keys: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Zeros for the states that the pair before tells, of sorted different keys."""
    return states & np.take(_AFTER, told(keys))


def with_told(keys: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The states again, from what `without_told` leaves."""
    upto, place = told(keys), np.arange(len(keys), dtype=np.int32)
    out, byte = states.view(np.uint8).reshape(-1, 8).T.copy(), keys.astype(np.uint8)
    for j in range(8):
        own = upto > j
        rows = np.flatnonzero(own)
        source = np.maximum.accumulate(np.where(own, 0, place))[rows]
        state = out[j][source]
        turned = (byte[rows] ^ byte[source]) & np.uint8(128 >> j) != 0
        out[j][rows] = np.where(turned, state >> 4 | state << 4, state)
    return np.ascontiguousarray(out.T).view(np.uint64).ravel()


def asked(made: Shape) -> wordcounts.More:
    """What blocks send of their pairs, and what comes back. A part is a range of one context's hashes."""

    def ask(data: np.ndarray, at: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        own = Pairs(data, at, train)
        for k, (keys, which) in enumerate(own.contexts(made)):
            n = np.bincount(which, weights=own.n, minlength=len(keys)).astype(np.int64)
            edges = np.searchsorted(keys >> np.uint64(made.hash + 8 - made.shard), np.arange((1 << made.shard) + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)):
                yield (k << made.shard) + int(p), keys[edges[p] : edges[p + 1]], n[edges[p] : edges[p + 1]]

    return wordcounts.More(ask, lambda part, key, n: levels_of(ways(key, n, part >> made.shard, made).T).view(np.uint64).ravel(), without_told)


def ways(key: np.ndarray, n: np.ndarray, context: int, made: Shape) -> np.ndarray:
    """What `PLACES` says, of a range's sorted different pairs and their counts; zeros for contexts that aren't in the tables."""
    result = np.zeros((len(key), PLACES), np.uint32)
    if not len(key):
        return result
    begin = np.flatnonzero(np.append(True, key[1:] >> np.uint64(8) != key[:-1] >> np.uint64(8)))
    seen = np.flatnonzero(np.repeat(np.add.reduceat(n, begin) >= SEEN, np.diff(np.append(begin, len(key)))))
    if not len(seen):
        return result
    key, n = key[seen], np.minimum(n[seen], LEVELS[-1])
    fresh = [np.append(True, key[1:] >> cut != key[:-1] >> cut) for cut in (np.uint64(8), np.uint64(4))]
    begin, out = np.flatnonzero(fresh[0]), np.zeros((len(key), PLACES), np.uint32)
    out[:, 0] = n
    for some in row_steps(np.diff(np.append(begin, len(key))), 1 << 16):
        own = slice(begin[some.start], begin[some.stop] if some.stop < len(begin) else len(key))
        for half, nibble in enumerate((key[own] >> np.uint64(4) & np.uint64(15), key[own] & np.uint64(15))):
            nibble, of = nibble.astype(np.int64), np.cumsum(fresh[half][own]) - 1
            counts = np.bincount(16 * of + nibble, weights=n[own], minlength=16 * (of[-1] + 1))
            for depth in range(3, -1, -1):  # counts: of the branches after this decision
                out[own, 1 + 4 * half + depth] = counts[(of << depth + 1) + (nibble >> 3 - depth ^ 1)]
                counts = counts[::2] + counts[1::2]
    if made.bits[context] < made.hash:
        for half, has in enumerate(owners(key, n, fresh, context, made)):
            out[:, 9] |= (~has[np.cumsum(fresh[half]) - 1]).astype(np.uint32) << half
    result[seen] = np.minimum(out, LEVELS[-1])
    return result


def owners(key: np.ndarray, n: np.ndarray, fresh: list[np.ndarray], context: int, made: Shape) -> list[np.ndarray]:
    """Which contexts, and which first four bits after them, have their slots, as in `part_of_table`."""
    begin = [np.flatnonzero(x) for x in fresh]
    times = [np.add.reduceat(n, x) for x in begin]
    h = [key[x] >> np.uint64(8) << np.uint64(64 - made.hash) for x in begin]
    bits = made.bits[context]
    slots = [high_slots(h[0], bits)[0], low_slots(h[1], key[begin[1]] >> np.uint64(4) & np.uint64(15), bits, made.shard)[0]]
    slot = np.concatenate(slots)
    order = np.lexsort((np.concatenate(times), slot))
    has = np.zeros(len(slot), bool)
    has[order[np.append(slot[order][1:] != slot[order][:-1], True)]] = True
    return [has[: len(begin[0])], has[len(begin[0]) :]]


_TOWARD = {alone: _ratios(alone)[0] for alone in (False, True)}


def toward(found: list[np.ndarray], pair: np.ndarray, alone: bool) -> tuple[list[np.ndarray], list[tuple[int, slice]], np.ndarray]:
    """As `Tables.inputs`, of the states that came back for some pairs."""
    return arranged([np.take(_TOWARD[alone], np.ascontiguousarray(x).view(np.uint8)).view(np.uint64) for x in found], pair)


def costs_with(own: Pairs, found: list[np.ndarray], mixer: Mixer) -> np.ndarray:
    """The cost of each of a block's pairs in each setting, from the states that came back for them."""
    each = np.empty((len(own.key), len(SETTINGS)), np.float32)
    for i in range(0, len(own.key), LEARN):
        some = slice(i, i + LEARN)
        xs, rows, order = toward([x[some] for x in found], own.key[some], False)
        each[i + order] = by_setting(xs, rows, mixer)
    return each


def costs_of(pair: np.ndarray, tables: Tables, mixer: Mixer) -> np.ndarray:
    """The cost of each pair in each setting. A worker remembers those of the last pairs, as most come again: a slot of
    its memory has one pair, the last one that wanted it."""
    if tables.costs is None or tables.costs[0] != mixer.mark:
        tables.costs = mixer.mark, np.full(1 << REMEMBERED, 1 << 63, np.uint64), np.empty((1 << REMEMBERED, len(SETTINGS)), np.float32)
    _, known, each = tables.costs
    slot = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - REMEMBERED)).astype(np.int64)
    out = np.take(each, slot, axis=0)
    new = np.flatnonzero(np.take(known, slot) != pair)
    for i in range(0, len(new), LEARN):
        own = new[i : i + LEARN]
        xs, rows, order = tables.inputs(pair[own], False)
        out[own[order]] = by_setting(xs, rows, mixer)
    known[slot[new]], each[slot[new]] = pair[new], out[new]
    return out


#: Inputs of some pairs, and how often training texts have each.
Step = tuple[tuple[list[np.ndarray], list[tuple[int, slice]], np.ndarray], np.ndarray]


class Tally:
    """What learning counts: how far weights have moved, how often gates were seen, and the map's cells."""

    def __init__(self):
        self.slopes, self.seen = np.zeros((ORDERS, GATES, 8)), np.zeros((GATES, 8))
        self.right, self.total = np.zeros(8 * BINS), np.zeros(8 * BINS)


class Mixer:
    """Weights of each gate and bit for the contexts' predictions, and the map that refines their sum."""

    def __init__(self):
        self.weights = np.full((ORDERS, GATES, 8), 0.3 / SCALE, np.float32)
        self.map = np.tile((np.arange(BINS) / 2 + 0.25).astype(np.float32), (8, 1))
        self.mark = 0

    @staticmethod
    def cell(size: np.ndarray) -> np.ndarray:
        """The map's cell of the sizes of sums."""
        out = np.minimum(size * np.float32(2), np.float32(BINS - 1)).astype(np.int64)
        out += BINS * np.arange(8)
        return out

    def refined(self, z: np.ndarray) -> np.ndarray:
        return (z + np.sign(z) * np.take(self.map.ravel(), self.cell(np.abs(z)))) * np.float32(0.5)

    def summed(self, xs: list[np.ndarray], rows: list[tuple[int, slice]], which: slice = slice(None)) -> np.ndarray:
        """The weighted sums of some contexts' predictions."""
        out = np.empty_like(xs[0])
        weights, xs = self.weights[which], xs[which]
        for g, own in rows:
            z = weights[0, g] * xs[0][own]
            for w, x in zip(weights[1:, g], xs[1:]):
                z += w * x[own]
            out[own] = z
        return out

    def learn(self, xs: list[np.ndarray], rows: list[tuple[int, slice]], n: np.ndarray, tally: Tally) -> None:
        """A step down the cost of events that came n times, each weight's the shorter the more it has moved."""
        z = self.summed(xs, rows)
        way = 3 * self.cell(np.abs(z)) + np.sign(z).astype(np.int8) + 1
        wrong, neither, right = np.bincount(way.ravel(), weights=np.repeat(n, 8), minlength=24 * BINS).reshape(-1, 3).T
        tally.total += wrong + neither + right
        tally.right += right + neither / 2
        error = n[:, None] / (1 + np.exp(np.minimum(z, 60)))
        for g, own in rows:
            tally.seen[g] += n[own].sum()
            wrong = error[own]
            slope = np.stack([np.einsum("ij,ij->j", wrong, x[own]) for x in xs]) / (SCALE * LEARN)
            tally.slopes[:, g] += slope * slope
            self.weights[:, g] += (0.03 / SCALE * slope / np.sqrt(tally.slopes[:, g] + 1e-9)).astype(np.float32)

    def fit_map(self, right: np.ndarray, total: np.ndarray) -> None:
        """From how often the likelier bit came. Cells that were seen little stay near their own middle."""
        own = 1 / (1 + np.exp(-(np.arange(BINS) / 2 + 0.25)))
        p = (right + 16 * own) / (total + 16)
        self.map = np.log(p / (1 - p)).astype(np.float32)
        self.mark = zlib.crc32(self.map.tobytes(), zlib.crc32(self.weights.tobytes()))


def learnt(docs: DataFrame, tables: Broadcast) -> Mixer:
    """Weights and map from all training texts, learnt online in each partition and averaged."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[Step]:
        own = tables.value
        for key, n in held_pairs(batches):
            # neighbours are of a kind: steps of learning take them from all over
            stride = -(-len(key) // LEARN)
            for i in range(stride):
                yield own.inputs(key[i::stride], True), n[i::stride]

    return averaged(docs.filter("_train").select("_text"), steps)


def learnt_from_blocks(joined: DataFrame, parts: int, made: Shape) -> Mixer:
    """As `learnt`, from blocks and the states that came back for them."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[Step]:
        for rows, data, at, (*_, back) in wordcounts.whole_blocks(batches, parts):
            own = Pairs(data, at, rows.column("_train").to_numpy(zero_copy_only=False))
            common.release()
            found, seen = own.states(made, back), np.flatnonzero(own.n)
            stride = -(-len(seen) // LEARN)
            for i in range(stride):
                some = seen[i::stride]
                yield toward([x[some] for x in found], own.key[some], True), own.n[some]

    return averaged(joined.filter((F.col("part") < 0) | (F.col("part") >= 2 * parts)), steps)  # words aren't needed


def averaged(docs: DataFrame, steps: Callable[[Iterator[pa.RecordBatch]], Iterator[Step]]) -> Mixer:
    """A mixer that learns from each partition's steps; weights are averaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, tally = Mixer(), Tally()
        for (xs, rows, order), n in steps(batches):
            mixer.learn(xs, rows, n[order].astype(np.float32), tally)
        common.release()
        rows = np.concatenate([(mixer.weights * tally.seen).ravel(), tally.seen.ravel(), tally.right, tally.total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], ["cell", "x"])

    cells = docs.mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    out, n, m = Mixer(), ORDERS * GATES * 8, GATES * 8
    sums = np.zeros(n + m + 16 * BINS)
    for cell, x in cells.collect():
        sums[cell] = x
    weights, seen = sums[:n].reshape(out.weights.shape), sums[n : n + m].reshape(GATES, 8)
    out.weights = np.where(seen > 0, weights / np.maximum(seen, 1), out.weights).astype(np.float32)
    out.fit_map(*sums[n + m :].reshape(2, 8, BINS))
    return out


def costs(data: np.ndarray, at: np.ndarray, tables: Tables, mixer: Mixer) -> np.ndarray:
    """The cost, in nats, of every byte of the texts and of their ends, each text's after its bytes."""
    out = []
    for s in pieces(data, at):
        key, which = alike(pairs(s))
        out.append(adapted(which, s.begin, costs_of(key, tables, mixer)))
    return np.concatenate([np.zeros(0, np.float32), *out])


def by_setting(xs: list[np.ndarray], rows: list[tuple[int, slice]], mixer: Mixer) -> np.ndarray:
    """The cost of each event in each setting."""
    parts = [mixer.summed(xs, rows, which) for which in PARTS]
    trained = mixer.refined(sum(parts))
    out = np.empty((len(trained), len(SETTINGS)), np.float32)
    for k, own in enumerate(SETTINGS):
        z = trained.copy()
        for f, part in zip(own, parts):
            if f:
                z += f * part
        np.clip(z, -MOST_SUM, MOST_SUM, out=z)
        chance = np.exp(np.negative(z, out=z), out=z)
        chance += 1
        chance = chance[:, :4] * chance[:, 4:]
        chance = chance[:, :2] * chance[:, 2:]
        np.multiply(chance[:, 0], chance[:, 1], out=out[:, k])
    return np.log(out, out=out)


def adapted(which: np.ndarray, begin: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The costs of coded bytes: by a mix of the settings, which weigh in each piece as they did at first, times the chance
    that each gave the piece's bytes before. They are weighed anew after FIRST bytes, twice as many, and so on."""
    out = np.empty(len(which), np.float32)
    size, four = np.diff(np.append(begin, len(which))), np.zeros((len(each), 4), np.float32)
    four[:, : each.shape[1]] = each
    four = four.view(np.complex128).ravel()  # one look-up for all settings
    weigh = np.tile(AT_FIRST, (len(begin), 1)).astype(np.float64)
    low, piece = 0, np.flatnonzero(size > 0)
    while len(piece):
        high = max(FIRST, 2 * low)
        n = np.minimum(size[piece], high) - low
        edges = np.cumsum(n) - n
        for rows in row_steps(n):
            at = np.arange(edges[rows.start], edges[rows.stop - 1] + n[rows.stop - 1]) - np.repeat(edges[rows] - begin[piece[rows]] - low, n[rows])
            own = np.take(which, at)
            share = weigh[piece[rows]]
            share = np.exp(share - share.max(1)[:, None])
            share = (share / share.sum(1)[:, None]).astype(np.float32)
            chance = np.zeros(len(at), np.float32)
            for k, cost in enumerate(np.ascontiguousarray(np.take(four, own).view(np.float32).reshape(-1, 4).T[: each.shape[1]])):
                weigh[piece[rows], k] -= np.add.reduceat(cost.astype(np.float64), edges[rows] - edges[rows.start])
                chance += np.exp(np.negative(cost, out=cost), out=cost) * np.repeat(share[:, k], n[rows])
            out[at] = -np.log(chance, out=chance)
        low = high
        piece = piece[size[piece] > low]
    return out


def row_steps(n: np.ndarray, most: int = 1 << 15) -> Iterator[slice]:
    """Neighbours of about `most` together."""
    total = np.append(0, np.cumsum(n))
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield slice(first, last)
        first = last


def score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", add: float = 0.1) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) and bits_per_byte of every text."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("_id"), (~held_out).alias("_train"), F.col(text).alias("_text"))
    length = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    size, trained, ends = docs.agg(F.sum(length), F.sum(F.when(F.col("_train"), length)), F.count_if("_train")).first()
    size, trained = size or 0, trained or 0
    made = shape(trained)
    few = sum(16 << b for b in made.bits) <= TABLES
    joined, parts, tokens, different, follows = wordcounts.exchange(docs, size, None if few else asked(made))
    if few:
        tables = spark.sparkContext.broadcast(Tables(made).fill(merged(gathered(docs, made), made).toLocalIterator()))
        mixer = learnt(docs, tables)
    else:
        with common.shuffles_once(spark):
            mixer = learnt_from_blocks(joined, parts, made)
    train_tokens, kinds = tokens + ends, different + (ends > 0)
    floor = float(np.log10(train_tokens + add * (kinds + 1)))

    def each(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, words: wordcounts.Words, counts: np.ndarray, followers: np.ndarray, more: list[bytes]) -> pa.RecordBatch:
        n = rows.num_rows
        counts, followers = counts[words.which].astype(np.int64), followers[words.pair]
        n_words = np.bincount(words.text, minlength=n)
        known = np.bincount(words.text, weights=counts > 0, minlength=n).astype(np.int64) + (ends > 0)
        base = np.bincount(words.text, weights=np.log10(counts + add), minlength=n) + np.log10(ends + add) - (n_words + 1) * floor
        of = words.text[words.at]
        first, last = words.starts[words.at] + of, words.ends[words.at] + of  # an end is coded after each text
        state, hit = (followers >> np.uint64(1)).astype(np.uint8), (followers & np.uint64(1)).astype(bool)
        del counts, followers
        words.__dict__.clear()  # the bytes' costs need the memory
        common.release()
        if few:
            cost = costs(data, at, tables.value, mixer)
        else:
            own = Pairs(data, at, np.ones(n, bool))
            common.release()
            own_costs = costs_with(own, own.states(made, more), mixer)
            more.clear()
            places = own.places(data, at)
            del own
            common.release()
            cost = adapted(*places, own_costs)
            del places, own_costs
            common.release()
        total = np.zeros(len(cost) + 1)
        np.cumsum(cost, out=total[1:], dtype=np.float64)
        del cost
        p = follows[state]
        saved = np.where(hit, total[last] - total[first] + np.log(p), np.log1p(-p)) * (state > 0)
        edges = at + np.arange(n + 1)
        nats = total[edges[1:]] - total[edges[:-1]] - np.bincount(of, weights=saved, minlength=n)
        held = pa.array(~rows.column("_train").to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays(
            [rows.column("_id"), held, pa.array(n_words + 1), pa.array(known), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(-nats / np.log(10)), pa.array(nats / np.log(2) / (np.diff(at) + 1))],
            ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return joined.mapInArrow(lambda batches: wordcounts.each_block(batches, size, parts, each), schema).withColumnRenamed("_id", key)
