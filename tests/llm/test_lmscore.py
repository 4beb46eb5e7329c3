"""The language model's scores against a scalar version with exact counts, and its parts against brute force."""

import collections
import math
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import common, lmscore, winnow, wordcounts

M64 = (1 << 64) - 1


def corpus():
    rng = np.random.default_rng(31)
    vocabulary = ["".join(rng.choice(list("abcd"), rng.integers(1, 6))) for _ in range(25)] + ["é", "abcdabcdabcdabcdabcdabcd"]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(3, 12)))) for k in range(60)]
    rows += [(60, rows[0][1]), (61, rows[0][1].upper()), (62, None), (63, ""), (64, " \n\t "), (None, rows[1][1])]
    return rows + [(65 + k, " ".join(rng.choice(vocabulary, 300))) for k in range(2)] + [(66, rows[2][1]), (66, rows[2][1])]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def held_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def lower(text):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())


def scatter(x):
    for down, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> down) * factor & M64
    return x ^ x >> 31


class Scalar:
    """One byte at a time, from dictionaries. Only whether a context has its slot is asked of the tables."""

    def __init__(self, rows, tables, mixer):
        self.tables, self.mixer = tables, mixer
        self.counts = collections.defaultdict(collections.Counter)
        self.follow = collections.defaultdict(collections.Counter)
        for i, t in rows:
            if not held(i):
                own = [254] * lmscore.PAD + list(lower(t)) + [255]
                for at in range(lmscore.PAD, len(own)):
                    for k in range(1, lmscore.ORDERS + 1):
                        self.counts[self.context(own, at, k)][own[at]] += 1
                w = lower(t).split()
                for at in range(3, len(w)):
                    self.follow[tuple(w[at - 3 : at])][w[at]] += 1
        hits, times = np.zeros(256), np.zeros(256)
        for words in self.follow.values():
            for w, n in words.items():
                rest = words.copy()
                rest[w] -= 1
                if sum(rest.values()):
                    top, most, others = self.top(rest)
                    hits[16 * self.level(most) + self.level(others)] += n * (top == w)
                    times[16 * self.level(most) + self.level(others)] += n
        self.p = (hits + 0.5) / (times + 1)

    @staticmethod
    def level(n):
        return max(k for k, x in enumerate(wordcounts.LEVELS) if x <= n)

    @staticmethod
    def order(word):
        """Ties go to the word whose ten bits are least."""
        data = np.frombuffer(word, np.uint8)
        return scatter(int(winnow.word_units(data, np.array([0]), np.array([len(word)]))[0]) + 1 & M64) >> 54

    def top(self, words):
        most = max(words.values())
        return min((w for w, n in words.items() if n == most), key=self.order), most, sum(words.values()) - most

    @staticmethod
    def context(own, at, k):
        return k, tuple(own[at - k : at])

    @staticmethod
    def hash(own, at, k):
        """As the tables have it."""
        return scatter(sum(x << 8 * j for j, x in enumerate(own[at - k : at])) | k << 56)

    def has_slot(self, h, k, nibble):
        made = self.tables.shape
        h, bits = h >> 64 - made.hash << 64 - made.hash, made.bits[k - 1]
        slot, check = h >> 64 - bits, h >> 36 & 255
        if nibble is not None:
            own = scatter(h + nibble + 1 & M64)
            slot, check = (h >> 64 - made.shard << bits - made.shard) | own >> 64 - bits + made.shard, own >> 12 & 255
        row = self.tables.flat[k - 1][slot]
        return row[0] == check and row[1] != 0

    def byte(self, own, at):
        """The cost of a byte in each setting."""
        bits = [own[at] >> 7 - j & 1 for j in range(8)]
        x, gate = np.zeros((lmscore.ORDERS, 8)), 0
        for k in range(1, lmscore.ORDERS + 1):
            seen, h = self.counts[self.context(own, at, k)], self.hash(own, at, k)
            if sum(seen.values()) < lmscore.SEEN:
                continue
            for half in (0, 1):
                if self.has_slot(h, k, own[at] >> 4 if half else None):
                    for j in range(4 * half, 4 * half + 4):
                        n = [sum(c for b, c in seen.items() if b >> 8 - j == own[at] >> 8 - j and b >> 7 - j & 1 == v) for v in (0, 1)]
                        n = [wordcounts.LEVELS[self.level(c)] for c in n]
                        x[k - 1, j] = round(max(-8, min(8, math.log((n[bits[j]] + 0.4) / (n[1 - bits[j]] + 0.4)))) * lmscore.SCALE)
            if x[k - 1, :4].any():
                gate = k
        gate += (lmscore.ORDERS + 1) * bool(lmscore._GAP[own[at - 1]])
        parts = np.array([(self.mixer.weights[p, gate] * x[p]).sum(0) for p in lmscore.PARTS])
        z = parts.sum(0)
        cell = np.minimum(np.abs(z) * 2, lmscore.BINS - 1).astype(int)
        trained = (z + np.sign(z) * self.mixer.map[np.arange(8), cell]) / 2
        return [np.log1p(np.exp(-np.clip(trained + s @ parts, -10, 10))).sum() for s in lmscore.SETTINGS]

    def score(self, text):
        data = lower(text)
        own, nats, weigh, each = [254] * lmscore.PAD + list(data) + [255], [], lmscore.AT_FIRST.astype(float), []
        for at in range(len(data) + 1):
            if at == lmscore.FIRST or at > lmscore.FIRST and at & at - 1 == 0:
                weigh, each = weigh - np.sum(each, 0), []
            each.append(self.byte(own, at + lmscore.PAD))
            share = np.exp(weigh - weigh.max())
            nats.append(-math.log((share / share.sum()) @ np.exp(-np.array(each[-1]))))
        total, at, words = sum(nats), 0, []
        for w in data.split():
            at = data.index(w, at)
            words.append((w, sum(nats[at : at + len(w)])))
            at += len(w)
        for k in range(3, len(words)):
            seen = self.follow.get(tuple(w for w, _ in words[k - 3 : k]), {})
            if sum(seen.values()) >= 2:
                top, most, others = self.top(seen)
                p = self.p[16 * self.level(most) + self.level(others)]
                total += -math.log(p) - words[k][1] if top == words[k][0] else -math.log1p(-p)
        return -total / math.log(10)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("SCORE", F.lit("clash"))


def test_scores_are_those_of_a_scalar_version(spark, rows, df):
    got = collections.defaultdict(list)
    for r in lmscore.score(df, held_column()).collect():
        got[r.doc_id].append(r)
    docs = df.select((~held_column()).alias("_train"), F.col("text").alias("_text"))
    size = sum(len(lower(t)) for i, t in rows if not held(i))
    made = lmscore.shape(size)
    tables = lmscore.Tables(made).fill(lmscore.merged(lmscore.gathered(docs, made), made).toLocalIterator())
    mixer = lmscore.learnt(docs, spark.sparkContext.broadcast(tables))
    scalar = Scalar(rows, tables, mixer)
    used = sum(f[:, 1].astype(bool).sum() for f in tables.flat)
    assert used > 1000
    for i, t in rows:
        want = scalar.score(t)
        assert min(abs(r.score - want) for r in got[i]) < 2e-4 * (1 + abs(want))
    for i, t in rows:
        assert all(r.bits_per_byte > 0 for r in got[i])


def test_base_scores(rows, df):
    tokens = [(i, [*lower(t).split(), None]) for i, t in rows]
    counts = collections.Counter(x for i, own in tokens if not held(i) for x in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(own), sum(counts[x] > 0 for x in own), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), 6)) for i, own in tokens)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lmscore.score(df, held_column()).collect())
    assert got == want


def test_followers_in_small_ranges(df, monkeypatch):
    plain = sorted((str(r.doc_id), round(r.score, 6)) for r in lmscore.score(df, held_column()).collect())
    monkeypatch.setattr(wordcounts, "RANGE_BYTES", 64)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in lmscore.score(df, held_column()).collect()) == plain


def test_without_training_texts_and_without_texts(spark):
    df = spark.createDataFrame([(1, "Abc d"), (2, None)], "doc_id long, text string")
    for r in lmscore.score(df, F.lit(True)).collect():
        assert r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and abs(r.bits_per_byte - 8) < 1e-5
    assert lmscore.score(df.limit(0), F.lit(True)).count() == 0


def test_copies_score_apart_and_long_texts_in_pieces(spark):
    rng = np.random.default_rng(32)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    long = " ".join(word() for _ in range(250_000))
    assert len(long) > lmscore.PIECE
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:10], long, "x" * 3_000_000])), "doc_id int, text string")
    got = {r.doc_id: r.bits_per_byte for r in lmscore.score(df, F.lit(False)).collect()}
    twice, once = [got[k] for k in range(10)], [got[k] for k in range(10, 40)]
    assert max(twice) < 0.6 * min(once) and got[51] < 0.1


def test_parts():
    rng = np.random.default_rng(33)
    for keys in (rng.integers(0, 400, 3000).astype(np.uint64) << np.uint64(45), rng.integers(0, 1 << 56, 3000).astype(np.uint64), np.zeros(0, np.uint64)):
        found, which = lmscore.alike(keys)
        assert (found[which] == keys).all() and len(found) == len(np.unique(keys)) and (found[1:] > found[:-1]).all()
        found, which = wordcounts.different(keys)
        assert (found[which] == keys).all() and (found == np.unique(keys)).all()
    close = np.array([5, 1, 3, 1, 2, 5, 4] * 50, np.uint64) + np.uint64(1 << 63)  # these agree in their first bits
    assert (wordcounts.different(close)[0] == np.unique(close)).all()
    for n in (0, 1, 255, 256, 257, 70_000):
        x = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (wordcounts.unpack_sorted(wordcounts.pack_sorted(x)) == x).all()
    data, at = np.frombuffer(b"abcdefghij" * 30, np.uint8), np.array([0, 100, 100, 300])
    joined = [bytes(s.out[s.coded]) for s in lmscore.pieces(data, at, 50)]
    assert b"".join(joined) == bytes(data[:100]) + b"\xff\xff" + bytes(data[100:]) + b"\xff"


def test_words_of_two_letters_in_a_clever_order_are_told_apart():
    """Polynomial hashes modulo a power of two give these the same value, whatever their base."""
    for long in (1024, 4096):
        a = bytes(97 + k.bit_count() % 2 for k in range(long))
        data, at = common.raw(pa.array([f"{a.decode()} {a.translate(bytes.maketrans(b'ab', b'ba')).decode()} {a.decode()}"]))
        starts, ends, _ = common.word_bounds(data, at)
        h = winnow.word_units(data, starts, ends)
        assert h[0] != h[1] and h[0] == h[2]


def test_contexts_that_are_exchanged_score_as_those_in_tables(spark, rows, df, monkeypatch):
    docs = df.select((~held_column()).alias("_train"), F.col("text").alias("_text"))
    made = lmscore.shape(sum(len(lower(t)) for i, t in rows if not held(i)))
    tables = lmscore.Tables(made).fill(lmscore.merged(lmscore.gathered(docs, made), made).toLocalIterator())
    mixer = lmscore.learnt(docs, spark.sparkContext.broadcast(tables))
    learnt = []
    monkeypatch.setattr(lmscore, "TABLES", 0)
    monkeypatch.setattr(wordcounts, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lmscore, "learnt_from_blocks", lambda *a, f=lmscore.learnt_from_blocks: learnt.append(f(*a)) or mixer)
    got = collections.defaultdict(list)
    for r in lmscore.score(df, held_column()).collect():
        got[r.doc_id].append(r.score)
    scalar = Scalar(rows, tables, mixer)
    for i, t in rows:
        want = scalar.score(t)
        assert min(abs(x - want) for x in got[i]) < 2e-4 * (1 + abs(want))
    seen = learnt[0].weights != lmscore.Mixer().weights
    assert (seen == (mixer.weights != lmscore.Mixer().weights)).all()


def test_no_context_is_dropped_however_many_there_are(spark):
    """1.5 million contexts of five and of six bytes, each there twice: more than tables of 2 ** 18 slots can have."""
    rng = np.random.default_rng(34)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 50_000)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts])), "doc_id int, text string").repartition(4)
    for r in lmscore.score(df, F.lit(False)).collect():
        assert r.bits_per_byte < 1.5
    assert lmscore.shape(30 << 30).bits == (lmscore.shape(30 << 30).hash,) * lmscore.ORDERS


def test_answers_are_packed_by_whole_states():
    """Ranges answer with the states of a pair's decisions, as one number, and not with ten counts."""
    rng = np.random.default_rng(35)
    for n in (0, 1, 40_000):
        n_of, made = rng.geometric(0.4, n), lmscore.shape(100 << 20)
        key = np.unique(rng.integers(0, 1 << made.hash + 8, n).astype(np.uint64))
        (_, more), n_of = lmscore.asked(made), n_of[: len(key)]
        back = more(5 << made.shard, key, n_of)
        assert back.dtype == np.uint64 and len(back) == len(key)
        assert (back.view(np.uint8).reshape(-1, 8) == lmscore.levels_of(lmscore.ways(key, n_of, 5, made).T)).all()
        packed = wordcounts.pack_alike(back)
        assert (wordcounts.unpack_alike(packed) == back).all() and len(packed) < 0.4 * n + 200


def test_answers_leave_out_what_neighbours_tell():
    """A context's pairs share the first nodes of their ways: what the pair before tells isn't sent."""
    rng = np.random.default_rng(36)
    made = lmscore.shape(100 << 20)
    context = np.sort(rng.integers(0, 1 << made.hash, 8_000).astype(np.uint64))
    key = np.unique(np.repeat(context, 5) << np.uint64(8) | rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ,\xff\xc3\xa9", np.uint8), 40_000).astype(np.uint64))
    (ask, answer, brief), n = lmscore.asked(made), rng.geometric(0.3, len(key))
    back = answer(5 << made.shard, key, n)
    some = np.flatnonzero(rng.random(len(key)) < 0.7)  # a block has some of a range's pairs
    for own in (some[:0], some[:1], some):
        assert (lmscore.with_told(key[own], brief(key[own], back[own])) == back[own]).all()
    assert len(wordcounts.pack_alike(brief(key[some], back[some]))) < 0.7 * len(wordcounts.pack_alike(back[some]))


def test_pairs_of_a_block(monkeypatch):
    monkeypatch.setattr(lmscore, "PIECE", 100)
    rng = np.random.default_rng(37)
    texts = [bytes(rng.choice(list(b"aB c"), n)).decode() for n in (0, 1, 250, 7, 100, 3000, 0)]
    data, at = common.raw(pa.array(texts))
    train = np.array([True, False, True, True, False, True, True])
    steps = list(lmscore.pieces(data, at))
    every, begin, text = np.concatenate([lmscore.pairs(s) for s in steps]), steps[0].begin, np.repeat(np.arange(7), np.diff(at) + 1)
    assert len(steps) == 1
    for most in (1 << 18, 300, 7):
        assert (np.concatenate([x for x, _ in lmscore.pairs_in_order(data, at, train, most)]) == every).all()
    monkeypatch.setattr(lmscore, "pairs_in_order", lambda *a, f=lmscore.pairs_in_order: f(*a, 64))
    for most in (1 << 20, 500):
        monkeypatch.setattr(lmscore, "SORTED", most)
        own = lmscore.Pairs(data, at, train)
        assert (own.key == np.unique(every)).all() and (own.n == [(every[train[text]] == x).sum() for x in own.key]).all()
        which, first = own.places(data, at)
        assert (own.key[which] == every).all() and (first == begin).all()


def test_keys_that_agree_in_their_first_bits_are_told_apart_in_order():
    rng = np.random.default_rng(38)
    keys = rng.integers(0, 1 << 14, 50_000).astype(np.uint64) + (rng.integers(0, 2, 50_000).astype(np.uint64) << np.uint64(63))
    for some in (keys, keys[:1], keys[:0], np.full(9, 5, np.uint64), np.append(keys, np.uint64(0))):
        found, which = wordcounts.different(some)
        assert (found == np.unique(some)).all() and (found[which] == some).all()


def test_the_first_exchange_leaves_no_files(spark, tmp_path):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (found.apply(k).getName() for k in range(found.size())) if x.startswith("shuffle_")}

    had, before = files(), spark.conf.get(common.FILE_CLEANUP, None)
    held = spark.range(1000).repartition(3, "id")  # a plan that can be read again keeps its files from a collection
    with common.shuffles_once(spark):
        held.write.parquet(f"{tmp_path}/out")
    for _ in range(50):
        if files() <= had:
            break
        time.sleep(0.1)
    assert files() <= had and spark.conf.get(common.FILE_CLEANUP, None) == before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000 and held.count() == 1000
