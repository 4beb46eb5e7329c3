"""Silence, against a version sample by sample; and what parts a recording in chunks, ranges and blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import silence
from tarnweave.operators.silence import Gate

GATE = Gate(size=4, high=0.5, low=0.2, least_speech=2, least_gap=2)
KIND = "who string, seq int, x array<double>, n int, start string, block int"


def plain(samples, gate):
    """Segments (first frame, frames), one frame after another."""
    on, states = False, []
    for i in range(0, len(samples), gate.size):
        part = samples[i : i + gate.size]
        energy = sum(v * v for v in part) / len(part)
        on = True if energy >= gate.high else False if energy < gate.low else on
        states.append(on)
    loud = [i for i, s in enumerate(states) if s]
    found = []
    for i in loud:
        if found and i - found[-1][1] - 1 < gate.least_gap:
            found[-1][1] = i
        else:
            found.append([i, i])
    return [(a, b - a + 1) for a, b in found if b - a + 1 >= gate.least_speech]


def recordings(seed):
    rng = random.Random(seed)
    out = {}
    for who, n in (("a", 700), ("b", 3), ("c", 256), ("hot", 3000)):
        x, loud = [], 0.1
        while len(x) < n:
            loud = rng.choice([0.1, 0.6, 1.0, loud])
            x += [rng.choice([-1, 1]) * loud for _ in range(rng.randrange(1, 14))]
        out[who] = x[:n]
    return out


def cut(rng, whole):
    rows = []
    for who, x in whole.items():
        i = seq = 0
        while i < len(x):
            n = rng.randrange(0, 12)
            rows.append((who, seq, x[i : i + n], 1, "s", 2))
            i, seq = i + n, seq + 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_segments_and_samples(spark, monkeypatch, block):
    monkeypatch.setattr(silence, "BLOCK", block)
    whole = recordings(block)
    df = spark.createDataFrame(cut(random.Random(1), whole), KIND).repartition(5)
    got = {}
    for r in silence.segments(df, "who", "seq", "x", GATE).collect():
        got.setdefault(r.who, []).append((r.first_frame, r.n_frames))
    want = {who: plain(x, GATE) for who, x in whole.items() if plain(x, GATE)}
    assert {who: sorted(v) for who, v in got.items()} == want and sum(map(len, want.values())) > 20
    left = {}
    for r in silence.without_silence(df, "who", "seq", "x", GATE).orderBy("who", "start").collect():
        left.setdefault(r.who, []).extend(r.x)
    assert left == {who: [v for a, n in want[who] for v in whole[who][4 * a : 4 * (a + n)]] for who in want}


def test_odd_rows(spark):
    loud = [1.0] * 8
    rows = [("a", 0, loud, 0, "", 0), ("a", 0, loud, 0, "", 0), ("a", 1, None, 0, "", 0), ("a", 2, [], 0, "", 0), ("a", 3, [None, math.nan] * 8, 0, "", 0), (None, 1, loud, 0, "", 0), ("b", None, loud, 0, "", 0), ("c", 1, [0.0] * 9, 0, "", 0)]
    df = spark.createDataFrame(rows, KIND)
    assert [tuple(r) for r in silence.segments(df, "who", "seq", "x", GATE).collect()] == [("a", 0, 4)]
    assert silence.segments(df.filter("who = 'z'"), "who", "seq", "x", GATE).count() == 0
    assert silence.without_silence(df.filter("who = 'z'"), "who", "seq", "x", GATE).count() == 0
    with pytest.raises(ValueError, match="low"):
        Gate(high=0.1, low=0.2)


def test_hot_recording_is_cut(spark):
    """A recording that is all of the rows lies in several ranges."""
    df = spark.range(4000).select(F.lit("a").alias("who"), F.col("id").alias("seq"), F.array(F.lit(1.0)).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = silence.placed(df, "who", "seq", "x")
        assert at.filter("start <> place").count() == 0
        parts = df.repartitionByRange("who", "seq", "x").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
