"""Hard negatives against all scores of all anchors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import negatives


def brute(rows, positives=5, negative=3, least=50, most=95, scale=256, every=5):
    good = []
    for key, vector, label in rows:
        if label is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            good.append((key, [math.floor(scale * x) for x in vector], label))
    anchors = {}
    for key, vector, label in good:
        if key is not None and key % every == 0:
            anchors[key] = min(anchors.get(key, (label, vector)), (label, vector))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (label, vector) in anchors.items():
        scored = [(sum(x * y for x, y in zip(vector, v, strict=True)), k, own) for k, v, own in good if k != a and len(v) == len(vector)]
        for p, k, _ in sorted((x for x in scored if x[2] == label), key=order)[:positives]:
            fit = sorted((x for x in scored if x[2] != label and least * p <= 100 * x[0] <= most * p), key=order)[:negative]
            out += [(a, k, r, n, p, s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def vectors(seed, n, size=6, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, size))
    return [(k, [float(np.float32(x)) for x in centres[k % 5] * 0.4 + rng.normal(0, spread, size)], int(rng.integers(labels))) for k in range(n)]


def got(df, **how):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0, **how).collect()), key=repr)


ODD = [
    (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [0.5, 2.0], 1), (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (7, [0.7, 1.5], 2), (8, [0.7, 1.5], 2), (9, [0.7, 1.5], 2), (4, [0.7, 1.5], 2),
    (10, None, 1), (11, [], 1), (12, [None, 1.0], 1), (13, [math.nan, 1.0], 2), (14, [math.inf, 1.0], 2), (15, [1.0, 1.0], None), (None, [0.7, 1.5], 2), (None, [1.0, 2.0], 1),
    (20, [0.0, 0.0], 3), (21, [0.0, 0.0], 3), (22, [0.0, 0.0], 1), (25, [-1.0, -1.0], 4), (26, [1.0, 1.0], 4), (30, [1.0, 2.0, 3.0], 1), (31, [1.0, 2.0, 2.0], 1), (32, [1.0, 1.5, 1.0], 2), (35, [1.0], 9),
]


def test_nulls_ties_and_repeats(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int").repartition(3)
    want = brute(ODD)
    assert len(want) > 10 and got(df.withColumns({c: F.lit("clash") for c in ("id", "row", "VEC", "block", "positives")})) == want


@pytest.mark.parametrize(("how", "labels", "spread"), [({"block": 7, "unit": 40, "pivots": 9}, 3, 1.0), ({"pivots": 16, "block": 20}, 3, 0.05), ({"pivots": 1}, 200, 1.0), ({"unit": 33, "positives": 2, "negatives": 7, "least": 10, "most": 100}, 2, 0.3)])
def test_any_cut_into_blocks_and_units(spark, monkeypatch, how, labels, spread):
    monkeypatch.setattr(negatives, "SAMPLE_CELLS", 60)
    rows = vectors(len(how), 400, labels=labels, spread=spread)
    rows += [(1000 + k, rows[3][1], 1) for k in range(150)]  # one label holds many copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    own = {k: how[k] for k in ("positives", "least", "most") if k in how}
    want = brute(rows, negative=how.get("negatives", 3), **own)
    assert len(want) > 50 and got(df, **how) == want


def test_blocks_are_bounded_and_bounds_prune(spark):
    """Anchors far from each other: a row goes to few of the blocks."""
    counts = np.array([5, 0, 3, 9, 1])
    between = np.abs(np.subtract.outer(np.arange(5), np.arange(5)))
    group = negatives.grouped(counts, between, 9)
    assert group[1] == -1 and sorted(counts[group == g].sum() for g in set(group[group >= 0])) == [1, 8, 9] or max(counts[group == g].sum() for g in set(group[group >= 0])) <= 9
    rng = np.random.default_rng(0)
    centres = np.eye(8) * 4
    rows = [(k, (centres[k % 8] + rng.normal(0, 0.02, 8)).tolist(), k // 8 % 2) for k in range(640)]
    routed = []
    real = negatives.compared
    negatives.compared = lambda units, join: routed.append(units.filter("row = 1").count()) or real(units, join)
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert got(df, pivots=32, block=16) == brute(rows)
    finally:
        negatives.compared = real
    assert all(n < 640 * 4 for n in routed), routed


def test_labels_of_any_type_and_empty_tables(spark):
    rows = vectors(9, 60)
    df = spark.createDataFrame([(k, v, "abc"[x]) for k, v, x in rows], "vec_id long, embedding array<double>, label string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == [] and negatives.mine(df, F.lit(False)).count() == 0
    large = spark.createDataFrame([(5, [1e200, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="too large"):
        got(large)
