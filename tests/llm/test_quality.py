"""Quality rules where cutoffs are on: documents that they drop, the guarantee in each stratum, and repeated windows."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tarnweave.llm import quality


def test_cutoffs_drop_documents_where_labels_suffice(spark):
    rng = np.random.default_rng(21)
    plain = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**9, 30))
    odd = lambda: " ".join(f"w{x}##%" for x in rng.integers(0, 10**9, 30))
    rows = [(k, plain(), "en") for k in range(260)] + [(300 + k, odd(), "en") for k in range(40)] + [(400 + k, odd(), "de") for k in range(5)]
    rows += [(500, odd(), "en"), (501, plain(), "en"), (502, None, "en"), (503, odd(), None)]
    labels = [(k, 1) for k in range(260)] + [(300 + k, 0) for k in range(30)] + [(400 + k, 1 - k % 2) for k in range(5)] + [(501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("KEPT", F.lit("clash"))
    judged = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in judged.collect()}
    want = {k: (False, True) for k in [*range(260), *range(400, 405), 501, 503]}
    want |= {k: (False, False) for k in [*range(300, 340), 500]} | {502: (True, False)}
    assert got == want
    kept = quality.keep(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if v[1]}


def test_few_strata_lose_more_than_the_risk(spark):
    """Each of 200 strata draws 500 good documents of which known shares are above each cutoff. A rule's level is 0.05 in
    each, so about 10 of them at most may take a cutoff that loses too many."""
    above = dict(zip(quality.RULES["symbols"], (0.5, 0.3, 0.1, 0.06, 0.045, 0.04, 0.032, 0.01, 0.004)))
    risk = 0.03 * len(quality.RULES)
    u, s = F.rand(5), F.lit(0.0)
    for cut, share in sorted(above.items()):
        s = F.when(F.col("u") < share, F.lit(cut + 1e-6)).otherwise(s)
    good = spark.range(200 * 500).select((F.col("id") % 200).alias("stratum"), F.lit(True).alias("good"), u.alias("u")).withColumn("s", s).drop("u")
    bad = spark.range(200 * 50).select((F.col("id") % 200).alias("stratum"), F.lit(False).alias("good"), F.lit(0.4).alias("s"))
    more = spark.range(200 * 400).select((F.col("id") % 200).alias("stratum"), F.lit(False).alias("good"), F.lit(0.1).alias("s"))
    rows = good.union(bad).union(more).withColumns({
        "stratum": F.col("stratum").cast("string"), "n_words": F.lit(100), "word_chars": F.lit(1000), "n_symbols": 1000 * F.col("s"),
        "n_marks": F.lit(0), "n_lines": F.lit(1), "n_dup_lines": F.lit(0), "n_repeat_words": F.lit(0),
    })
    got = [r.cutoffs["symbols"] for r in quality.cutoffs(rows, risk, 0.05 * len(quality.RULES) * 200).collect()]
    assert len(got) >= 190 and sum(above[c] > 0.03 for c in got) <= 20


def test_repeated_windows_of_long_texts(spark):
    rng = np.random.default_rng(22)
    texts = [" ".join(f"{x}" for x in rng.integers(0, n, 30_000)) for n in (5, 30, 10**9)] + [" ".join("ab"[k.bit_count() % 2] for k in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality.features(df).collect():
        w = texts[r.doc_id].split()
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert r.n_repeat_words == len(again)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs, labels).count() == 0 and quality.keep(docs, labels).count() == 0
