"""Fill-in-middle against a version with a regular expression, and back."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import fillmiddle

LONG = "Ab1 c\n" * 3_500_000
TEXTS = [(k, t) for k, t in enumerate([None, "", "a", "1", "ab", "a b", "Hello, World!\n", "é漢🙂x Yz", "has <P> inside", "<S>", "x<M", "<", "a<", "<S <P x>", "\x00\x00ab\x00", "zz" * 500, *(f"word{k} and 'more' {k * k}." for k in range(60))])]


def brute(key, text, seed=1, plain=10, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fillmiddle.MARKERS) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def rows(df, key="doc_id"):
    back = fillmiddle.restored(F.col("form"), F.col("output")).alias("back")
    return [(r[0], tuple(r)[1:]) for r in df.select(key, "n", "form", "prefix_chars", "middle_chars", "output", back).collect()]


@pytest.mark.parametrize(("seed", "plain", "spm"), [(1, 10, 20), (7, 0, 50), (7, 0, 0), (2, 100, 20)])
def test_against_brute_force(spark, seed, plain, spm):
    texts = [*TEXTS, (None, "no id"), (3, "ab"), (3, "ab")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = rows(fillmiddle.transform(df, seed=seed, plain=plain, spm=spm))
    assert collections.Counter(got) == collections.Counter((k, brute(k, t, seed, plain, spm)) for k, t in texts)


def test_all_forms_come(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text of words").alias("text"))
    shares = {r.form: r.n for r in fillmiddle.transform(df).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert 140 < shares["plain"] < 260 and 280 < shares["spm"] < 440 and sum(shares.values()) == 2000


def test_ids_names_and_long_texts(spark):
    df = spark.createDataFrame([("x", "some text"), (None, "other"), ("y", LONG)], "doc_id string, text string")
    odd = df.select("*", *[F.lit("clash").alias(c) for c in ("_key", "_WHOLE", "__key", "Form", "N", "output", "back")])
    out = fillmiddle.transform(odd)
    assert out.filter("_key = 'clash' AND _WHOLE = 'clash' AND __key = 'clash'").count() == 3 and [c.lower() for c in out.columns].count("form") == 1
    assert collections.Counter(rows(out)) == collections.Counter((k, brute(k, t)) for k, t in [("x", "some text"), (None, "other"), ("y", LONG)])
    assert fillmiddle.transform(df.limit(0)).count() == 0


def test_markers_that_mix_with_text(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for markers in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "b", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="markers"):
            fillmiddle.transform(df, markers=markers)
    own = ("\x01", "\x02", "\x03")
    back = fillmiddle.restored(F.col("form"), F.col("output"), own).alias("back")
    out = fillmiddle.transform(df, plain=0, markers=own).select("text", "form", back).collect()
    assert all(r.back == (r.text or "") for r in out) and sum(r.form == "plain" for r in out) == 2
