import base64
import html
import json
from urllib.parse import quote, unquote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnweave.functions import media, text
from tarnweave.operators import history
from tarnweave.streaming import chunks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("given_", "want"), [
    ("a ```Sql\nSELECT 1\n``` b ```sql\nx```", "SELECT 1"), ("```sql x```", "x"), (" plain ", "plain"), (None, None),
])
def test_fenced(spark, given_, want):
    assert one(spark, given_, lambda x: text.fenced(x, "sql")) == want


def test_thoughts_and_blanks(spark):
    assert one(spark, "<think>a\nb</think> x <think></think>", text.without_thoughts) == "x"
    assert [one(spark, x, text.blank) for x in (None, "", "\t\n ", "a")] == [True, True, True, False]
    assert one(spark, " Ошибка: no", text.is_error)


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=12))
def test_percent_encoding(spark, x):
    assert one(spark, x, text.percent_encoded) == quote(x, safe="")
    assert one(spark, quote(x, safe=""), text.percent_decoded) == unquote(quote(x, safe=""))


def test_percent_decoding_keeps_bad_input(spark):
    assert one(spark, "100%", text.percent_decoded) == "100%"
    assert one(spark, "a+b", text.percent_decoded) == "a+b"


def test_html_json_citation(spark):
    assert one(spark, "<a href='x'>&\"", text.html_escaped) == html.escape("<a href='x'>&\"").replace("&#x27;", "&#39;")
    row = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b").select(text.json_row("a", "b")).first()[0]
    assert json.loads(row) == {"a": 1, "b": None}
    assert one(spark, " ", lambda x: text.cited(x, F.lit("f.pdf"))) == "f.pdf"
    assert one(spark, "q", lambda x: text.cited(x, F.lit("f.pdf"))) == '"q" (f.pdf)'
    assert str(one(spark, "{bad", text.json_object)) == "{}"


def test_guards(spark):
    assert [one(spark, x, text.read_only) for x in ("MATCH (n) RETURN n", "match (n) DELETE n", "MATCH (n {a: 'set'}) RETURN n")] == [True, False, True]
    assert [one(spark, x, text.latin_only) for x in ("café 7", "кафе")] == [True, False]


def test_int16(spark):
    assert one(spark, [0.5, -0.5, 2.0, -2.0, 0.00004], media.to_int16, "array<double>") == [16383, -16383, 32767, -32767, 1]


@pytest.mark.parametrize(("n", "size"), [(0, 3), (1, 3), (3, 3), (7, 3)])
def test_chunks(spark, n, size):
    x = list(range(n))
    assert one(spark, x, lambda c: media.chunks(c, size), "array<int>") == [x[i : i + size] for i in range(0, n, size)]
    assert [bytes(b) for b in one(spark, bytes(x), lambda c: media.byte_chunks(c, size), "binary")] == [bytes(x[i : i + size]) for i in range(0, n, size)]


def test_alignment_carries_a_byte(spark):
    pieces = [b"a", b"", b"bcd", b"e", b"fg"]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(pieces)], "u int, seq int, pcm binary")
    got = [bytes(r[0]) for r in media.aligned(df, "u", "seq", "pcm").orderBy("seq").select("aligned").collect()]
    assert got == [b"", b"", b"abcd", b"", b"ef"]


def test_stream_alignment(spark, tmp_path):
    rows = [("u", i, p) for i, p in enumerate([b"abc", b"d", b"efg"])] + [("v", 0, b"xy")]
    spark.createDataFrame(rows, "utt_id string, seq long, pcm binary").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("utt_id string, seq long, pcm binary").parquet(f"{tmp_path}/in")
    q = chunks.aligned(stream).writeStream.format("memory").queryName("aligned").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    got = {u: b"".join(bytes(r.pcm) for r in spark.table("aligned").filter(F.col("utt_id") == u).orderBy("seq").collect()) for u in ("u", "v")}
    assert got == {"u": b"abcdef", "v": b"xy"}


def test_sweep_and_resampling(spark):
    n, first, last = 1600, 400.0, 800.0
    got = np.array(spark.range(1).select(media.sweep(first, last, 0.1)).first()[0])
    phase = np.cumsum(np.linspace(first, last, n))
    i = np.arange(n)
    want = 0.3 * np.sin(2 * np.pi * phase / 16000) * np.minimum(1, np.minimum(i / 160, (n - 1 - i) / 160))
    assert np.allclose(got, want, atol=1e-6)
    half = one(spark, [0.0, 1.0, 2.0, 3.0], lambda x: media.resampled(x, 32000), "array<double>")
    assert half == [0.0, 2.0]


def test_wav(spark):
    x = np.array([0.0, 0.25, -0.5])
    df = spark.createDataFrame([(media.encode_wav(x),), (b"no",), (None,)], "content binary")
    got = media.decode_wav(df).select("rate", "samples").collect()
    assert got[0][0] == 16000 and np.allclose(got[0][1], x, atol=1e-4)
    assert got[1] == (None, None) and got[2] == (None, None)


def test_schedule(spark):
    df = spark.createDataFrame([("u", 0, 0.0, 0.1), ("u", 1, 0.1, 0.1), ("u", 2, 1.0, 0.1)], "u string, seq int, at double, d double")
    got = [round(r.begins, 6) for r in media.schedule(df, "u", "seq", "at", "d").orderBy("seq").collect()]
    assert got == [0.05, 0.15, 1.05]


def test_history(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "x"), (1, 4, "user", "c"), (1, 5, "assistant", "Ошибка: no"), (1, 6, "user", "e"), (1, 7, "assistant", "f")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    found = history.pairs(df)
    assert sorted((r.user, r.assistant) for r in found.collect()) == [("a", "b"), ("c", "Ошибка: no"), ("e", "f")]
    kept = history.last(history.admitted(found), 1)
    assert [(r.seq, r.role, r.content) for r in history.messages(kept).orderBy("seq").collect()] == [(1, "user", "e"), (2, "assistant", "f")]
    assert history.prompt(kept, "Before:").first()[1] == "Before:\nQuestion: e\nAnswer: f"


def test_windowed_counts(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:01:00' AS ts, 'x' AS event_type, 2.0D AS value")
    assert chunks.windowed(df).select("event_type", "n", "total").first() == ("x", 1, 2.0)


def test_wav_files_of_both_kinds(spark, tmp_path):
    rows = [(0, [0.0, 0.5, -1.0, 2.0, None]), (1, []), (2, None), (3, [float("nan"), float("inf"), 0.25])]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    for floating, want in ((True, [[0, 0.5, -1, 2, 0], [], None, [0, 1, 0.25]]), (False, [[0, 16383 / 32768, -32767 / 32768, 32767 / 32768, 0], [], None, [0, 32767 / 32768, 8191 / 32768]])):
        files = df.select("k", media.wav(F.col("x"), 8000, floating).alias("content")).orderBy("k").collect()
        folder = tmp_path / str(floating)
        folder.mkdir()
        for r in files:
            if r.content is not None:
                (folder / f"{r.k}.wav").write_bytes(bytes(r.content))
        (folder / "2.wav").write_bytes(b"none")
        read = media.decode_wav(spark.read.format("binaryFile").load(str(folder))).orderBy("path").collect()
        assert [r.samples for r in read] == want
        assert [r.rate for r in read] == [8000, 8000, None, 8000]


@pytest.mark.parametrize("n", [0, 57, 58, 300])
def test_a_data_uri_is_one_line(spark, n):
    raw = bytes(k % 256 for k in range(n))
    want = "data:image/png;base64," + base64.b64encode(raw).decode()
    assert one(spark, raw, lambda x: text.data_uri(x, "image/png"), "binary") == want
