"""Every stage of the pipeline against a brute-force version, with nulls, empty texts, repeated rows and ids, and empty tables."""

import base64
import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tarnweave.llm import common, embeddings, mixing, queries, quality, simhash, substring, suffix, urlfilter, webpage

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(51)
    word = lambda: f"w{rng.integers(0, 4000)}"
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(rng.integers(60, 200))) for _ in range(30)]
    texts += [texts[0] + " one more", texts[1].upper(), texts[2].replace(" ", "\n", 3), f"{texts[3]}\n{passage}", f"{passage} and\t{texts[4]}", f"x\n\n{passage}", None, "", " \n ", "few words", texts[5], texts[5]]
    texts += ["again and again and again and again and again and again and again", "# $ % " * 30, "漢字 é 🙂 " + texts[6]]
    rows = [(k, t, ["en", "de", None][k % 3], [f"s{k % 2}", None][k % 7 == 0], len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (None, texts[7] + " null", "en", "s0", 5), rows[8], (9, "another text of a used id " + texts[10][:200], "en", "s1", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (777, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def words(t):
    return (t or "").encode().split()


def bag(found):
    return collections.Counter(tuple(r) for r in found)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "repeated passages", "mix", "tokens"]


def test_good(spark, docs, rows, sf_dir):
    def failed(t):
        w = words(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        return len(w) < 10 or 100 * len(again) > 20 * len(w)

    got = corpus_pipeline.good(spark, docs, sf_dir)  # so few labels leave all cutoffs off; test_quality.py has them on
    assert bag(got.collect()) == bag(r for r in rows if not failed(r[1]))


def test_different(spark, docs, rows):
    sets = [set(simhash.shingle_hashes(r[1], 5)) for r in rows]
    label = list(range(len(rows)))
    for _ in range(6):
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = corpus_pipeline.different(spark, docs, "").collect()
    groups = {k: [r for r, own in zip(rows, label) if own == k] for k in set(label)}
    assert len(got) == len(groups) and not bag(got) - bag(rows)
    least = {min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()}
    assert {r.doc_id for r in got} == least


def test_unrepeated(spark, docs, rows):
    order = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), order(i))
    want = collections.Counter()
    for i, t, lang, source, _ in rows:
        data, w, at, kept, gone = (t or "").encode(), words(t), 0, b"", set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone.update(range(k, k + 50))
        for k, x in enumerate(w):
            begin = data.index(x, at)
            kept += b"" if k in gone else data[at : begin + len(x)]
            at = begin + len(x)
        kept = kept if gone else data
        want[(i, kept.decode(), lang, source, len(kept.decode()))] += 1
    assert bag(corpus_pipeline.unrepeated(spark, docs, "").collect()) == want


def test_mixed(spark, docs, rows):
    def weight(t):
        n = len(t or "")
        return 1 - 0.9 * min(1.0, 10 * sum(c in "#*$%&|<>" for c in t) / n) if n else 1.0

    def key(i, t):
        u = (int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -math.log(u) / max(weight(t), mixing.LEAST_WEIGHT)

    sources = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    w = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * w[s] > 2 * size[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    want = collections.Counter()
    for s in sources:
        own = sorted((key(r[0], r[1]), r[0] is not None, r[0] or 0, len(words(r[1])), r) for r in rows if r[3] == s)
        epochs, before = min(2, int(target[s] // size[s])) if size[s] else 0, 0
        for *_, n, r in own:
            want[r] += epochs + (epochs < 2 and before + n / 2 <= target[s] - epochs * size[s])
            before += n
    got = bag(corpus_pipeline.mixed(spark, docs, "").collect())
    assert got == +want and got.total() > len(rows)


def test_tokens(spark, docs, rows):
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids), r.exact) for r in corpus_pipeline.tokens(spark, docs, "").collect())
    assert got == collections.Counter((i, s, len(ids := tuple(known.encode_ordinary(t or ""))), ids, True) for i, t, _, s, _ in rows)


def test_empty_tables(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    few = docs.limit(0)
    assert queries.tokenised(few).count() == 0 and simhash.near_duplicates(few).count() == 0 and mixing.mix(few).count() == 0
    assert substring.remove_repeats(few).count() == 0 and suffix.remove_later_copies(few).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    assert webpage.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clashing_columns(spark, docs, rows):
    odd = docs.select("doc_id", "text", "source", "lang", *[F.lit("clash").alias(c) for c in ("ids", "FP", "Size", "TARGET", "n_words", "N_BYTES", "spans", "_d", "_t", "_o0", "_mark", "kept", "stratum", "a", "b")])
    assert simhash.near_duplicates(odd).count() == len(rows)
    mixed = mixing.mix(odd)
    assert mixed.count() == len(rows) and dict(mixed.dtypes)["size"] == "bigint"
    assert suffix.remove_later_copies(odd).filter("n_bytes >= 0 AND _d = 'clash'").count() == len(rows)
    assert substring.remove_repeats(odd).filter("n_words >= 0 AND _o0 = 'clash'").count() == len(rows)
    helpers = ("_s", "_S", "_key", "_bin", "_own_bin", "_in_bin", "_bin_before", "bin_before", "bin", "bin_size", "_source", "__key", "_url_lower", "__URL_lower")
    more = docs.select("doc_id", "text", "source", *[F.lit("clash").alias(c) for c in helpers if c != "_S"])
    out = mixing.mix(more)
    assert set(more.columns) < set(out.columns) and out.filter(" AND ".join(f"`{c}` = 'clash'" for c in helpers)).count() == len(rows)
    assert bag(out.select("doc_id", "source", "size", "target", "taken").collect()) == bag(mixed.select("doc_id", "source", "size", "target", "taken").collect())
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    assert quality.judge(odd, labels).filter("kept OR NOT kept").count() == len(rows)
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    assert sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors).collect()) == [("2", 2, 2, True), ("2", 2, 2, True), ("3", 0, 3, True), ("None", 2, 2, False)]
    pages = spark.createDataFrame([(1, "http://a.com/x")] * 2, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("Verdict", "_url_lower", "__url_LOWER", "_S")})
    assert [r.verdict for r in urlfilter.judge(pages, queries.URL_RULES).collect()] == ["allow", "allow"]


def test_hot_keys_in_salts(spark):
    left = spark.createDataFrame([(7, k) for k in range(50)] + [(k, k) for k in range(5)] + [(None, 1)], "fp long, x int")
    right = left.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("n"), F.min("x").alias("m"))
    got = common.join_hot(left, right, "fp", "n", most=3)
    assert bag(got.select("fp", "x", "m").collect()) == bag([(7, k, 0) for k in range(50)] + [(k, k, k) for k in range(5)])


def test_the_shared_folder(spark, monkeypatch):
    class Session:
        def __init__(self, master, folder=None):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder} if folder else {}, type("Context", (), {"master": master})

    assert common.shared_dir(Session("spark://x:7077", "hdfs://y/z")) == "hdfs://y/z"
    assert common.shared_dir(Session("local[4]")).startswith("file://")
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Session(master))
