"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, repeats and clashes."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tarnweave.llm import bpe, buckets, embeddings, lmscore, mixing, passages, quality, simhash, substring, suffix, urlfilter, webpage
from tarnweave.llm.components import components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(4000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog. " * 3), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG + " end"), (6, f"a b c {PASSAGE} d e"),
    (7, f"other {PASSAGE} tail é ß 漢字 🙂"), (8, "one two"), (9, "one two"), (10, LONG), (11, "#tag $$ | a\nb\nb\n\na b c d e a b c d e x"), (None, f"{PASSAGE}"), (12, "x " * 300),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], f"s{k % 2}" if k % 5 else None) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def words(text):
    return (text or "").encode().split()


def order(i):
    return 1 << 63 if i is None else i


def reach(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_bpe_equals_the_library_and_inverts(docs):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs.withColumn("IDS", F.lit(1)), PATH, public_tokenizers.PATTERN), PATH)
    for r in out.collect():
        assert list(r.ids) == known.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def brute_fingerprint(text, width):
    w = words((text or "").encode().lower().decode())
    grams = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("width", "near"), [(4, 4), (5, 7)])
def test_simhash(docs, width, near):
    prints = [brute_fingerprint(t, width) for _, t in TEXTS]
    links = [(a, b) for a in range(len(TEXTS)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= near]
    label = reach(len(TEXTS), links)
    least = {k: min((i for (i, _), own in zip(TEXTS, label) if own == k and i is not None), default=None) for k in label}
    want = collections.Counter((i, p, least[k]) for (i, _), p, k in zip(TEXTS, prints, label))
    got = simhash.near_duplicates(docs, width=width, near=near)
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == want
    kept = simhash.deduplicate(docs, width=width, near=near).collect()
    assert len(kept) == len(set(label)) and {r.doc_id for r in kept} == set(least.values())


def test_links_of_random_fingerprints_also_in_split_buckets(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 62, 12)
    prints = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, k % 5)) for c in centres for k in range(30)})
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    all_links = [(a, b) for a in range(len(prints)) for b in range(a) if ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 4]
    want = reach(len(prints), all_links)
    for most in (4096, 8):
        found = {(r.a, r.b) for r in simhash.links(df, 4, most).collect()}
        at = {p: k for k, p in enumerate(prints)}
        assert reach(len(prints), [(at[a], at[b]) for a, b in found]) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (1, 2), (2, 1)]
    label = reach(461, [(a, b) for a, b in edges])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == label[k] for k in range(461))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_rules_and_terms(spark):
    rules = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"))
    cases = [
        ("http://Example.com/en/7x?q", "example.com", "/en/7x", "example.com/en/7", "allow"), ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"),
        ("https://notcom/en/", "notcom", "/en/", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("http://casino.net", "casino.net", "", None, "block"),
        ("http://mycasinos1.net", "mycasinos1.net", "", None, "allow"), ("http://free.net/cheap", "free.net", "/cheap", None, "block"), ("http://free.net/free", "free.net", "/free", None, "allow"),
        ("x://b.org#/es/", "b.org", "", None, "allow"), ("a://b.org/es/://c.net/x", "b.org", "/es/://c.net/x", "org/es/", "block"),
    ]
    df = spark.createDataFrame([(k, c[0], "clash") for k, c in enumerate(cases)], "page_id int, url string, HOST string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_many_url_rules_against_trying_each(spark):
    rng = np.random.default_rng(5)
    word = lambda: "ab"[rng.integers(2)] * int(rng.integers(1, 3))
    rules = [(("allow", "block")[rng.integers(2)], ".".join(word() for _ in range(rng.integers(1, 4))), "/" * int(rng.integers(2)) + "/".join(word() for _ in range(rng.integers(0, 3)))) for _ in range(3000)]
    rules += [("block", "", "/a"), ("allow", "b..a", "")]
    urls = [f"http://{'.'.join(word() for _ in range(rng.integers(1, 5)))}/{'/'.join(word() for _ in range(rng.integers(0, 4)))}" for _ in range(400)] + ["http://aa", "http://.a/b", "http://b..a/", "http:///a"]

    def want(url):
        host, _, path = url[7:].partition("/")
        path = "/" + path if "/" in url[7:] else ""
        fit = [(-len(h + p), -len(h), a, h + p) for a, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (min(fit)[3], min(fit)[2]) if fit else (None, "allow")

    got = {r.url: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame([(u, "x") for u in urls], "url string, _input0 string"), rules, terms=()).collect()}
    assert got == {u: want(u) for u in urls}
    assert len({x for x in got.values()}) > 50
    with pytest.raises(ValueError):
        urlfilter.Rules([("deny", "a", "")])


def test_weighted_terms(spark):
    terms = (("sure", "strict", 1.0), ("mild", "soft", 0.5), ("half", "soft", 1.5), ("much", "soft", 3.0), ("Sure", "soft", 9.0), ("", "strict", 1.0))
    cases = {"http://a-sure.net": "block", "http://surely.net": "allow", "http://much.net": "allow", "http://mild.net/mild": "allow", "http://mild.net/half": "block", "http://x.net/mild_much": "block", "http://x.net/MILD.much9": "allow"}
    df = spark.createDataFrame(list(cases.items()), "url string, want string").withColumn("Soft_Weight", F.lit("clash"))
    assert all(r.verdict == r.want for r in urlfilter.judge(df, (), terms=terms).collect())
    # hosts that no fixture has
    more = {"http://gratis-kredit.example": "block", "http://hentai.example": "block", "http://top.example/best/online": "allow", "http://paris.example/online": "allow", "http://apuestas.example/bonus": "block"}
    df = spark.createDataFrame(list(more.items()), "url string, want string")
    assert all(r.verdict == r.want for r in urlfilter.judge(df, ()).collect())


def brute_features(text):
    t = text or ""
    w = words(t)
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_features_and_verdict(spark, docs):
    labels = spark.createDataFrame([(0, 1), (4, None), (99, 0)], "doc_id long, quality int")
    got = collections.Counter(tuple(r) for r in quality.judge(docs, labels).select("doc_id", *quality.BASE, "base_failed", "kept").collect())
    want = collections.Counter()
    for i, t in TEXTS:
        f = brute_features(t)
        failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
        want[(i, *f, failed, not failed)] += 1
    assert got == want
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_binomial_bound(spark):
    def exact(k, n, p):
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    cases = [(0, 10), (3, 1000), (12, 1000), (900, 50_000), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long")
    for (k, n), (p,) in zip(cases, df.select(quality.at_most("k", "n", 0.02)).collect()):
        assert p == pytest.approx(exact(k, n, 0.02) if k < n * 0.02 else 1.0, rel=1e-6)


def test_cutoffs_pass_only_where_few_good_ones_go(spark):
    rows = [("en", True, 0.0)] * 900 + [("en", False, 0.1)] * 100 + [("de", True, 0.0)] * 50 + [("de", False, 0.1)] * 50
    rows += [("fr", True, 0.1)] * 900 + [("fr", False, 0.1)] * 100
    df = spark.createDataFrame(rows, "stratum string, good boolean, s double")
    df = df.withColumns({"n_words": F.lit(100), "word_chars": F.lit(1000), "n_symbols": 1000 * F.col("s"), "n_marks": F.lit(0), "n_lines": F.lit(1), "n_dup_lines": F.lit(0), "n_repeat_words": F.lit(0)})
    got = {r.stratum: r.cutoffs for r in quality.cutoffs(df).collect()}
    assert got["en"]["symbols"] == 0.08 and "de" not in got and got["fr"]["symbols"] == 0.3


def test_substring_dedup(docs):
    first = {}
    for i, t in sorted(TEXTS, key=lambda x: order(x[0])):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), order(i))
    want = collections.Counter()
    for i, t in TEXTS:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone.update(range(k, k + 50))
        want[(i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())] += 1
    got = substring.remove_repeats(docs.withColumn("N_WORDS", F.lit("clash")).drop("lang", "source"))
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == want
    layout = {r.doc_id: r.kept_text for r in substring.remove_repeats(docs, layout=True).collect()}
    assert layout[7] == "other tail é ß 漢字 🙂" and layout[11] == TEXTS[11][1]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup(docs):
    seen, want = set(), collections.Counter()
    for i, t in sorted(TEXTS, key=lambda x: order(x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), kept)] += 1
    got = suffix.remove_later_copies(docs)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in got.collect()) == want


@pytest.mark.parametrize("depth", [3, 7, 9, 14, 40, 100])
def test_previous_factors(depth):
    rng = np.random.default_rng(3)
    part = rng.integers(97, 99, 130).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 99, 300).astype(np.uint8), part, part[20:], np.full(150, 97, np.uint8), part[:60]])
    for at in (np.arange(len(data)), np.flatnonzero(rng.random(len(data)) < 0.5)):
        rank, _ = suffix.prefix_ranks(data, depth, at)
        keys = [bytes(data[k : k + depth]) for k in at]
        assert (np.argsort(rank, kind="stable") == sorted(range(len(keys)), key=lambda k: keys[k])).all()
        shared = lambda x, y: next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        want = [max((shared(keys[j], keys[k]) for j in range(k)), default=0) for k in range(len(keys))]
        assert suffix.previous_factors(data, depth, at).tolist() == want


def test_long_texts_in_pieces(spark, docs, monkeypatch):
    """A text of 50 MB, and all texts in pieces of a few units."""
    before = [sorted(map(repr, f(docs).collect())) for f in (substring.remove_repeats, suffix.remove_later_copies)]
    monkeypatch.setattr(passages, "BLOCK_BYTES", 400)
    monkeypatch.setattr(passages, "PIECE_BYTES", 70)
    monkeypatch.setattr(passages, "PIECE_WORDS", 9)
    assert [sorted(map(repr, f(docs).collect())) for f in (substring.remove_repeats, suffix.remove_later_copies)] == before
    monkeypatch.undo()
    rng = np.random.default_rng(12)
    long = " ".join(map(str, rng.integers(0, 10**9, 5_000_000)))
    assert len(long) > 48_000_000
    passage = " ".join(long.split(" ", 70)[:70])
    df = spark.createDataFrame([(1, long), (2, f"own {passage} words"), (3, long[-400:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()}
    assert got[1] == (5_000_000, 0) and got[2] == (72, 70)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.remove_later_copies(df).collect()}
    assert got[1] == (len(long), 0) and got[2][1] == len(passage) + 1 and got[3] == (400, 400)


def test_words_with_equal_polynomials_are_different(spark):
    """Two words of two letters in a clever order, which a polynomial hash modulo a power of two takes for one."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    others = [f"w{k}" for k in range(49)]
    df = spark.createDataFrame([(1, " ".join([a, *others])), (2, " ".join([b, *others])), (3, " ".join([a, *others]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 50}


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs).collect()))
    by = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(words(r.text)) and r.taken <= 2 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


@pytest.mark.parametrize("weight", [0.1, None])
def test_bins_of_the_mix_are_small_at_any_weight(spark, weight):
    n = 20_000
    w = F.greatest(F.coalesce(F.lit(weight).cast("double"), F.lit(mixing.LEAST_WEIGHT)), F.lit(mixing.LEAST_WEIGHT))
    bins = spark.range(n).groupBy(mixing.bin_of(-F.log(mixing.draw(F.col("id"))) / w).alias("b")).count()
    assert bins.agg(F.max("count")).first()[0] < 2 * (n * 0.37 * math.log(2) / mixing.BINS + 4 * math.sqrt(n * 0.37 * math.log(2) / mixing.BINS))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(df, weight=F.lit(weight).cast("double"), share=0.5).collect()
    assert abs(sum(r.taken for r in rows) - 3000) <= 3


def test_a_hub_in_salts(spark, monkeypatch):
    monkeypatch.setattr("tarnweave.llm.components.HUB", 7)
    edges = [(100 + k, 3) for k in range(60)] + [(500, 100), (500, 501), (2, 150), (900, 901)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 2 for k in [3, *range(100, 160), 500, 501]} | {901: 900}


def test_lm_scores(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(20, 60)))) for k in range(300)] + [(300, None), (301, ""), (None, "abc Abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    column = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    tokens = {i: [*words((t or "").lower()), None] for i, t in rows}
    counts = collections.Counter(x for i, _ in rows if not held(i) for x in tokens[i])
    n, v = sum(counts.values()), len(counts)
    bits = size = 0.0
    for r in lmscore.score(df, column).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(counts[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own))
        if r.held_out:
            bits, size = bits - r.score / math.log10(2), size + sum(len(x or "") + 1 for x in own)
    assert bits / size < 2.2  # letters alone take 3 bits, words 6 bits for about five bytes


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<article><p>a<b>b</b>c&nbsp;d &lt;x&gt; &#8217;</p><form>Mail</form><ul><li>one<li>two</ul></article>", "abc d <x> ’ one two"),
    ("<nav><a href=x>home</a></nav><article><h1>T</h1><p>x <script>if (a</p>b) {}</script>y<br>z</article><footer>foot</footer>", "T x y z"),
    ("<article><p>good</p><div class='ad'>buy</div><aside>more</aside></article><div id=comments><article><p>nice</p></article></div>", "good"),
    ("<article><p>cut &am", "cut &am"), ("<article>a<!-- no --><style>p{}</style></article>", "a"),
])
def test_pages(page, text):
    assert webpage.main_text(page) == text


def test_tree_learns_its_table():
    assert all(webpage.keeps(webpage.tree(), r[:-1]) == bool(r[-1]) for r in webpage.LABELLED)


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(100 + k, (3 * base[k // 3] + 0.4 * rng.standard_normal(16)).tolist()) for k in range(60)]
    rows += [(200, base[0].tolist()), (201, [0.0] * 16), (202, None), (203, [float("nan")] * 16), (204, [1.0, None] * 8), (205, []), (206, base[0][:8].tolist())]
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a in range(len(good)) for b in range(a) if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.9]
    label, n = reach(len(good), links), collections.Counter(x for link in links for x in link)
    want = {i: (0, i, True) for i, _ in rows} | {i: (n[k], good[label[k]][0], label[k] == k) for k, (i, _) in enumerate(good)}
    for most in (buckets.MOST, 3):
        out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-4, most=most)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()} == want


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == before.columns
    out = corpus_pipeline.tokens(spark, docs, sf_dir).collect()
    assert len(out) == docs.count() and all(r.exact and r.n_tokens == len(r.ids) for r in out)
    assert hashlib.sha256(str(sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect())).encode()).hexdigest() == hashlib.sha256(str(sorted((r.doc_id, r.n_tokens) for r in out)).encode()).hexdigest()
