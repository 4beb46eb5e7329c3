"""Decontamination against a search for every window in every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import automaton, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "What is the capital of the small island that lies north of Öland, and who rules it?"
ITEMS = [
    (1, ITEM), (2, "one two three"), (3, None), (4, ""), (5, "?!"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"), (7, "solo"),
    (8, " ".join(f"w{k}" for k in range(40))), (None, "a nameless item"), (9, ITEM), (1, ITEM), (10, "two three"), (11, "x x x x x x x x x x x x x"), (12, "w3 w4 w5 w6"),
]
TEXTS = [
    (0, f"Before. {ITEM} After."), (1, None), (2, ""), (3, ITEM.upper()), (4, "one, two\nthree four"), (5, "one two four three"), (6, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (7, "beta gamma delta epsilon zeta eta theta iota kappa"), (8, "a Solo, here"), (9, "w" + " w".join(map(str, range(5, 30)))), (10, "this is a nameless item"), (11, "x " * 30 + "y " + "x " * 9),
    (12, ITEM.replace(" ", "-") + " w3 w4 w5 w6 w7"), (0, f"Before. {ITEM} After."), (None, "two three"), (13, "nothing at all"), (14, "one two" + "\x00" + "three"), (15, "é" + "漢字 solo🙂 solo"),
]


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(text, items, width):
    w, hit, named = words(text), set(), set()
    for key, item in items:
        own = words(item)
        k = min(width, len(own))
        for j in range(len(own) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == own[j : j + k]:
                    hit.update(range(i, i + k))
                    named |= {str(key)} - {"None"}
    spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
    return len(w), len(hit), sorted(named), spans


def rows(out, key="doc_id"):
    return sorted(((r[key], r.n_words, r.n_hit, list(r["items"]), [(s.first, s.last) for s in r.spans]) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("width", "most"), [(10, 1 << 18), (10, 20), (3, 40), (1, 1 << 18), (13, 64)])
def test_against_brute_force(spark, width, most):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(decontaminate.find(docs, items, width=width, most_words=most))
    assert got == sorted(((k, *brute(t, ITEMS, width)) for k, t in TEXTS), key=repr)


@pytest.mark.parametrize("least", [2, 5])
def test_random_texts_of_few_words(spark, least):
    """Few different words, so that stretches overlap, repeat and nest in all ways."""
    rng = random.Random(least)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, some(rng.randint(least, 14))) for k in range(12)]
    texts = [(k, some(rng.randint(0, 60))) for k in range(60)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 18, 30):
        got = rows(decontaminate.find(docs, bench, width=7, most_words=most))
        assert got == sorted(((k, *brute(t, items, 7)) for k, t in texts), key=repr)


def test_longest_matches():
    items = [words("a b c d e"), words("c d f"), words("b c d f g h")]
    own = automaton.build(["1", "2", "3"], [[w.encode() for w in x] for x in items], 3)
    place = {bytes(own.word_bytes[own.word_at[k] : own.word_at[k + 1]]).decode(): k for k in range(len(own.hashes))}
    text = words("z a b c d f g a b c d e e c d f x")
    import numpy as np

    ids = np.array([place.get(w, -1) for w in text])
    at, _, match = automaton.walk(own, ids, np.array([0]), np.array([len(ids)]))
    inside = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    want = [max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in inside), default=0) for i in range(len(text))]
    assert [m for _, m in sorted(zip(at.tolist(), match.tolist(), strict=True))] == want


def test_spans_go_and_texts_that_are_mostly_hit(spark):
    texts = [(0, f"Keep this, {' '.join(f'own{k}' for k in range(80))}. {ITEM} And the rest!"), (1, ITEM), (2, None), (3, "clean")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.clean(decontaminate.find(docs, items)).collect()}
    assert out == {0: texts[0][1].replace(ITEM[:-1], ""), 2: None, 3: "clean"}


def test_cases(spark):
    items = spark.createDataFrame([("i", ITEM), ("j", None)], "item_id string, text string")
    long = "word " * 2_000_000 + ITEM + " word" * 2_000_000
    docs = spark.createDataFrame([("a", ITEM), (None, "x"), ("b", long)], "doc_id string, text string")
    odd = docs.select("*", *[F.lit("clash").alias(c) for c in ("_whole", "N_words", "spans", "Items", "id", "shard")])
    out = decontaminate.find(odd, items)
    assert out.filter("_whole = 'clash' AND id = 'clash' AND shard = 'clash'").count() == 3
    assert rows(out) == [("a", 17, 17, ["i"], [(0, 17)]), ("b", 4_000_017, 17, ["i"], [(2_000_000, 2_000_017)]), (None, 1, 0, [], [])]
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.find(docs.filter("doc_id = 'a'"), none)) == [("a", 17, 0, [], [])]
    assert decontaminate.find(docs.limit(0), items).count() == 0
