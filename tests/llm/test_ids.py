"""Operators on ids that are text, with clashing names: the same results as on whole numbers in the same order."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import substring, suffix

PASSAGE = " ".join(f"p{i}" for i in range(70))
#: In the order of their ids, whatever type those have.
TEXTS = [f"a {PASSAGE} b", f"c {PASSAGE}", None, "", f"{PASSAGE} tail", "short", "short", f"x {PASSAGE[:150]} y"]
IDS = {
    "long": list(range(len(TEXTS))),
    "string": ["", "10", "2", "B", "a", "b", "é", "漢"],
    "date": [datetime.date(2000, 1, 1 + k) for k in range(len(TEXTS))],
}


@pytest.mark.parametrize("kind", ["string", "date"])
@pytest.mark.parametrize(("operator", "what"), [(substring.remove_repeats, ("n_words", "n_removed", "kept_text")), (suffix.remove_later_copies, ("n_bytes", "n_removed", "spans", "kept_bytes"))])
def test_ids_of_any_type(spark, kind, operator, what):
    def run(ids, kind):
        rows = [*zip(ids, TEXTS, strict=True), (None, f"last {PASSAGE}"), (ids[1], "again")]
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("_order", "_id", "_D")})
        out = operator(df).filter("_order = 'clash' AND _id = 'clash'").collect()
        place = {None: -1} | {x: k for k, x in enumerate(ids)}
        return sorted(((place[r.doc_id], *(r[c] for c in what)) for r in out), key=repr)

    want = run(IDS["long"], "long")
    assert len(want) == len(TEXTS) + 2 and sum(r[what.index("n_removed") + 1] > 0 for r in want) >= 3
    assert run(IDS[kind], kind) == want
    none = spark.createDataFrame([], f"doc_id {kind}, text string")
    assert operator(none).count() == 0
