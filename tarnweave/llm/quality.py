"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base features are counted in each row, without a shuffle. A few rules then compare a feature with a cutoff of the
document's stratum. Cutoffs are chosen on labelled holdouts: for each stratum and rule, the cutoffs of a fixed list
are tested from the loosest to the strictest. A cutoff passes if an exact binomial test rejects "it drops more than
`risk / rules` of the good documents"; the first that fails ends the sequence, so a sequence needs no correction
within it, and the level is divided by the number of rules and strata. With probability `1 - level` no stratum then
loses more than `risk` of its good documents by these rules. Among the cutoffs that passed, the one that drops the
most bad documents holds (a good one lost counts as ten). Where too few labels are there to pass any, the rule is off: with
four strata a rule needs 197 good labels in one, of which it drops none.

Cases: a null text has no words and fails the base rules; a null stratum is a stratum of its own; null labels and
labels of unknown documents count for nothing; repeated rows are judged each, repeated labels count each; a document
without labels in its stratum gets the base rules only; an empty table gives an empty one; output columns replace
input ones of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm.common import stash, words

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated.
WINDOW = 5
RISK, LEVEL = 0.15, 0.05
#: A good document lost weighs as many bad ones caught.
LOSS = 10
#: Cutoffs of each rule: a document with a greater value is dropped.
RULES = {
    "symbols": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "marks": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0),
    "lines": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2),
    "length": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base features and n_marks and n_lines. Narrow."""
    new = (*BASE, "n_marks", "n_lines")
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in new])
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    without = lambda chars: F.length(whole) - F.length(F.translate(whole, chars, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    get = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    # a window is repeated if its neighbour in the order of hashes has the same words
    alike = lambda k: "x.h = _sorted[%s].h AND %s" % (k, " AND ".join(f"_w[x.i + {j}] = _w[_sorted[{k}].i + {j}]" for j in range(WINDOW)))
    df = df.withColumns({"_w": words(F.col(f"`{text}`")), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": (F.length(whole) - without(WHITE)).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_marks": without("!").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = df.withColumn("_hashes", F.expr(f"""
        CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({get}))
        ELSE cast(array() as array<bigint>) END"""))
    # most texts have no window twice, and need no sorting
    df = df.withColumn("_sorted", F.expr("""
        CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN sort_array(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))
        ELSE cast(array() as array<struct<h:bigint,i:int>>) END"""))
    df = df.withColumn("_starts", F.expr(f"""
        sort_array(transform(filter(_sorted, (x, k) -> CASE WHEN k > 0 AND {alike("k - 1")} THEN true
        WHEN k + 1 < size(_sorted) THEN {alike("k + 1")} ELSE false END), x -> cast(x.i as bigint)))"""))
    repeated = F.expr(f"""
        aggregate(_starts, named_struct('total', 0L, 'last', -{WINDOW}L),
        (a, s) -> named_struct('total', a.total + least({WINDOW}L, s - a.last), 'last', s), a -> a.total)""")
    return df.withColumn("n_repeat_words", repeated).drop("_w", "_lines", "_hashes", "_sorted", "_starts")


def values() -> dict[str, Column]:
    """The value that each rule compares."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "length": share("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series at x + 8."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - F.log(x + float(k))
    return series


def at_most(k: str, n: str, p: float) -> Column:
    """The probability of at most k of n at rate p, for k below the mean; 1 otherwise. The sum runs down from k, where
    terms only shrink, and leaves out what is under 1e-15 of it."""
    a, b = F.col(k).cast("double"), F.col(n).cast("double")
    top = log_gamma(b + 1) - log_gamma(a + 1) - log_gamma(b - a + 1) + a * math.log(p) + (b - a) * math.log1p(-p)
    ratio = f"({k} - i) * {1 - p!r}D / (({n} - {k} + 1 + i) * {p!r}D)"
    steps = f"least({k}, cast(60 + 12 * sqrt({n} * {p!r}D) as bigint))"
    total = F.expr(f"""
        CASE WHEN {k} = 0 THEN 1D ELSE aggregate(sequence(0L, {steps} - 1L), named_struct('term', 1D, 'total', 1D),
        (s, i) -> named_struct('term', s.term * {ratio}, 'total', s.total + s.term * {ratio}), s -> s.total) END""")
    return F.when(a < b * p, F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cutoffs: map of rule to cutoff) from rows with stratum, good (boolean) and the base features."""
    got = values()
    counts = [F.sum(F.col("good").cast("long")).alias("n_good")]
    for rule, cuts in RULES.items():
        for j, cut in enumerate(cuts):
            over = got[rule] > cut
            counts += [F.sum((over & F.col("good")).cast("long")).alias(f"good_{rule}_{j}"), F.sum((over & ~F.col("good")).cast("long")).alias(f"bad_{rule}_{j}")]
    table = stash(labelled.filter("good is not null").groupBy("stratum").agg(*counts), "curves")
    level /= len(RULES) * max(1, table.count())
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cutoff"), F.col(f"good_{rule}_{j}").alias("lost"), F.col(f"bad_{rule}_{j}").alias("caught"))
        for rule, cuts in RULES.items()
        for j, cut in enumerate(cuts)
    ])
    tried = table.select("stratum", "n_good", F.explode(tests).alias("t")).select("stratum", "n_good", "t.*")
    tried = tried.withColumn("passes", at_most("lost", "n_good", risk / len(RULES)) <= level)
    looser = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    safe = tried.withColumn("passes", F.min("passes").over(looser)).filter("passes")
    gain = F.struct(F.col("caught") - LOSS * F.col("lost"), F.col("cutoff"))
    best = safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", gain).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def _chosen(made: DataFrame, labels: DataFrame, key: str, stratum: str, label: str, risk: float, level: float) -> DataFrame:
    known = labels.select(F.col(key).alias("_key"), (F.col(label) == 1).alias("good"))
    labelled = made.join(known, made[key] == known["_key"]).withColumn("stratum", F.col(stratum))
    return stash(cutoffs(labelled, risk, level).withColumnsRenamed({"stratum": "_stratum", "cutoffs": "_cutoffs"}), "cutoffs")


def _judged(made: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    over = F.lit(False)
    for rule, value in values().items():
        over = over | F.coalesce(value > F.col("_cutoffs")[rule], F.lit(False))
    judged = made.join(chosen, made[stratum].eqNullSafe(chosen["_stratum"]), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_cutoffs")


def judge(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    risk: float = RISK,
    level: float = LEVEL,
) -> DataFrame:
    """df's columns but the text, with the base features, base_failed and kept. Labels: key and label (1: good)."""
    made = features(df, text).drop(text)
    made = made.select(*[f"`{c}`" for c in made.columns if c.lower() not in ("base_failed", "kept")])
    made = stash(made.withColumn("base_failed", base_failed()), "features")
    return _judged(made, _chosen(made, labels, key, stratum, label, risk, level), stratum)


def keep(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    risk: float = RISK,
    level: float = LEVEL,
) -> DataFrame:
    """df's rows that are kept, with their columns. Rows find their verdict by a hash of id, text and stratum."""
    mark = F.xxhash64(key, text, stratum)
    made = features(df.select(key, text, stratum, mark.alias("_mark")), text).drop(text)
    made = stash(made.withColumn("base_failed", base_failed()), "features")
    judged = _judged(made, _chosen(made, labels, key, stratum, label, risk, level), stratum)
    stay = judged.filter("kept").select(F.col("_mark").alias("_stays"), F.col(key).alias("_stays_id")).distinct()
    rows = df.withColumn("_mark", mark)
    return rows.join(stay, (rows["_mark"] == stay["_stays"]) & rows[key].eqNullSafe(stay["_stays_id"]), "left_semi").select(*df.columns)
