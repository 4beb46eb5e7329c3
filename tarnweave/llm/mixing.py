"""Mixing sources to target weights.

Each source gets a target of words. It gives complete epochs of all its documents first; what is left comes from an
Efraimidis-Spirakis sample: a document's key is exponential with its quality weight as rate, -ln(u) / weight, with u
from a hash of its id, and documents are taken in the order of their keys until the prefix sum of their sizes meets
what is left. The one at the border is taken where that comes nearer.

No task sorts a whole source: keys fall into bins of one ratio, `BINS` for each factor of two; a sum for each bin tells
what lies before it, and only the documents of one bin are ordered together. Keys of one weight w are exponential, and at
most 0.37 * ln(2) / BINS of them, 0.025 %, share a bin, whatever w is; of mixed weights even fewer do. What is ordered in
one task is the list of sources, a row each: hosts as sources make some hundred MB of it, documents as sources would not do.

Cases: a null text has size 0; a null source is a source of its own, last; documents of size 0 are taken 0 words; a
null or non-positive weight counts as the least weight; null ids share one draw and are told apart by size; ties and
repeated rows are ordered by key, id and size; an empty table gives an empty one; output columns replace input ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm.common import spare, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 1024
LEAST_WEIGHT = 0.01


def quality_weight(text: Column) -> Column:
    """From 1 for plain prose down to 0.1: falls with the share of symbols among the characters."""
    chars = F.length(text)
    symbols = chars - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    return F.when(chars > 0, 1 - 0.9 * F.least(F.lit(1.0), 10 * symbols / chars)).otherwise(F.lit(1.0))


def draw(key: Column) -> Column:
    """Uniform over (0, 1) by the key's MD5, of which 13 hexadecimal digits are exact in a double."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def bin_of(key: Column) -> Column:
    """The number of a key's bin, which grows with the key."""
    return F.floor(BINS * F.log2(key)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with its target: sources in code-point order, null last, weigh `weights` in turn and share
    `share` of all sizes; a target stops at `most` times its source, and the excess is shared by weight again until
    none is above. The level of that sharing follows from the sources ordered by size over weight: the first k are
    full, and the others get `level` times their weight, k being the least number for which no other is above."""
    every = Window.partitionBy()
    rank = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * float(most)
    ordered = every.orderBy(full / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_fits", F.when(full / F.col("_w") >= F.col("_level"), F.col("_level")))
        .withColumn("_level", F.first("_fits", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(full, F.coalesce(F.col("_level") * F.col("_w"), full))))
        .select("source", "source_size", "target")
    )


def mix(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
) -> DataFrame:
    """df with size, source_size, target, epochs (whole times that every document of the source is taken), picked
    (taken once more) and taken (words, repeats counted)."""
    made = ("size", "source_size", "target", "epochs", "picked", "taken")
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in made])
    w = F.greatest(F.coalesce(quality_weight(F.col(text)) if weight is None else weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    # helpers under names that the input doesn't have
    key, own_bin, in_bin, of, bin_, before = spare(df, "_key", "_own_bin", "_in_bin", "_source", "_bin", "_bin_before")
    docs = df.withColumns({"size": F.size(words(F.col(text))).cast("long"), key: -F.log(draw(F.col(doc_id))) / w})
    docs = docs.withColumn(own_bin, bin_of(F.col(key)))
    sums = docs.groupBy(F.col(source).alias("source"), F.col(own_bin).alias("bin")).agg(F.sum("size").alias("bin_size"))
    plan = targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bin_before", F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0)))
    same = lambda a, b: a.eqNullSafe(b)
    bins = sums.alias("s").join(plan.alias("p"), same(F.col("s.source"), F.col("p.source")))
    bins = bins.select(F.col("s.source").alias(of), F.col("s.bin").alias(bin_), F.col("s.bin_before").alias(before), "p.source_size", "p.target")
    by_key = Window.partitionBy(F.col(source), own_bin).orderBy(key, doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn(in_bin, F.coalesce(F.sum("size").over(by_key), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        docs.join(bins, same(F.col(source), F.col(of)) & (F.col(own_bin) == F.col(bin_)))
        .withColumn("epochs", epochs)
        .withColumn("picked", (F.col(before) + F.col(in_bin) + F.col("size") / 2 <= left) & (F.col("epochs") < most))
        .withColumn("taken", (F.col("size") * (F.col("epochs") + F.col("picked").cast("int"))).cast("long"))
        .drop(key, own_bin, in_bin, of, bin_, before)
    )
