"""Joins whose keys may be hubs: rows of one key are dealt to several tasks on one side, and the rows they meet go to each.

Cases: null keys meet nothing; repeated rows are pairs each; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.sources.shared import stash

#: Rows of a key that one salt takes.
ROWS = 1024


def meet(left: DataFrame, right: DataFrame, near: str, key: str, row: str, condition: Column | None = None, rows: int = ROWS) -> DataFrame:
    """left joined with right where its column `near` is right's `key`, and the condition holds. Right's rows of a key that has more
    than `rows` are dealt to salts by their column `row`; those of left go along with each salt."""
    met = F.col(near) == F.col(key)
    met = met & condition if condition is not None else met
    salts = F.ceil(F.count("*") / rows).cast("int")
    hubs = stash(right.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hub")).agg(salts.alias("_salts")).filter("_salts > 1"), "hubs")
    if hubs.isEmpty():
        return left.join(right, met)
    many = F.coalesce("_salts", F.lit(1))
    each = left.join(hubs, F.col(near) == F.col("_hub"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
    dealt = right.join(hubs, F.col(key) == F.col("_hub"), "left").withColumn("_to", F.pmod(F.xxhash64(row), many).cast("int"))
    # by a number, as adaptive execution would bring small tables to one task, whatever comes out of their join
    dealt = dealt.repartition(int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key), F.col("_to"))
    return each.drop("_hub", "_salts").join(dealt.drop("_hub", "_salts"), met & (F.col("_salt") == F.col("_to"))).drop("_salt", "_to")
