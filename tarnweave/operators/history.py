"""Conversation history: pairs of a user's turn and the answer, the last few of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions.text import blank, is_error

LAST = 6


def pairs(turns: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(by, turn, user, assistant): each user turn with the next turn, where that is the assistant's."""
    w = Window.partitionBy(by).orderBy(turn)
    spoken = turns.filter(F.col(role).isin("user", "assistant"))
    spoken = spoken.withColumns({"_role": F.lead(role).over(w), "_text": F.lead(text).over(w)})
    return spoken.filter((F.col(role) == "user") & (F.col("_role") == "assistant")).select(by, turn, F.col(text).alias("user"), F.col("_text").alias("assistant"))


def admitted(found: DataFrame) -> DataFrame:
    """Pairs with two texts and no error for an answer."""
    return found.filter(~blank(F.col("user")) & ~blank(F.col("assistant")) & ~is_error(F.col("assistant")))


def last(found: DataFrame, n: int = LAST, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n pairs of each conversation, with seq from 1, the oldest first. A window with a limit on its rank keeps n
    rows of each group before it shuffles."""
    newest = Window.partitionBy(by).orderBy(F.desc(turn))
    kept = found.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(turn))).drop("_back")


def messages(kept: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, seq, role, content): two messages for each pair."""
    both = F.array(
        F.struct((2 * F.col("seq") - 1).alias("seq"), F.lit("user").alias("role"), F.col("user").alias("content")),
        F.struct((2 * F.col("seq")).alias("seq"), F.lit("assistant").alias("role"), F.col("assistant").alias("content")),
    )
    return kept.select(by, F.inline(both))


def prompt(kept: DataFrame, header: str, by: str = "conv_id") -> DataFrame:
    """(by, prompt): the pairs under a header, one line each for question and answer."""
    lines = F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("Question: "), "user", F.lit("\nAnswer: "), "assistant").alias("l"))))
    return kept.groupBy(by).agg(F.concat_ws("\n", F.lit(header), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")).alias("prompt"))
