"""Conversations as ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chat_role

STOPPED = "[stopped]"


def joined_in_order(text: Column, order: Column, separator: str = "") -> Column:
    """Aggregate of texts joined in the order of ``order``. A group is one conversation or stream."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda s: s["t"]), separator)


def transcripts(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation its messages as 'role: text' lines, in turn order, and their number."""
    line = F.concat(chat_role(F.col(role)), F.lit(": "), F.coalesce(text, F.lit("")))
    return messages.groupBy(key).agg(joined_in_order(line, F.col(turn), "\n").alias("transcript"), F.count(F.lit(1)).alias("messages"))


def mark_stopped(messages: DataFrame, key: str, turn: str, text: str, stopped: str, role: str | None = None) -> DataFrame:
    """Conversations that were stopped (``stopped`` true on any row), as they are kept.

    With ``role``: a last answer with text is marked; an empty last answer is rolled back with the question before it, and so is a last question that
    has no answer. Without it, the last message, whosever it is, is marked, or dropped if it is empty.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(turn).desc()))
    whole = Window.partitionBy(key)
    rows = messages.withColumn("_back", back).withColumn("_stopped", F.coalesce(F.max(stopped).over(whole), F.lit(False)))
    empty = F.coalesce(text, F.lit("")) == ""
    last = F.col("_stopped") & (F.col("_back") == 1)
    if role is None:
        gone, marked = last & empty, last
    else:
        answer, question = F.col(role).isin("model", "assistant"), F.coalesce(F.col(role) == "user", F.lit(False))
        unanswered = F.max((F.col("_back") == 1) & answer & empty).over(whole)
        gone = (last & (question | (answer & empty))) | (F.col("_stopped") & (F.col("_back") == 2) & question & unanswered)
        marked = last & answer
    rows = rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn(text, F.when(marked, F.concat(text, F.lit("\n\n" + STOPPED))).otherwise(F.col(text)))
    return rows.where(~F.col("_gone")).drop("_back", "_stopped", "_gone")
