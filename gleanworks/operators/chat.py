"""Logs of conversations as Markdown, in rows that a writer puts one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chat_log(messages: DataFrame, about: DataFrame, part: str = "chat") -> DataFrame:
    """``part, at, seq, block``: the front matter of each conversation, then one block per message, to be written in order of at and seq.

    ``messages``: part, ``seq``, ``role`` (``user`` or another), ``ts``, ``text``; ``about``: part, ``started``, ``engine``,
    ``model``, ``quality``, ``folder``, one row per conversation. A conversation is never one value, however long it is.
    Null texts are empty.
    """
    day = F.date_format("started", "yyyy-MM-dd")
    head = F.concat(
        F.lit("---\ndate:    "), F.date_format("started", "yyyy-MM-dd HH:mm:ss"), *[x for name in ("engine", "model", "quality", "folder") for x in (F.rpad(F.lit(f"\n{name}:"), 10, " "), F.col(name))],
        F.lit("\n---\n\n# Chat — "), day, F.lit("\n\n"),
    )
    who = F.when(F.col("role") == "user", "You").otherwise("Assistant")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    block = F.concat(F.lit("---\n\n**"), who, F.lit("** · *"), F.date_format("ts", "HH:mm:ss"), F.lit("*\n\n"), said, F.lit("\n\n"))
    opened = about.select(part, F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("seq"), head.alias("block"))
    return opened.unionByName(messages.select(part, F.lit(1).alias("at"), F.col("seq").cast("bigint").alias("seq"), block.alias("block")))
