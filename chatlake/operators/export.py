"""Privacy export -- aggregates and insights without any message text.

Four tables: conversations with their measures, daily_stats, insights
re-keyed to conversation, tag counts.  Messages and system prompts are not
written.  Each table is written once with ``mode("overwrite")``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.dataset import ChatData
from chatlake.operators import browse, stats


def export_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every conversation with counts; no messages gives 0, 0, 0 and NULL tokens."""
    per = browse.conversation_measures(messages).select(
        F.col("conversation_id").alias("id"), "message_count", "user_messages",
        "assistant_messages", "total_tokens")
    return (conversations.select("id", "file_path", "date", "topic", "model")
            .join(per, "id", "left")
            .select("id", "file_path", "date", "topic", "model",
                    F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"),
                    F.coalesce("user_messages", F.lit(0)).cast("long").alias("user_messages"),
                    F.coalesce("assistant_messages", F.lit(0)).cast("long")
                    .alias("assistant_messages"),
                    "total_tokens"))


def export_tables(data: ChatData) -> ChatData:
    """The export dataset as lazy frames (no text columns anywhere)."""
    daily = data.daily_stats if data.daily_stats is not None else stats.daily_stats(
        data.messages, data.conversations)
    insights = data.table("insights")
    return ChatData(
        spark=data.spark,
        conversations=export_conversations(data.conversations, data.messages),
        messages=None,
        insights=browse.insights_to_conversation(insights, data.messages),
        daily_stats=daily.where(F.col("date").isNotNull()),
        tags=browse.tag_counts(insights))


def export_to_path(data: ChatData, root: str) -> dict:
    """Write the export under ``root`` (replacing it); returns row counts."""
    out = export_tables(data)
    counts = {}
    for name in ("conversations", "daily_stats", "insights", "tags"):
        path = os.path.join(root, name)
        getattr(out, name).write.mode("overwrite").parquet(path)
        counts[name] = data.spark.read.parquet(path).count()
    return counts
