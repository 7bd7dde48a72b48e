"""The data behind the reference's detail screens, one dataset each.

The cuts, defaults and remaining counts of a screen are columns, so a caller
only has to draw.  Lists are bounded per row: first insights and messages are
taken with a rank limit (planned as a partial limit per task) before they are
gathered, and totals are partial aggregates, so a conversation with any number
of messages is one bounded row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators import browse, summaries as summ

# Fixed values of the screens: cuts, defaults and marks.
DETAILS, FIRST_INSIGHTS, FIRST_MESSAGES = 5, 10, 6
TOPIC_WIDTH, SUMMARY_TOPIC_WIDTH, SOURCE_WIDTH, PREVIEW_WIDTH = 35, 30, 1500, 200
UNKNOWN, UNTITLED, UNRATED = "Unknown", "Untitled", "unknown"
CUT_MARK = "\n... [truncated]"


def _or(col: str, default: str) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit(default)).alias(col)


def percent(col: str = "confidence") -> Column:
    """Whole percent, halves to even."""
    return F.bround(F.col(col) * 100, 0).cast("int")


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """Rows of a bounded list with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("int"))


def insight_list(insights: DataFrame, category: str | None = None, tag: str | None = None, limit: int = 20,
                 ascending: bool = False, details: int = DETAILS) -> DataFrame:
    """Rank, id, category, title, percent of the listed insights; summary and tags of the first ``details``."""
    rows = browse.insights_filtered(insights, category=category, tag=tag, ascending=ascending, limit=limit)
    conf = F.col("confidence")
    rows = _ranked(rows, [conf.asc_nulls_first() if ascending else conf.desc_nulls_last(), F.asc("id")])
    shown = F.col("rank") <= details
    return rows.select("rank", "id", "category", "title", percent().alias("percent"),
                       F.when(shown, F.col("summary")).alias("summary"), F.when(shown, F.col("tags")).alias("tags"))


def insight_detail(insights: DataFrame, messages: DataFrame | None, conversations: DataFrame, insight_id=None,
                   width: int = SOURCE_WIDTH) -> DataFrame:
    """An insight (or all) with its context, defaults for what is unknown, and the source message cut."""
    rows = browse.insight_context(insights, messages, conversations, insight_id)
    text = F.col("message_content")
    source = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(CUT_MARK))).otherwise(text)
    return rows.select("id", "title", "category", percent().alias("percent"), "summary", "tags", "conversation_id",
                       *[_or(f"conversation_{c}", UNKNOWN) for c in ("topic", "date", "model", "file")],
                       "message_role", source.alias("message_content"))


def deep_list(conversations: DataFrame, messages: DataFrame | None, limit: int = 20) -> DataFrame:
    """The deepest conversations with cut topics."""
    rows = browse.deep_conversations(conversations, messages, limit)
    return rows.select("id", F.substring(_or("topic", UNKNOWN), 1, TOPIC_WIDTH).alias("topic"), _or("date", ""),
                       "message_count", "user_messages", "assistant_messages", "total_tokens")


def summary_list(summaries: DataFrame | None, conversations: DataFrame, messages: DataFrame | None,
                 sentiment: str | None = None, outcome: str | None = None, limit: int = 20,
                 details: int = DETAILS) -> DataFrame:
    """Listed summaries with defaults and cut topics; whole topic, summary and key topics of the first ``details``."""
    rows = summ.summaries_filtered(summaries, conversations, messages, sentiment=sentiment, outcome=outcome, limit=limit)
    rows = _ranked(rows, [F.desc_nulls_last("date"), F.asc("id")])
    shown = F.col("rank") <= details
    return rows.select(
        "rank", "conversation_id", _or("date", ""), F.substring(_or("topic", UNTITLED), 1, SUMMARY_TOPIC_WIDTH).alias("topic"),
        _or("sentiment", UNRATED), _or("outcome", UNRATED), F.nullif("message_count", F.lit(0)).alias("message_count"),
        F.when(shown, _or("topic", UNTITLED)).alias("whole_topic"), F.when(shown, F.col("summary")).alias("summary"),
        F.when(shown, F.col("key_topics")).alias("key_topics"))


def _listed(rows: DataFrame, order: str, name: str, fields: list) -> DataFrame:
    """(conversation_id, name): the rows of each conversation as an array in order (bounded by the caller)."""
    x = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__no"), F.struct(*fields).alias("x"))))
    return rows.groupBy("conversation_id").agg(F.transform(x, lambda s: s["x"]).alias(name))


def conversation_screen(conversations: DataFrame, messages: DataFrame | None, summaries: DataFrame | None,
                        insights: DataFrame, conversation_id=None) -> DataFrame:
    """One row per conversation (or the one asked for) with everything its screen shows.

    Head, measures, summary with key topics; ``insights`` (the first ten, best
    first) of ``insight_count``; ``preview`` (the first six messages, cut) and
    ``more_messages``, how many follow.  Archives without texts have no preview.
    """
    head = browse.conversation_detail(conversations, messages, conversation_id).select(
        F.col("id").alias("conversation_id"), _or("topic", UNTITLED), _or("date", UNKNOWN), _or("model", UNKNOWN),
        _or("file_path", UNKNOWN), "message_count", "user_messages", "assistant_messages", "total_tokens")
    s = summ.latest_summary(summaries)
    if conversation_id is not None:
        s = s.where(F.col("conversation_id") == conversation_id)
    out = head.join(s.select("conversation_id", "summary", "key_topics", "sentiment", "outcome"), "conversation_id", "left")
    owned = browse.owned_insights(insights, messages, conversation_id)
    first = browse.top_conversation_insights(owned, FIRST_INSIGHTS)
    out = out.join(_listed(first, "rank", "insights", ["id", "category", "title", percent().alias("percent")]),
                   "conversation_id", "left")
    out = out.join(owned.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("insight_count")), "conversation_id", "left")
    out = out.withColumn("insight_count", F.coalesce("insight_count", F.lit(0)))
    if messages is None:
        return out.withColumns({"preview": F.lit(None).cast("array<struct<label:string,text:string>>"),
                                "more_messages": F.lit(None).cast("long")})
    mine = messages if conversation_id is None else messages.where(F.col("conversation_id") == conversation_id)
    label = F.when(F.col("role") == "user", F.lit("YOU")).otherwise(F.lit("AI")).alias("label")
    preview = browse.conversation_preview(mine, FIRST_MESSAGES, PREVIEW_WIDTH)
    out = out.join(_listed(preview, "position", "preview", [label, F.col("preview").alias("text")]), "conversation_id", "left")
    return out.withColumn("more_messages", F.greatest(F.col("message_count") - FIRST_MESSAGES, F.lit(0)))
