"""Usage statistics: daily figures and what is derived from them.

Scale notes.  Messages are first reduced to one row per conversation
(hash aggregate with map-side partial aggregation, so a conversation that
holds a third of all messages costs one partial row per task, not a hot
reducer).  Only that per-conversation table is joined to conversations,
and the distinct-conversation count falls out as a plain row count, so no
``countDistinct`` expansion is needed.  Everything downstream of
``daily_stats`` works on one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import token_estimate

DAILY_COLS = ["date", "total_messages", "user_messages", "assistant_messages",
              "user_tokens", "assistant_tokens", "conversation_count"]


def per_conversation_measures(messages: DataFrame, recompute_tokens: bool = True) -> DataFrame:
    """Per conversation: message counts and tokens by role.

    ``recompute_tokens`` applies ``token_count or estimate(content)`` (the
    daily figures do this); depth rankings use the stored counts as is.
    Any role other than ``user`` counts as assistant for the daily
    figures, exactly as the reference's loop does.
    """
    is_user = F.col("role") == "user"
    tok = F.col("token_count")
    if recompute_tokens:
        # Text is read only for rows without a count; the filter is pushed to
        # the scan, so the text of all others stays on disk.
        missing = tok.isNull() | (tok == 0)
        counted = messages.where(~missing).select("conversation_id", "role", "token_count")
        messages = counted.unionByName(messages.where(missing).select(
            "conversation_id", "role", token_estimate(F.col("content")).alias("token_count")))
    return messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_user).alias("n_user"),
        F.sum(F.when(is_user, tok).otherwise(F.lit(0))).alias("t_user"),
        F.sum(F.when(is_user, F.lit(0)).otherwise(tok)).alias("t_other"))


def daily_stats(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """A1: per date, message and token totals by role and active conversations.

    Undated conversations are left out (the reference's readers drop them).
    """
    per_conv = per_conversation_measures(messages)
    dated = conversations.where(F.col("date").isNotNull()).select(
        F.col("id").alias("conversation_id"), "date")
    return (per_conv.join(dated, "conversation_id")
            .groupBy("date").agg(
                F.sum("n").alias("total_messages"),
                F.sum("n_user").alias("user_messages"),
                F.sum(F.col("n") - F.col("n_user")).alias("assistant_messages"),
                F.sum("t_user").alias("user_tokens"),
                F.sum("t_other").alias("assistant_tokens"),
                F.count(F.lit(1)).alias("conversation_count")))


def read_daily_stats(daily: DataFrame) -> DataFrame:
    """Stored daily rows with a date, in date order."""
    return daily.where(F.col("date").isNotNull()).orderBy("date")


def usage_summary(daily: DataFrame) -> DataFrame:
    """A3 (+R1): one row of totals over the daily table.

    Busiest day = most messages, earliest date on ties (the reference's
    ``max`` over date-ordered rows keeps the first).  Empty input gives
    zeros and NULL dates/averages.
    """
    busiest = F.max(F.struct(F.col("total_messages"), F.negative(F.unix_date("date")).alias("k"),
                             F.col("date").alias("d")))
    agg = daily.where(F.col("date").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_days"),
        F.coalesce(F.sum("total_messages"), F.lit(0)).cast("long").alias("total_messages"),
        F.coalesce(F.sum("user_tokens"), F.lit(0)).cast("long").alias("total_user_tokens"),
        F.coalesce(F.sum("assistant_tokens"), F.lit(0)).cast("long").alias("total_assistant_tokens"),
        F.coalesce(F.sum("conversation_count"), F.lit(0)).cast("long").alias("total_conversations"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg("total_messages").alias("avg_messages_per_day"),
        busiest.alias("b"))
    return agg.select(
        "total_days", "total_messages", "total_user_tokens", "total_assistant_tokens",
        (F.col("total_user_tokens") + F.col("total_assistant_tokens")).alias("total_tokens"),
        "total_conversations", "first_date", "last_date",
        F.round("avg_messages_per_day", 6).alias("avg_messages_per_day"),
        F.col("b.d").alias("most_active_day"),
        F.col("b.total_messages").alias("most_active_day_messages"))


def top_days(daily: DataFrame, limit: int = 10) -> DataFrame:
    """Busiest days, ties by earlier date."""
    return (daily.where(F.col("date").isNotNull())
            .orderBy(F.desc("total_messages"), F.asc("date")).limit(limit))


def model_distribution(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """A4: messages per model (conversations without a model left out)."""
    per_conv = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    models = conversations.where(F.col("model").isNotNull()).select(
        F.col("id").alias("conversation_id"), "model")
    return (per_conv.join(models, "conversation_id").groupBy("model")
            .agg(F.sum("n").alias("count")).orderBy(F.desc("count"), F.asc("model")))


def topic_distribution(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """A5: conversations per topic, most frequent first (reports show 20)."""
    out = (conversations.where(F.col("topic").isNotNull()).groupBy("topic")
           .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("topic")))
    return out.limit(limit) if limit else out


def period_label(period: str) -> F.Column:
    if period == "week":
        # ISO year and week, e.g. 2024-W01 (Python's isocalendar()).
        return F.format_string("%d-W%02d", F.expr("extract(YEAROFWEEK FROM date)"),
                               F.weekofyear("date"))
    if period == "month":
        return F.date_format("date", "yyyy-MM")
    raise ValueError(f"period must be month or week, not {period!r}")


def histogram(daily: DataFrame, period: str = "month", metric: str = "messages") -> DataFrame:
    """Daily rows re-aggregated by month or ISO week, in label order."""
    value = {
        "messages": F.col("total_messages"),
        "conversations": F.col("conversation_count"),
        "tokens": F.col("user_tokens") + F.col("assistant_tokens"),
    }.get(metric)
    if value is None:
        raise ValueError(f"metric must be messages, conversations or tokens, not {metric!r}")
    return (daily.where(F.col("date").isNotNull())
            .groupBy(period_label(period).alias("label"))
            .agg(F.sum(value).alias("value")).orderBy("label"))


def histogram_scaled(hist: DataFrame, width: int = 40) -> DataFrame:
    """Bar length per label = value / max value * width.

    The window has no partition key on purpose: its input is one row per
    month or week, a few hundred rows at most, so one task is right.
    """
    w = Window.partitionBy()
    share = F.try_divide(F.col("value").cast("double"), F.max("value").over(w))
    return hist.select("label", "value", F.round(share, 6).alias("share"),
                       F.coalesce(F.floor(share * width), F.lit(0)).cast("long").alias("bar"))


def table_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversation and message totals, one row per table."""
    c = conversations.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("conversations").alias("table_name"), "count")
    m = messages.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("messages").alias("table_name"), "count")
    return c.unionByName(m)
