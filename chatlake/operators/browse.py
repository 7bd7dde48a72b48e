"""Browse operators: filters, lookups, joins, rankings and work queues.

Every function returns a lazy DataFrame.  Point lookups take an optional
key: ``None`` runs the same plan over the whole table (one set-based join
instead of the reference's lookup per row).

Scale notes.  Joins whose one side is keyed by a unique id (messages.id,
conversations.id) are equi-joins that Spark plans as sort-merge joins or,
after AQE has measured a filtered side, as broadcast joins; AQE's skew
handling splits a hot key on the many side.  Work queues are anti-joins
against de-duplicated key sets, so a key repeated a billion times costs
one partial-aggregate row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.plans.numbering import with_row_index

from chatlake.functions.text import ascii_lower

MESSAGE_COLS = ["id", "conversation_id", "role", "content", "char_start", "char_end", "token_count"]
INSIGHT_COLS = ["id", "message_id", "category", "title", "summary", "tags", "confidence",
                "extracted_at"]


def _limit(df: DataFrame, limit: int | None) -> DataFrame:
    """Python-side ``rows[:limit] if limit else rows``: 0 and None mean all."""
    return df.limit(limit) if limit else df


def messages_with_conversation(messages: DataFrame, conversations: DataFrame,
                               date=None) -> DataFrame:
    """Messages with their conversation's date, topic and model.

    With ``date`` only that day's conversations are joined; the date filter
    is applied to the conversation scan before the join.
    """
    conv = conversations.select(F.col("id").alias("conversation_id"), "date", "topic", "model")
    if date is not None:
        conv = conv.where(F.col("date") == F.lit(date).cast("date"))
    out = messages.select(*MESSAGE_COLS).join(conv, "conversation_id")
    out = out.select(*MESSAGE_COLS, "date", "topic", "model")
    return out.orderBy("id") if date is not None else out.orderBy("date", "id")


def insights_filtered(insights: DataFrame, tag: str | None = None, category: str | None = None,
                      ascending: bool = False, limit: int | None = None, wildcards: bool = False) -> DataFrame:
    """Insights by optional tag and category, ordered by confidence.

    A tag matches an element of ``tags`` with ASCII-only case folding, as
    SQLite's LIKE folds case; with ``wildcards`` the user's ``%`` and ``_`` are
    LIKE's, within one tag.  Ties in confidence are broken by id.
    """
    out = insights
    if tag:
        needle = ascii_lower(F.lit(tag))
        out = out.where(F.exists("tags", lambda t: F.like(ascii_lower(t), needle) if wildcards
                                 else ascii_lower(t) == needle))
    if category:
        out = out.where(F.col("category") == category)
    conf = F.asc("confidence") if ascending else F.desc("confidence")
    return _limit(out.orderBy(conf, F.asc("id")), limit)


def random_insight(insights: DataFrame, category: str | None = None, seed: int = 0) -> DataFrame:
    """One insight in random order (optionally of one category).

    The order is by a hash of seed and id, so a seed always gives the same row.
    """
    out = insights.where(F.col("category") == category) if category else insights
    return out.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id").limit(1)


def conversation_messages(messages: DataFrame | None, conversation_id=None) -> DataFrame | None:
    """messages of one (or every) conversation in order; None for export data."""
    if messages is None:
        return None
    out = messages if conversation_id is None else messages.where(
        F.col("conversation_id") == conversation_id)
    return out.orderBy("conversation_id", "id")


def conversation_measures(messages: DataFrame) -> DataFrame:
    """Per conversation: message counts and stored tokens by role."""
    user = F.col("role") == "user"
    asst = F.col("role") == "assistant"
    tok = F.col("token_count")
    return messages.groupBy("conversation_id").agg(
        F.count("id").alias("message_count"),
        F.count_if(user).cast("long").alias("user_messages"),
        F.count_if(asst).cast("long").alias("assistant_messages"),
        F.sum(F.when(user, tok).otherwise(0)).alias("user_tokens"),
        F.sum(F.when(asst, tok).otherwise(0)).alias("assistant_tokens"),
        F.sum(tok).alias("total_tokens"))


def deep_conversations(conversations: DataFrame, messages: DataFrame | None,
                       limit: int | None = 20) -> DataFrame:
    """Conversations ranked by message count.

    Full data: messages are aggregated per conversation first, then joined
    (a conversation without messages drops out, as in the reference's inner
    join).  Export data: the stored measures are read.
    """
    base = ["id", "topic", "date", "model", "file_path"]
    if messages is None:
        out = conversations.select(*base, "message_count", "user_messages",
                                   "assistant_messages", "total_tokens")
    else:
        per = conversation_measures(messages).withColumnRenamed("conversation_id", "id")
        out = conversations.select(*base).join(per, "id")
    out = out.orderBy(F.desc("message_count"), F.asc("id"))
    return out.limit(limit) if limit else out


def conversation_detail(conversations: DataFrame, messages: DataFrame | None,
                        conversation_id=None) -> DataFrame:
    """A conversation (or all) with message count, role counts, tokens."""
    conv = conversations
    if conversation_id is not None:
        conv = conv.where(F.col("id") == conversation_id)
    if messages is None:
        return conv
    msgs = messages if conversation_id is None else messages.where(
        F.col("conversation_id") == conversation_id)
    per = (conversation_measures(msgs)
           .select(F.col("conversation_id").alias("id"), "message_count", "user_messages",
                   "assistant_messages", "total_tokens"))
    return conv.join(per, "id")


def insight_context(insights: DataFrame, messages: DataFrame | None, conversations: DataFrame,
                    insight_id=None) -> DataFrame:
    """Insight with its message and conversation (left joins).

    Export data has no messages: the insight's own conversation_id is used
    and message columns are NULL.
    """
    ins = insights if insight_id is None else insights.where(F.col("id") == insight_id)
    conv = conversations.select(
        F.col("id").alias("_cid"), F.col("topic").alias("conversation_topic"),
        F.col("date").alias("conversation_date"), F.col("model").alias("conversation_model"),
        F.col("file_path").alias("conversation_file"))
    if messages is None:
        out = (ins.join(conv, ins["conversation_id"] == conv["_cid"], "left")
               .withColumn("message_role", F.lit(None).cast("string"))
               .withColumn("message_content", F.lit(None).cast("string")))
        cols = [c for c in ins.columns]
    else:
        msg = messages.select(F.col("id").alias("_mid"), F.col("role").alias("message_role"),
                              F.col("content").alias("message_content"),
                              F.col("conversation_id").alias("_mcid"))
        # Insights without a message go past the join: they would meet on one key.
        linked = (ins.where("message_id is not null").join(msg, ins["message_id"] == msg["_mid"], "left")
                  .join(conv, F.col("_mcid") == F.col("_cid"), "left")
                  .withColumn("conversation_id", F.col("_cid")))
        loose = ins.where("message_id is null")
        out = linked.unionByName(loose, allowMissingColumns=True)
        cols = INSIGHT_COLS
    return out.select(*cols, "message_role", "message_content", "conversation_id",
                      "conversation_topic", "conversation_date", "conversation_model",
                      "conversation_file")


def insights_to_conversation(insights: DataFrame, messages: DataFrame) -> DataFrame:
    """Insights re-keyed from message to conversation (export shape)."""
    msg = messages.select(F.col("id").alias("_mid"), "conversation_id")
    cols = ["id", "conversation_id", "category", "title", "summary", "tags", "confidence", "extracted_at"]
    # Insights without a message go past the join: they would meet on one key.
    linked = (insights.where("message_id is not null")
              .join(msg, insights["message_id"] == msg["_mid"], "left").select(*cols))
    loose = insights.where("message_id is null").withColumn("conversation_id", F.lit(None).cast("long")).select(*cols)
    return linked.unionByName(loose)


def extracted_conversation_ids(insights: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations that own at least one insight (through its message)."""
    mids = insights.where(F.col("message_id").isNotNull()).select(
        F.col("message_id").alias("id")).distinct()
    return messages.select("id", "conversation_id").join(mids, "id").select(
        F.col("conversation_id").alias("id")).distinct()


def unextracted_conversations(conversations: DataFrame, insights: DataFrame,
                              messages: DataFrame) -> DataFrame:
    """Conversations none of whose messages has an insight, oldest first."""
    done = extracted_conversation_ids(insights, messages)
    return conversations.join(done, "id", "left_anti").orderBy(F.asc_nulls_first("date"), "id")


def unsummarized_conversations(conversations: DataFrame, messages: DataFrame,
                               summaries: DataFrame | None, min_messages: int = 4) -> DataFrame:
    """Conversations without a summary having at least ``min_messages``."""
    counts = (messages.groupBy("conversation_id").agg(F.count("id").alias("message_count"))
              .where(F.col("message_count") >= min_messages)
              .withColumnRenamed("conversation_id", "id"))
    conv = conversations
    if summaries is not None:
        done = summaries.select(F.col("conversation_id").alias("id")).distinct()
        conv = conv.join(done, "id", "left_anti")
    return conv.join(counts, "id").orderBy(F.asc_nulls_first("date"), "id")


def unembedded_conversations(conversations: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """Conversation ids without a stored vector, in id order."""
    ids = conversations.select("id")
    if embeddings is not None:
        done = embeddings.select(F.col("conversation_id").alias("id")).distinct()
        ids = ids.join(done, "id", "left_anti")
    return ids.orderBy("id")


def first_message(messages: DataFrame) -> DataFrame:
    """Lowest message id per conversation."""
    return messages.groupBy("conversation_id").agg(F.min("id").alias("message_id"))


def owned_insights(insights: DataFrame, messages: DataFrame | None, conversation_id=None) -> DataFrame:
    """Insights with the conversation they belong to (through their message, or directly in an export)."""
    if messages is None:
        ins = insights.where("conversation_id is not null")
    else:
        msg = messages.select(F.col("id").alias("message_id"), "conversation_id")
        if conversation_id is not None:
            msg = msg.where(F.col("conversation_id") == conversation_id)
        ins = insights.join(msg, "message_id")
    return ins if conversation_id is None else ins.where(F.col("conversation_id") == conversation_id)


def top_conversation_insights(owned: DataFrame, n: int) -> DataFrame:
    """The best ``n`` insights of each conversation: every task passes on at most n rows a conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.col("confidence").desc_nulls_last(), F.asc("id"))
    return owned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def conversation_insights(insights: DataFrame, messages: DataFrame | None,
                          conversation_id=None) -> DataFrame:
    """Insights of a conversation (or all), best first, with their rank.

    Ranks come from a range sort of (conversation, confidence, id), in which a
    conversation with a tenth of all insights spans several partitions; texts
    are joined to their rank by id.
    """
    ins = owned_insights(insights, messages, conversation_id)
    keys = with_row_index(ins.select("conversation_id", "confidence", "id"),
                          [F.col("confidence").desc_nulls_last(), "id"], name="rank", start=1,
                          partition_by=["conversation_id"])
    ranks = keys.select("conversation_id", "id", F.col("rank").cast("int").alias("rank"))
    return ins.join(ranks, ["conversation_id", "id"]).select(*ins.columns, "rank").orderBy("conversation_id", "rank")


def tag_counts(insights: DataFrame, limit: int | None = None) -> DataFrame:
    """Occurrences per tag (not distinct insights), most used first."""
    out = (insights.where(F.col("tags").isNotNull() & (F.size("tags") > 0))
           .select(F.explode("tags").alias("tag"))
           .groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), F.asc("tag")))
    return _limit(out, limit)


def unique_tag_total(insights: DataFrame) -> DataFrame:
    """Number of distinct tags."""
    return (insights.where(F.col("tags").isNotNull())
            .select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("unique_tags")))


def conversation_preview(messages: DataFrame, first_n: int = 6, width: int = 200) -> DataFrame:
    """First ``first_n`` messages of each conversation, text cut at ``width``.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before
    the shuffle, so a huge conversation sends at most n rows per task.
    """
    w = Window.partitionBy("conversation_id").orderBy("id")
    content = F.col("content")
    preview = F.when(F.length(content) > width,
                     F.concat(F.substring(content, 1, width), F.lit("..."))).otherwise(content)
    return (messages.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= first_n)
            .select("conversation_id", "id", "position", "role", preview.alias("preview")))
