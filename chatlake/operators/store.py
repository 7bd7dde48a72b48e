"""Writes to a stored archive (one Parquet folder per table).

* appends (conversations, messages, insights) get ids that continue the
  stored ones: ``max(id) + 1`` is one aggregated number, and new rows are
  numbered by ``plans.numbering`` (distributed, no single-task window);
* upserts (summaries and embeddings by conversation) rewrite only the key
  buckets that the new rows fall into;
* conversations are new with every append, so the daily table is the stored
  one plus the batch's own figures; no stored message is read for it;
* all changes of one call are staged and put in place together
  (``plans.publish``): after a crash either none or all of them are seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.dataset import read_table
from chatlake.operators import stats
from chatlake.operators.summaries import INDEX, SUMMARY_COLS, keyword_index
from chatlake.plans.numbering import with_row_index
from chatlake.plans.publish import Batch, Folder, bucket_count, recover
from chatlake.plans.staging import staged

SCHEMAS = {
    "conversations": schemas.CONVERSATIONS, "messages": schemas.MESSAGES,
    "insights": schemas.INSIGHTS, "summaries": schemas.SUMMARIES,
    "embeddings": schemas.EMBEDDINGS, "daily_stats": schemas.DAILY_STATS,
}


def next_id(table: DataFrame | None) -> int:
    """``max(id) + 1`` of a stored table (1 when empty or missing)."""
    if table is None:
        return 1
    return int(table.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0])


def refresh_daily_stats(spark: SparkSession, root: str) -> None:
    """Recompute the daily table from all stored conversations and messages."""
    recover(spark, root)
    conv, msgs = read_table(spark, root, "conversations"), read_table(spark, root, "messages")
    if conv is None or msgs is None:
        return
    batch = Batch(spark, root)
    batch.replace("daily_stats", stats.daily_stats(msgs, conv))
    batch.publish()


def merged_daily(stored: DataFrame | None, added: DataFrame) -> DataFrame:
    """Daily figures after conversations have been added (``added``: their own daily figures).

    A conversation has one date, so every figure of a date is a sum.
    """
    both = added if stored is None else stored.select(*added.columns).unionByName(added)
    return both.groupBy("date").agg(*[F.sum(c).alias(c) for c in added.columns if c != "date"])


def append_conversations(spark: SparkSession, root: str, conversations: DataFrame, messages: DataFrame,
                         also: dict[str, DataFrame] | None = None) -> None:
    """Append parsed conversations and messages, numbered after the stored ids.

    The inputs carry ids starting at 1 (as the ingest functions produce
    them by default); they are shifted to continue the stored sequence.  The
    daily table is brought up to date in the same batch; ``also`` names rows
    for further tables of it.
    """
    recover(spark, root)
    c0 = next_id(read_table(spark, root, "conversations")) - 1
    m0 = next_id(read_table(spark, root, "messages")) - 1
    batch = Batch(spark, root)
    convs = batch.append("conversations", conversations.withColumn("id", F.col("id") + c0)
                         .select(*schemas.CONVERSATIONS.names))
    msgs = batch.append("messages", messages.withColumn("id", F.col("id") + m0)
                        .withColumn("conversation_id", F.col("conversation_id") + c0)
                        .select(*schemas.MESSAGES.names))
    daily = read_table(spark, root, "daily_stats")
    if daily is None and m0:
        # Messages were stored without daily figures: all of them once.
        old = stats.daily_stats(read_table(spark, root, "messages"), read_table(spark, root, "conversations"))
        daily = staged(old, "daily")
    batch.replace("daily_stats", merged_daily(daily, stats.daily_stats(msgs, convs)))
    for table, rows in (also or {}).items():
        batch.append(table, rows)
    batch.publish()


def remove_conversations(spark: SparkSession, root: str, gone: DataFrame, batch: Batch | None = None) -> None:
    """Drop conversations (``conversation_id``) and all that belongs to them, daily figures included.

    A message or conversation is known by its id, so the tables are filtered by
    anti joins and replaced as a whole.
    """
    recover(spark, root)
    batch = batch or Batch(spark, root)
    gone = staged(gone.select("conversation_id").distinct(), "gone")
    msgs, convs = read_table(spark, root, "messages"), read_table(spark, root, "conversations")
    kept_c = batch.replace("conversations", convs.join(gone.withColumnRenamed("conversation_id", "id"), "id", "left_anti")
                           .select(*convs.columns))
    if msgs is not None:
        kept_m = batch.replace("messages", msgs.join(gone, "conversation_id", "left_anti").select(*msgs.columns))
        batch.replace("daily_stats", stats.daily_stats(kept_m, kept_c))
        ins = read_table(spark, root, "insights")
        if ins is not None:
            lost = msgs.join(gone, "conversation_id", "left_semi").select(F.col("id").alias("message_id"))
            batch.replace("insights", ins.join(lost, "message_id", "left_anti").select(*ins.columns))
    for name in ("summaries", INDEX, "embeddings"):
        if Folder(spark, root).exists(f"{root}/{name}"):
            rows, n = spark.read.parquet(f"{root}/{name}"), bucket_count(spark, f"{root}/{name}")
            kept = rows.join(gone, "conversation_id", "left_anti").select(*rows.columns)
            if n:
                batch.bucketed(name, kept, "replace", f"bucket{n}")
            else:
                batch.replace(name, kept)
    batch.publish()


def clear(spark: SparkSession, root: str) -> None:
    """Empty every table (summaries and embeddings too, so no orphans remain: D9)."""
    recover(spark, root)
    batch = Batch(spark, root)
    for name, schema in SCHEMAS.items():
        batch.replace(name, spark.createDataFrame([], schema))
    if Folder(spark, root).exists(f"{root}/{INDEX}"):
        batch.replace(INDEX, spark.createDataFrame([], "conversation_id long, gram string"))
    batch.publish()


def append_insights(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Append loaded insight rows with new ids (order: message, conversation, title, summary).

    A category outside the allowed four is an error, as it is at the loader.
    """
    recover(spark, root)
    rows = staged(rows, "insights")
    odd = rows.where(F.col("category").isNull() | ~F.col("category").isin(*schemas.CATEGORIES))
    found = odd.select("category").distinct().limit(5).collect()
    if found:
        raise ValueError(f"insight categories outside {schemas.CATEGORIES}: {[r[0] for r in found]}")
    start = next_id(read_table(spark, root, "insights"))
    order = [c for c in ("message_id", "conversation_id", "title", "summary") if c in rows.columns]
    batch = Batch(spark, root)
    batch.append("insights", with_row_index(rows, order, "id", start).select(*schemas.INSIGHTS.names))
    batch.publish()


def last_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of every key: a window group limit, planned with a partial limit per task."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def build_keyword_index(spark: SparkSession, root: str) -> None:
    """Write the postings of all stored summaries (``summaries.keyword_index``), one folder per bucket of theirs."""
    recover(spark, root)
    by = f"bucket{bucket_count(spark, f'{root}/summaries')}"
    batch = Batch(spark, root)
    batch.bucketed(INDEX, keyword_index(spark.read.parquet(f"{root}/summaries").repartition(by)), "replace", by)
    batch.publish()


def upsert_summaries(spark: SparkSession, root: str, rows: DataFrame, input_order: list[str] | None = None,
                     index: bool = False) -> None:
    """Insert or replace by conversation; new rows get new ids.

    A new row always replaces the stored one, whatever their times.  Of
    several new rows of one conversation the last stays: by ``input_order``
    (columns that give the order of the input, as file and line), else by time.
    Rows that are equal in all that are ordered by their content, so the result
    never depends on the order of tasks.  The keyword index, where there is one
    or ``index`` asks for it, is kept in the same batch, bucket by bucket.
    """
    recover(spark, root)
    start = next_id(read_table(spark, root, "summaries"))
    by = [F.col(c).desc_nulls_last() for c in (input_order or ["summarized_at"])]
    content = [F.col(c).desc_nulls_last() for c in SUMMARY_COLS if c not in ("id", "conversation_id")]
    best = last_per_key(rows, "conversation_id", by + content)
    new = with_row_index(best.drop("id"), ["conversation_id"], "id", start).select(*SUMMARY_COLS)
    batch = Batch(spark, root)
    there = Folder(spark, root).exists(f"{root}/{INDEX}")
    merged, action, by = batch.upsert("summaries", new, "conversation_id")
    if there or (index and action == "replace"):
        batch.bucketed(INDEX, keyword_index(merged.repartition(by)), action, by)
    batch.publish()
    if index and not there and action == "buckets":
        build_keyword_index(spark, root)


def upsert_embeddings(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Insert or replace one vector per conversation; the newer row wins."""
    recover(spark, root)
    cols = schemas.EMBEDDINGS.names
    best = last_per_key(rows, "conversation_id", [F.col("created_at").desc_nulls_last(),
                                                  F.col("embedding").desc_nulls_last(), F.col("model").desc_nulls_last()])
    batch = Batch(spark, root)
    batch.upsert("embeddings", staged(best.select(*cols), "embeddings"), "conversation_id")
    batch.publish()
