"""Conversation summaries: counts, filtered listings, keyword search, upsert.

Every function accepts ``summaries=None`` (the table is optional) and then
returns an empty result, as the reference does when the table is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.functions.text import ascii_lower, contains_folded
from chatlake.plans.publish import bucket_count, recover
from chatlake.plans.staging import staged

SUMMARY_COLS = ["id", "conversation_id", "summary", "key_topics", "sentiment", "outcome",
                "summarized_at"]


def _table(summaries: DataFrame | None) -> DataFrame:
    """The table, or an empty one where the archive has none."""
    if summaries is not None:
        return summaries
    return SparkSession.active().createDataFrame([], schemas.SUMMARIES)


def value_counts(summaries: DataFrame | None, column: str) -> DataFrame:
    """Count per value (NULL is its own group), most frequent first."""
    return (_table(summaries).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first(column)))


def sentiment_counts(summaries: DataFrame | None) -> DataFrame:
    return value_counts(summaries, "sentiment")


def outcome_counts(summaries: DataFrame | None) -> DataFrame:
    return value_counts(summaries, "outcome")


def summary_stats(summaries: DataFrame | None) -> DataFrame:
    """Total plus both distributions as one long table (kind, value, count).

    Both distributions come from one scan with grouping sets.
    """
    s, e = F.col("sentiment"), F.col("outcome")
    table = _table(summaries)
    total = table.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value"), "count")
    both = (table.select(s, e).groupingSets([[s], [e]], s, e)
            .agg(F.count(F.lit(1)).alias("count"), F.grouping("sentiment").alias("_gs")))
    kind = F.when(F.col("_gs") == 0, "sentiment").otherwise("outcome")
    return total.unionByName(both.select(kind.alias("kind"), F.coalesce(s, e).alias("value"), "count"))


def get_summary(summaries: DataFrame | None, conversation_id) -> DataFrame:
    """the summary of one conversation."""
    return _table(summaries).where(F.col("conversation_id") == conversation_id)


def summaries_filtered(summaries: DataFrame | None, conversations: DataFrame,
                       messages: DataFrame | None, sentiment: str | None = None,
                       outcome: str | None = None, limit: int | None = None) -> DataFrame:
    """Summaries with conversation info and message count, newest first.

    Message counts are aggregated per conversation before the left join, so
    the join never multiplies summary rows.
    """
    s = _table(summaries)
    if sentiment:
        s = s.where(F.col("sentiment") == sentiment)
    if outcome:
        s = s.where(F.col("outcome") == outcome)
    conv = conversations.select(F.col("id").alias("conversation_id"), "topic", "date", "model")
    out = s.select(*SUMMARY_COLS).join(conv, "conversation_id")
    if messages is not None:
        counts = messages.groupBy("conversation_id").agg(F.count("id").alias("message_count"))
        out = out.join(counts, "conversation_id", "left").withColumn(
            "message_count", F.coalesce("message_count", F.lit(0)).cast("long"))
    elif "message_count" in conversations.columns:
        out = out.join(conversations.select(F.col("id").alias("conversation_id"),
                                            "message_count"), "conversation_id", "left")
    else:
        out = out.withColumn("message_count", F.lit(0).cast("long"))
    out = out.select(*SUMMARY_COLS, "topic", "date", "model", "message_count").orderBy(
        F.desc_nulls_last("date"), F.asc("id"))
    return out.limit(limit) if limit else out


def keyword_search(summaries: DataFrame | None, conversations: DataFrame, query: str,
                   limit: int = 50, wildcards: bool = False) -> DataFrame:
    """F8: conversations whose summary or a key topic contains ``query``.

    Case folding is ASCII-only, as in SQLite's LIKE; the user's ``%``/``_``
    are literal unless ``wildcards`` is set.  Newest first; SQL's LIMIT 0
    gives no rows.
    """
    hit = contains_folded(F.col("summary"), query, wildcards) | F.coalesce(
        F.exists("key_topics", lambda t: contains_folded(t, query, wildcards)), F.lit(False))
    conv = conversations.select("id", "topic", "date", "model")
    s = _table(summaries).where(hit).select(F.col("conversation_id").alias("id"), "summary",
                                    "key_topics", "sentiment", "outcome")
    return (conv.join(s, "id")
            .select("id", "topic", "date", "model", "summary", "key_topics", "sentiment", "outcome")
            .orderBy(F.desc_nulls_last("date"), F.asc("id")).limit(limit))


# -- keyword index -----------------------------------------------------------------------

GRAM = 3
INDEX = "summary_grams"


def _grams(text: Column) -> Column:
    """All stretches of ``GRAM`` characters of a folded text, each once (in one pass over the text)."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))),
                                                 F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def keyword_index(summaries: DataFrame) -> DataFrame:
    """Postings (gram, conversation_id, and the summary's bucket column) of summaries and key topics.

    A text that contains a needle contains every gram of the needle.  Grams
    are taken in their text's row, so a text is read once and only short rows
    travel.
    """
    by = [c for c in summaries.columns if c.startswith("bucket")]
    text = F.concat(F.array("summary"), F.coalesce("key_topics", F.array().cast("array<string>")))
    grams = F.array_distinct(F.flatten(F.transform(text, _grams)))
    return summaries.select("conversation_id", *by, F.explode(grams).alias("gram")).sortWithinPartitions(*by, "gram")


def needle_grams(query: str) -> list[str]:
    """The grams of a needle, folded; none for shorter ones."""
    folded = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return sorted({folded[i:i + GRAM] for i in range(len(folded) - GRAM + 1)})


def keyword_candidates(postings: DataFrame, query: str) -> DataFrame:
    """Keys (conversation_id and bucket) of the postings that have every gram of the needle."""
    grams, keys = needle_grams(query), [c for c in postings.columns if c != "gram"]
    hits = postings.where(F.col("gram").isin(grams))
    return hits.groupBy(*keys).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).drop("n")


def keyword_search_indexed(spark: SparkSession, root: str, conversations: DataFrame, query: str,
                           limit: int = 50) -> DataFrame:
    """F8 over a stored table with an index: the rows of ``keyword_search``.

    Only the buckets of the candidates are read, and LIKE runs on them alone.
    Needles under three characters scan the table.
    """
    recover(spark, root)
    by = f"bucket{bucket_count(spark, f'{root}/summaries')}"
    table = spark.read.parquet(f"{root}/summaries")
    if needle_grams(query):
        found = staged(keyword_candidates(spark.read.parquet(f"{root}/{INDEX}"), query), "candidates")
        # Bounded by the number of buckets.
        buckets = [r[0] for r in found.select(by).distinct().collect()]
        table = table.where(F.col(by).isin(buckets)).join(found, ["conversation_id", by], "left_semi")
    return keyword_search(table.select(*SUMMARY_COLS), conversations, query, limit)


def latest_summary(summary_versions: DataFrame | None) -> DataFrame:
    """One row per conversation, the latest version (insert-or-replace).

    ``row_number() = 1`` by (summarized_at, id): Spark keeps one candidate per
    conversation and task before the shuffle (WindowGroupLimit), so a
    conversation with a huge number of versions never lands in one task, and
    whole rows are not compared.
    """
    w = Window.partitionBy("conversation_id").orderBy(F.col("summarized_at").desc_nulls_last(), F.desc("id"))
    return (_table(summary_versions).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select(*SUMMARY_COLS))
