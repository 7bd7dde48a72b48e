"""Fixture views over the supplied test tables (FIXTURES.md section 2).

Each view is a pure DataFrame derivation of ``conversations``,
``documents`` and ``embeddings``; the DuckDB oracles build the same views
with the same formulas.  Nothing here is sampled or capped: every view
grows with its source table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.dataset import ChatData
from chatlake.functions.text import topic_from_text

BASE_DATE = "2024-01-01"
CREATED_AT = "2024-03-01 00:00:00"
EXTRACTED_AT = "2024-02-01 00:00:00"

# Fixed values of the fixture rules.
MODELS = [None, "model-a", "model-b", "model-c"]
CATEGORIES = ["wisdom", "product_idea", "programming_tip", "question"]
SENTIMENTS = ["technical", "exploratory", "debugging", "learning", "planning", "creative",
              "frustrated", "collaborative", None]
OUTCOMES = ["resolved", "ongoing", "abandoned", "learning", "decision_made", "idea_generated"]
REPLY_CATEGORIES = ["wisdom", "product_idea", "programming_tip", "question", "trivia"]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: F.Column, values: list) -> F.Column:
    """values[index] as a CASE expression (NULL entries allowed)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def _stored_tokens(id_col: F.Column, text: F.Column) -> F.Column:
    """Stored counts: none for every 11th message, zero for every 13th."""
    return (F.when(id_col % 11 == 0, F.lit(None).cast("long")).when(id_col % 13 == 0, F.lit(0).cast("long"))
            .otherwise(F.floor(F.length(text) / 4).cast("long")))


def conversation_of(documents: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """Documents with ``conv``, the conversation each belongs to.

    Documents go round all conversations of the table, so the number of keys
    grows with it; every tenth document belongs to conversation 1, a hot key.
    """
    n = conv_raw.agg(F.coalesce(F.max("conv_id"), F.lit(0)) + 1).first()[0]
    return documents.withColumn("conv", F.when(F.col("doc_id") % 10 == 7, F.lit(1).cast("long"))
                                .otherwise(F.col("doc_id") % F.lit(n)))


def messages(conv_raw: DataFrame) -> DataFrame:
    """V1: user/assistant turns as messages, ids in conversation order."""
    return (conv_raw.where(F.col("role").isin("user", "assistant"))
            .select((F.col("conv_id") * 100 + F.col("turn") + 1).alias("id"),
                    F.col("conv_id").alias("conversation_id"),
                    F.col("role"),
                    F.col("text").alias("content"),
                    F.lit(None).cast("int").alias("char_start"),
                    F.lit(None).cast("int").alias("char_end"),
                    _stored_tokens(F.col("conv_id") * 100 + F.col("turn") + 1, F.col("text"))
                    .alias("token_count")))


def conversations(conv_raw: DataFrame) -> DataFrame:
    """V2: one row per conversation with date, model, system prompt, topic."""
    per = conv_raw.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("fu"),
        F.min(F.when(F.col("role") == "system", F.struct("turn", "text"))).alias("sys"))
    cid = F.col("conv_id")
    date = F.when(cid % 17 == 0, F.lit(None).cast("date")).otherwise(
        F.date_add(F.lit(BASE_DATE).cast("date"), (cid % 60).cast("int")))
    return (per.select(
        cid.alias("id"),
        date.alias("date"),
        topic_from_text(F.col("fu.text")).alias("topic"),
        _pick(cid % 4, MODELS).alias("model"),
        F.col("sys.text").alias("system_prompt"))
        .select("id",
                F.concat(F.lit("notes/"), F.coalesce(F.col("date").cast("string"), F.lit("undated")),
                         F.lit(".org")).alias("file_path"),
                "date", "topic", "model", "system_prompt",
                F.lit(CREATED_AT).cast("timestamp").alias("created_at")))


def _tags(doc_id: F.Column) -> F.Column:
    return (F.when(doc_id % 13 == 0, F.lit(None).cast("array<string>"))
            .when(doc_id % 10 == 0, F.array().cast("array<string>"))
            .otherwise(F.array(F.col("lang"), F.col("source"))))


def insights(documents: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """V3: one insight per document, linked to turn 1 of its conversation.

    The title is the text's whole first line, the summary the whole text.
    """
    d = F.col("doc_id")
    m = F.col("conv")
    return conversation_of(documents, conv_raw).select(
        d.alias("id"),
        F.when(m % 5 == 0, F.lit(None).cast("long")).otherwise(m * 100 + 2).alias("message_id"),
        _pick(d % 4, CATEGORIES).alias("category"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        _tags(d).alias("tags"),
        ((F.col("n_chars") % 101).cast("double") / 100.0).alias("confidence"),
        F.lit(EXTRACTED_AT).cast("timestamp").alias("extracted_at"))


def summary_versions(documents: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """A summary of its conversation for every document with doc_id % 3 <> 0, a minute apart.

    Conversations have many versions each, those with conversation % 7 = 2 none.
    """
    d = F.col("doc_id")
    return (conversation_of(documents, conv_raw).where((d % 3 != 0) & (F.col("conv") % 7 != 2)).select(
        d.alias("id"),
        F.col("conv").alias("conversation_id"),
        F.col("text").alias("summary"),
        _tags(d).alias("key_topics"),
        _pick(F.floor(d / 2) % 9, SENTIMENTS).alias("sentiment"),
        _pick(F.floor(d / 3) % 6, OUTCOMES).alias("outcome"),
        (F.lit(EXTRACTED_AT).cast("timestamp") + F.make_interval(mins=d.cast("int")))
        .alias("summarized_at")))


def summaries(documents: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """V4: the latest version of every conversation's summary."""
    versions = summary_versions(documents, conv_raw)
    last = versions.groupBy("conversation_id").agg(F.max("id").alias("id"))
    return versions.join(last, ["conversation_id", "id"], "left_semi").select(*versions.columns)


def embeddings(emb_raw: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """V5: the last of each conversation's vectors, for six of seven conversations, and some of unknown ids.

    Vectors go round the conversations of the table; every fiftieth belongs to
    an id without a conversation.  Conversation 0's vector is the query.
    """
    n = conv_raw.agg(F.coalesce(F.max("conv_id"), F.lit(0)) + 1).first()[0]
    v = F.col("vec_id")
    conv = F.when(v % 50 == 49, v + 1_000_000).otherwise(v % n).alias("conversation_id")
    return (emb_raw.select("vec_id", "embedding", conv).where(F.col("conversation_id") % 7 != 3)
            .groupBy("conversation_id").agg(F.max_by("embedding", "vec_id").alias("embedding"))
            .select("conversation_id", "embedding", F.lit("fixture").alias("model"),
                    F.lit(CREATED_AT).cast("timestamp").alias("created_at")))


def marked(conv_raw: DataFrame) -> DataFrame:
    """V6: message text wrapped in org markup, for the clean-up functions."""
    t = F.col("turn").cast("string")
    text = F.concat(
        F.lit("* Head "), t, F.lit("\n:PROPERTIES:\n:GPTEL_TOPIC: t"), t, F.lit("\n:END:\n"),
        F.col("text"),
        F.lit("\n#+begin_src python\nprint(1)\n#+END_SRC\nsee [[http://x][label]] and [[http://y]]"
              "\n\n\n\n#+TITLE: t\n#+RESULTS: r\n@user hi\n** sub\n* star line\n"))
    return (conv_raw.where(F.col("role").isin("user", "assistant"))
            .select((F.col("conv_id") * 100 + F.col("turn") + 1).alias("id"), text.alias("text")))


def replies(documents: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """V7: one model reply per document, as a bulk-result line.

    The reply is prose plus a fenced JSON array.  Its insight has the whole
    first line as title and the whole text as summary; ``confidence`` is
    present only when doc_id % 3 = 0; a fifth of the replies name a category
    outside the allowed four.  By doc_id % 23 some replies are faulty:
    1 empty content, 2 errored, 3 text after the array, 4 single quotes,
    5 a number beside the insight, 6 no JSON, 7 truncated JSON, 8 one object,
    9 no content at all, 10 expired.
    """
    d = F.col("doc_id")
    kind = d % 23
    base = [_pick(d % 5, REPLY_CATEGORIES).alias("category"),
            F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"),
            F.array(F.col("lang"), F.col("source")).alias("tags")]
    with_conf = F.to_json(F.struct(
        *base, ((F.col("n_chars") % 101).cast("double") / 100.0).alias("confidence")))
    item = F.when(d % 3 == 0, with_conf).otherwise(F.to_json(F.struct(*base)))
    array = F.concat(F.lit("["), item, F.lit("]"))
    body = (F.when(kind == 3, F.concat(array, F.lit(" and see [1]")))
            .when(kind == 4, F.lit("[{'category': 'wisdom', 'title': 't', 'summary': 's'}]"))
            .when(kind == 5, F.concat(F.lit("["), item, F.lit(", 5]")))
            .when(kind == 6, F.lit("nope"))
            .when(kind == 7, F.concat(F.lit("["), item))
            .when(kind == 8, F.lit('{"category": "wisdom", "title": "t", "summary": "s"}')).otherwise(array))
    text = F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))
    return _result_lines(conversation_of(documents, conv_raw), "conv_", kind, text)


def _result_lines(docs: DataFrame, prefix: str, kind: F.Column, text: F.Column) -> DataFrame:
    block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    content = F.when(kind == 1, F.slice(block, 1, 0)).when(kind == 9, F.lit(None)).otherwise(block)
    rtype = F.when(kind == 2, "errored").when(kind == 10, "expired").otherwise("succeeded")
    return docs.select(
        F.col("doc_id").alias("line_no"), F.concat(F.lit(prefix), F.col("conv").cast("string")).alias("custom_id"),
        F.struct(rtype.alias("type"), F.struct(content.alias("content")).alias("message")).alias("result"))


def summary_replies(documents: DataFrame, conv_raw: DataFrame) -> DataFrame:
    """One summary reply per document to its conversation, as a result line; later lines replace earlier ones.

    The object carries the whole text; keys are left out by doc_id (%4 sentiment,
    %5 outcome, %6 topics).  By doc_id % 23: 1, 2, 9, 10 as in V7; 3 text with
    another object after it, 4 single quotes, 6 no JSON, 7 truncated JSON,
    8 an array instead of an object.
    """
    d = F.col("doc_id")
    kind = d % 23
    obj = F.to_json(F.struct(
        F.col("text").alias("summary"),
        F.when(d % 6 != 0, F.array("lang", "source")).alias("key_topics"),
        F.when(d % 4 != 0, F.lit("learning")).alias("sentiment"),
        F.when(d % 5 != 0, F.lit("resolved")).alias("outcome")))
    body = (F.when(kind == 3, F.concat(obj, F.lit(" or {}")))
            .when(kind == 4, F.lit("{'summary': 's'}"))
            .when(kind == 6, F.lit("nope"))
            .when(kind == 7, F.lit('{"summary": "s"'))
            .when(kind == 8, F.lit("[1, 2]")).otherwise(obj))
    return _result_lines(conversation_of(documents, conv_raw), "summary_", kind, F.concat(F.lit("```json\n"), body, F.lit("\n```")))


_STORED: dict = {}


def fixture_data(spark: SparkSession, sf_dir: str, stored: bool = True) -> ChatData:
    """The archive tables of one test-data folder.

    ``stored=True`` (default): the views are written once per Spark
    application as Parquet tables under the shared ``spark.checkpoint.dir``
    and read back, as an archive is ingested once and queried many times.
    ``stored=False``: the lazy view plans over the raw tables.
    """
    if not stored:
        return derived_data(spark, sf_dir)
    from chatlake.session import checkpoint_dir
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = f"{checkpoint_dir(spark).rstrip('/')}/chatlake-tables/{key[0]}-{uuid.uuid4().hex}"
        derived_data(spark, sf_dir).write(root)
        _STORED[key] = ChatData.read(spark, root)
    return _STORED[key]


def derived_data(spark: SparkSession, sf_dir: str) -> ChatData:
    conv_raw = raw(spark, sf_dir, "conversations")
    docs = raw(spark, sf_dir, "documents")
    return ChatData(spark=spark,
                    conversations=conversations(conv_raw),
                    messages=messages(conv_raw),
                    insights=insights(docs, conv_raw),
                    summaries=summaries(docs, conv_raw),
                    embeddings=embeddings(raw(spark, sf_dir, "embeddings"), conv_raw))


# -- ingest fixtures (V8, V9): text in the two input formats, derived from the table --

def _history_fields(conv_id: F.Column, turn: F.Column) -> dict:
    """Integer parts of the export date of a turn pair (rule shared with the oracle)."""
    return {
        "month": conv_id % 12 + 1,
        "day": conv_id % 28 + 1,
        "yy": (conv_id * 7 + turn) % 100,
        "hour12": (conv_id + turn) % 12 + 1,
        "minute": (turn * 7) % 60,
        "pm": (conv_id + turn) % 2 == 1,
    }


def history_export(conv_raw: DataFrame) -> DataFrame:
    """V8: one chat-history export row per pair of adjacent turns.

    ``Date`` as ``M/D/YY, h:mm AM`` (U+202F before AM/PM when turn % 3 = 0,
    an unparseable text when (conv_id + turn) % 11 = 0); ``Conversation`` as
    ``Question:`` / ``AI Response:`` marker lines, the marker chosen by role.
    """
    a = conv_raw.select("conv_id", "turn", F.col("role").alias("r1"), F.col("text").alias("t1"))
    b = conv_raw.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r2"),
                        F.col("text").alias("t2"))
    p = a.join(b, ["conv_id", "turn"])
    f = _history_fields(F.col("conv_id"), F.col("turn"))
    sep = F.when(F.col("turn") % 3 == 0, F.lit("\u202f")).otherwise(F.lit(" "))
    date = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.lit("not a date")).otherwise(
        F.concat(F.format_string("%d/%d/%02d, %d:%02d", f["month"], f["day"], f["yy"],
                                 f["hour12"], f["minute"]),
                 sep, F.when(f["pm"], F.lit("PM")).otherwise(F.lit("AM"))))

    def marker(r):
        return F.when(F.col(r) == "user", F.lit("Question:")).otherwise(F.lit("AI Response:"))
    conv = F.concat(marker("r1"), F.lit("\n"), F.col("t1"), F.lit("\n"),
                    marker("r2"), F.lit("\n"), F.col("t2"), F.lit("\n"))
    return p.select("conv_id", "turn", date.alias("Date"), conv.alias("Conversation"))


def note_messages(data: ChatData) -> DataFrame:
    """V9: every message as a line of its conversation's own note file.

    File ``notes/<conversation_id>/<date>.org`` (``undated.org`` without a
    date); user text is escaped as the export converter escapes it.
    """
    from chatlake.functions.text import escape_org_headlines
    conv = data.conversations.select(
        F.col("id").alias("conversation_id"), "topic",
        F.concat(F.lit("notes/"), F.col("id").cast("string"), F.lit("/"),
                 F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("undated")),
                 F.lit(".org")).alias("file"))
    return data.messages.join(conv, "conversation_id").select(
        "file", "conversation_id", "id", "role",
        escape_org_headlines(F.col("content")).alias("content"), "topic")


# -- note files and export files as they lie in a folder (V10 to V12) ---------------------

NOTE_HEAD = {False: ":PROPERTIES:\n:GPTEL_BOUNDS: ((response", True: ":PROPERTIES:\n:GPTEL_BOUNDS: ("}
NOTE_CLOSE = {False: "))\n:GPTEL_MODEL: m-1\n:END:\n", True: ")\n:GPTEL_SYSTEM: be brief\n:END:\n"}
NOTE_ENTRY = {False: 22, True: 24}
MARKUP = "\nsee [[http://x][label]] now\n#+begin_src a\nx\n#+END_SRC\n\n\n\nend"


def note_files(conv_raw: DataFrame) -> DataFrame:
    """(file_path, content) of one note file per day, a section per conversation.

    The file of conversations without a date has no headlines; the last day's
    file has a date that doesn't exist.  The drawer's numbers have nine digits,
    so its length follows from their count; files of odd days have the old form.
    A third of the sections have a topic of their own, user texts of every fifth
    conversation carry markup, and in every fourth the last response ends on the
    next headline.
    """
    c = F.col("conversation_id")
    msgs = messages(conv_raw)
    last = F.max("id").over(Window.partitionBy("conversation_id"))
    date = F.date_add(F.lit(BASE_DATE).cast("date"), (c % 60).cast("int")).cast("string")
    undated, old = c % 17 == 0, (c % 17 != 0) & (c % 2 == 1)
    path = F.concat(F.lit("notes/"), F.when(undated, "undated").when(c % 60 == 59, "2024-02-30").otherwise(date),
                    F.lit(".org"))
    ai = F.col("role") == "assistant"
    piece = F.when(ai, F.concat("content", F.lit("\n"))).otherwise(
        F.concat(F.lit("** ask\n"), "content", F.when(c % 5 == 0, MARKUP).otherwise(""), F.lit("\n")))
    flush = (ai & (c % 4 == 1) & (F.col("id") == last)).cast("long")
    text = c.cast("string")
    head = F.when(undated, F.lit("")).otherwise(F.concat(
        F.lit("* Conv "), text, F.lit("\n"),
        F.when(c % 3 == 0, F.concat(F.lit(":PROPERTIES:\n:GPTEL_TOPIC: t"), text, F.lit("\n:END:\n"))).otherwise("")))
    own = msgs.select(path.alias("file_path"), old.alias("old"), c, "id", ai.alias("ai"),
                      (F.length("content") + flush).alias("n"), piece.alias("piece"))
    heads = own.select("file_path", "old", c).distinct().select(
        "file_path", "old", c, F.lit(-1).cast("long").alias("id"), F.lit(False).alias("ai"),
        F.lit(0).cast("long").alias("n"), head.alias("piece"))
    rows = own.unionByName(heads)
    at = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("file_path").orderBy("conversation_id", "id")
                                                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawer = F.when(F.col("old"), F.lit(len(NOTE_HEAD[True] + NOTE_CLOSE[True]))).otherwise(
        F.lit(len(NOTE_HEAD[False] + NOTE_CLOSE[False])))
    width = F.when(F.col("old"), F.lit(NOTE_ENTRY[True])).otherwise(F.lit(NOTE_ENTRY[False]))
    count = F.count_if("ai").over(Window.partitionBy("file_path"))
    rows = rows.withColumn("start", drawer + width * count + at + 1)
    shown = F.when(F.col("old"), F.format_string("(%09d . %09d) ", F.col("start"), F.col("start") + F.col("n"))).otherwise(
        F.format_string(" (%09d %09d)", F.col("start"), F.col("start") + F.col("n")))

    def joined(col):
        order = F.array_sort(F.collect_list(F.struct("conversation_id", "id", F.col(col).alias("t"))))
        return F.array_join(F.transform(order, lambda x: x["t"]), "")

    done = rows.withColumn("bound", F.when(F.col("ai"), shown).otherwise(F.lit(""))).groupBy("file_path", "old").agg(
        joined("bound").alias("bounds"), joined("piece").alias("body"))
    return done.select("file_path", F.concat(
        F.when(F.col("old"), NOTE_HEAD[True]).otherwise(NOTE_HEAD[False]), "bounds",
        F.when(F.col("old"), NOTE_CLOSE[True]).otherwise(NOTE_CLOSE[False]), "body").alias("content"))


def markdown(conv_raw: DataFrame) -> DataFrame:
    """Message text among headings, fences and inline marks, some of them inside code."""
    t = F.col("turn")
    text = F.concat(
        F.repeat(F.lit("#"), (t % 7).cast("int")), F.lit(" Head **b** `c`\n"), F.col("text"), F.lit("\n```py\n# x `y` **z**\n"),
        F.when(t % 2 == 0, F.lit("```\n")).otherwise(F.lit("")), F.lit("`c` **d** ![p](u) [l](v) **e\n"),
        F.when(t % 3 == 0, F.lit("  ``` \n")).otherwise(F.lit("")), F.lit("### T\n`open **f** g"))
    return (conv_raw.where(F.col("role").isin("user", "assistant"))
            .select((F.col("conv_id") * 100 + t + 1).alias("id"), text.alias("text")))


def history_files(conv_raw: DataFrame) -> str:
    """The rows of V8 as CSV files with a header, quoted fields and a ``Row`` key; returns their folder."""
    from chatlake.plans.staging import staging_root
    spark = conv_raw.sparkSession
    path = f"{staging_root(spark)}/history-{uuid.uuid4().hex}"
    rows = history_export(conv_raw).select("Date", "Conversation", F.concat_ws(":", "conv_id", "turn").alias("Row"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return path
