"""Chat-history CSV export -> messages, and rendering to day-note text.

The CSV has a header with ``Date`` (``1/8/25, 10:16 PM``) and
``Conversation`` (many lines, ``Question:`` / ``AI Response:`` marker
lines).  Main path: CSV rows straight to typed conversations and messages
(D21).  Second path: render each day as one note text with correct
response bounds (P11, P13) and write one text per day (S4); those texts can
be parsed back by ``org_notes.parse_files``.

Everything per CSV row (markers, topic) is array and regex functions on
that row's own cell.  Rendering works on one row per message
(``operators.render``): offsets are distributed running sums and a day's
text is written by streaming its ordered chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.operators.render import markdown_to_org, note_texts, render_chunks, write_note_files  # noqa: F401
from chatlake.plans.numbering import with_row_index
from chatlake.plans.staging import staged
from chatlake.functions.text import escape_org_headlines, strip_ws, token_estimate, topic_from_text

SPLIT_MARKER = r"(?md)^(?:Question|AI Response):[ \t]*\n"
FIND_MARKER = r"(?md)^(Question|AI Response):[ \t]*$"


#: Place of a record in its export, in order over files and lines.
ROW_NO = "row_no"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, row_no, header, record): the records of CSV files, each read by as many tasks as it has blocks.

    A line begins a record where an even number of quotes stands before it in
    its file (quotes inside quoted fields are doubled).  Lines are counted in
    their block, a table of one row per block carries parity and record number
    on from block to block, and lines are gathered under their record's number.
    Records are numbered over all files in order of their paths; ``header`` marks
    the first of each.  Line ends inside quoted fields become newlines, as in
    Python's text reading.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
        F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)).alias("odd"))
    # A block is a split of the file: bounded, read in order by one task.
    in_block = Window.partitionBy("file_path", "block").orderBy("at")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("parity", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))
    blocks = lines.groupBy("file_path", "block").agg(
        F.sum("odd").alias("odds"), F.count_if(F.col("parity") == 0).alias("even_starts"),
        F.count_if(F.col("parity") == 1).alias("odd_starts"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carry", F.pmod(F.coalesce(F.sum("odds").over(earlier), F.lit(0)), F.lit(2)))
    starts = F.when(F.col("carry") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    blocks = blocks.withColumn("records", starts)
    # One row per file: what the files before it hold.
    so_far = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file_path").agg(F.sum("records").alias("n")).select(
        "file_path", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("first"))
    blocks = blocks.select("file_path", "block", "carry", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("done"))
    blocks = blocks.join(files, "file_path").select("file_path", "block", "carry", "first",
                                                    (F.col("first") + F.col("done")).alias("done"))
    begins = (F.col("parity") == F.col("carry")).cast("long")
    numbered = lines.join(blocks, ["file_path", "block"]).withColumn(
        ROW_NO, F.col("done") + F.sum(begins).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("file_path", ROW_NO).agg((F.col(ROW_NO) == F.max("first")).alias("header"),
                                                     text.alias("record"))


def read_history_csv(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """S3: rows of the export; quoted fields may span lines, quotes doubled.

    ``split=True``: by ``csv_records``, with the columns of the header and
    ``row_no``.  ``split=False`` reads each file in one task, for files with
    stray quotes in unquoted fields, whose records cannot be found by counting.
    """
    if not split:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    # The header line names the columns; only the first line of the input is looked at.
    head = spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=True)
    names = [c.lstrip("\ufeff") for c in head.columns]
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = csv_records(spark, path).where(~F.col("header") & (F.col("record") != ""))
    parsed = F.from_csv("record", fields.simpleString()[7:-1].replace(":", " "),
                        {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return rows.select(ROW_NO, parsed.alias("r")).select(ROW_NO, *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def parse_csv_date(s: Column) -> Column:
    """``%m/%d/%y, %I:%M %p`` -> timestamp; NULL when it does not parse.

    Any run of white space (U+202F before AM/PM included) counts as one
    space, as Python's strptime does.  Two-digit years 69..99 are 1969..1999
    (Python's pivot); Spark's ``yy`` alone would give 2069..2099.
    """
    norm = F.regexp_replace(strip_ws(s), r"(?U)\s+", " ")
    ts = F.try_to_timestamp(norm, F.lit("M/d/yy, h:m a"))
    yy = F.regexp_extract(norm, r"^\d{1,2}/\d{1,2}/(\d{2}),", 1).try_cast("int")
    return F.when(yy >= 69, ts - F.expr("INTERVAL '100' YEAR")).otherwise(ts)


def parse_conversation(text: Column) -> Column:
    """array<struct<role, content>> from marker-separated text.

    Part ``i + 1`` of the split belongs to marker ``i``; a marker on the
    last line without a newline has no part and yields nothing (D22).
    Content is trimmed, empties dropped, line-start ``* `` escaped.
    ``zip_with`` pairs markers and parts so each array is computed once per
    row (an array referenced inside a lambda is recomputed per element).
    """
    t = F.regexp_replace(text, r"\r\n?", "\n")
    split = F.split(t, SPLIT_MARKER, -1)
    parts = F.slice(split, F.lit(2), F.size(split))
    markers = F.regexp_extract_all(t, F.lit(FIND_MARKER), F.lit(1))
    msgs = F.zip_with(markers, parts, lambda m, p: F.struct(
        F.when(m == "Question", F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.coalesce(strip_ws(p), F.lit("")).alias("content"), m.isNotNull().alias("ok")))
    msgs = F.filter(msgs, lambda m: m["ok"] & (F.length(m["content"]) > 0))
    return F.transform(msgs, lambda m: F.struct(m["role"].alias("role"),
                                                escape_org_headlines(m["content"]).alias("content")))


def history_rows(csv_df: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """Rows with a valid date and at least one message.

    Columns: ``keep`` (passed through), row_no (the export's own, else the
    order of the input's partitions), ts, day, messages, topic.
    """
    msgs = parse_conversation(F.col("Conversation"))
    ts = parse_csv_date(F.col("Date"))
    first_user = F.filter(F.col("messages"), lambda m: m["role"] == "user")
    row_no = F.col(ROW_NO) if ROW_NO in csv_df.columns else F.monotonically_increasing_id().alias(ROW_NO)
    return (csv_df.select(*keep, row_no, ts.alias("ts"), msgs.alias("messages"))
            .where(F.col("ts").isNotNull() & (F.size("messages") > 0))
            .select(*keep, ROW_NO, "ts", F.to_date("ts").alias("day"), "messages",
                    topic_from_text(F.try_element_at(first_user, F.lit(1))["content"])
                    .alias("topic")))


def history_tables(csv_df: DataFrame, source: str = "history.csv", first_conversation_id: int = 1,
                   first_message_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Direct path: (conversations, messages), ordered by time, then CSV row.

    Ids are dense and follow that order (``plans.numbering``: a distributed
    range sort plus per-partition offsets, no single-partition window).  The
    rows are staged once; only their keys, topics and message counts are
    sorted, and the running count gives every conversation its first message id.
    """
    rows = staged(history_rows(csv_df), "history")
    keys = rows.select("ts", ROW_NO, "day", "topic", F.size("messages").cast("long").alias("_n"))
    convs = with_row_index(keys, ["ts", ROW_NO], "id", first_conversation_id, sums={"_base": "_n"})
    conversations = convs.select(
        "id", F.lit(source).alias("file_path"), F.col("day").alias("date"), "topic",
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("system_prompt"), F.col("ts").alias("created_at"))
    flat = rows.select("ts", ROW_NO, "messages").join(
        convs.select("ts", ROW_NO, F.col("id").alias("conversation_id"), "_base"), ["ts", ROW_NO]).select(
        "conversation_id", "_base", F.posexplode("messages").alias("j", "m"))
    messages = flat.select(
        (F.lit(first_message_id) + F.col("_base") + F.col("j")).cast("long").alias("id"), "conversation_id",
        F.col("m.role").alias("role"), F.col("m.content").alias("content"),
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
        token_estimate(F.col("m.content")).alias("token_count"))
    return conversations, messages


# -- rendering to note text (operators.render) -------------------------------------------

def day_messages(rows: DataFrame) -> DataFrame:
    """One row per message of ``history_rows``, keyed by its day file name."""
    return (rows.select(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(".org")).alias("file"),
                        "ts", "row_no", "topic", F.posexplode("messages").alias("j", "m"))
            .select("file", "ts", "row_no", "topic", "j", F.col("m.role").alias("role"),
                    F.col("m.content").alias("content")))


def render_days(rows: DataFrame) -> DataFrame:
    """Ordered text chunks of one note file per day (``render.render_chunks``).

    Conversations of a day are ordered by time, then CSV row.
    """
    return render_chunks(day_messages(rows), "file", ["ts", "row_no"], "j")


def write_day_files(chunks: DataFrame, out_dir: str) -> None:
    """One file ``YYYY-MM-DD.org`` per day, exactly the rendered text."""
    write_note_files(chunks, out_dir)
