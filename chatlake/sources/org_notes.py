"""Day-note ingest: a folder of ``YYYY-MM-DD.org`` files -> conversations + messages.

Each file is read whole (one row, as a file cannot be split without losing
offsets) and split into its sections there; from then on a section is a row.
Sections and what the file's drawer says are staged once, in one scan of the
files (``stage_notes``); every later step reads only the columns it uses:

* section starts are running sums of section lengths;
* bounds find their section by a sweep over the positions of a file: sections
  and bounds are one ordered sequence in which the last section so far is
  carried on, so the work is linear in both (``assign_bounds``);
* the bounds of a section are grouped under its key and joined to its text,
  which is cut in one pass over blocks of it;
* from then on a message is a row: markup clean-up runs over all tasks, however
  many messages a section has, and its result is staged;
* numbering sorts keys only; texts are never sorted.

* the file drawer is the first ``:PROPERTIES: ... :END:`` anywhere;
* bounds are 1-based, section offsets 0-based, compared without shift;
* sections start at lines ``* <text>``; no section -> the whole file is one
  conversation; a section keeps only bounds wholly inside it;
* text before, between and after responses is the user's; the "previous
  end" is the preceding bound's end, not the running maximum;
* message offsets are relative to the section and shifted by -1.

A file that cannot be read, is not UTF-8, or has a date in its name that does
not exist is a row of the reject table, and the others are ingested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions.text import strip_org_formatting, strip_ws, token_estimate
from chatlake.plans.numbering import with_row_index
from chatlake.plans.staging import staged

DRAWER = r"(?sU):PROPERTIES:\s*\n(.*?):END:"
DATE_NAME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\.org$"
HEADLINE_SPLIT = r"(?md)(?=^\* .+$)"


#: A file is one value; larger ones are rejected, not read.
LARGEST = (1 << 31) - 1
NOT_READ, TOO_LARGE = "file could not be read", "file is too large"
NOT_UTF8, BAD_DATE = "file is not UTF-8", "impossible date in file name"


def scan_note_files(spark: SparkSession, directory: str) -> DataFrame:
    """(file_path, raw, reason) for every ``*.org`` directly in ``directory``.

    The folder is listed apart from the contents, so a file that fails while
    it is read has a row with a reason, and the job goes on.
    """
    def files(**options):
        return spark.read.format("binaryFile").options(pathGlobFilter="*.org", **options).load(directory)

    # Without the content column no file is opened.
    listed = files().select(F.col("path").alias("file_path"), "length")
    read = files(ignoreCorruptFiles=True, ignoreMissingFiles=True).where(F.col("length") <= LARGEST).select(
        F.col("path").alias("file_path"), F.col("content").alias("raw"))
    reason = (F.when(F.col("raw").isNotNull() & ~F.is_valid_utf8(F.col("raw").cast("string")), F.lit(NOT_UTF8))
              .when(F.col("raw").isNull() & (F.col("length") > LARGEST), F.lit(TOO_LARGE))
              .when(F.col("raw").isNull(), F.lit(NOT_READ)))
    return listed.join(read, "file_path", "left").select("file_path", "raw", reason.alias("reason"))


def texts_of(scanned: DataFrame) -> DataFrame:
    """(file_path, content) of the readable files.

    Newlines are normalised as Python's text reading does (CRLF and CR become LF).
    """
    text = F.col("raw").cast("string")
    return scanned.where("reason is null").select("file_path", F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text).alias("content"))


def read_note_files(spark: SparkSession, directory: str) -> DataFrame:
    """(file_path, content) of every readable ``*.org`` directly in ``directory``."""
    return texts_of(scan_note_files(spark, directory))


def drawer_text(c: Column) -> Column:
    """Body of the first drawer anywhere in ``c`` (NULL if there is none)."""
    return F.when(c.rlike(DRAWER), F.regexp_extract(c, DRAWER, 1))


def drawer_value(drawer: Column, key: str) -> Column:
    """Value after ``:KEY:`` on a drawer line (last one wins), trimmed."""
    vals = F.regexp_extract_all(drawer, F.lit(rf"(?mdU)^[^\S\n]*:{key}:(.*)$"), F.lit(1))
    return strip_ws(F.try_element_at(vals, F.lit(-1)))


def parse_bounds(s: Column) -> Column:
    """``((response (a b) ...))`` or ``((a . b) ...)`` -> array<struct<s,e>>."""
    new_pat, old_pat = r"(?U)\((\d+)\s+(\d+)\)", r"(?U)\((\d+)\s*\.\s*(\d+)\)"

    # Numbers beyond 64 bits lie behind every text.
    far = F.lit(1 << 62)

    def pairs(pat):
        return F.zip_with(F.regexp_extract_all(s, F.lit(pat), F.lit(1)), F.regexp_extract_all(s, F.lit(pat), F.lit(2)),
                          lambda a, b: F.struct(F.coalesce(a.try_cast("long"), far).alias("s"),
                                                F.coalesce(b.try_cast("long"), far).alias("e")))
    return F.when(s.isNull(), F.array().cast("array<struct<s:long,e:long>>")).when(
        F.contains(s, F.lit("response")), pairs(new_pat)).otherwise(pairs(old_pat))


#: Characters of a block; a message is cut from the blocks that it lies in, not by a walk from the start of its section.
BLOCK = 4096


def text_blocks(text: Column) -> Column:
    """The text in consecutive blocks of ``BLOCK`` characters, the last one shorter: array<string>."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def py_slice(blocks: Column, a: Column, b: Column, n: Column) -> Column:
    """Python's ``text[a:b]`` (negative indices count from the end, clamped) of a text of ``n`` characters.

    ``blocks``: ``text_blocks`` of the text, a column of the row; only those
    from ``a`` to ``b`` are looked at, so all cuts of a text take linear time.
    """
    def norm(i):
        return F.when(i < 0, F.greatest(i + n, F.lit(0).cast("long"))).otherwise(F.least(i, n))
    a2, b2, size = norm(a), norm(b), F.lit(BLOCK)
    first, last = F.floor(a2 / size).cast("int"), F.floor((b2 - 1) / size).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(b2 > a2, near.substr((a2 % size + 1).cast("int"), (b2 - a2).cast("int"))).otherwise(F.lit(""))


def _segments(n: Column, sb: Column) -> Column:
    """Cut a unit of text at its sorted response bounds into raw segments.

    ``sb`` = bounds shifted to 0-based and sorted by start (ties in input
    order), a column of the row, so the lambda below reads it without
    recomputing it.  Returns array<struct<role, a, b, keep>> in order: for
    each bound the user gap since the previous bound's end (if any) and the
    response; then the rest of the text.
    """
    prev_end = F.concat(F.array(F.lit(0).cast("long")),
                        F.slice(F.transform(sb, lambda x: x["e"]), 1, F.greatest(F.size(sb) - 1, F.lit(0))))

    def pieces(x, prev):
        user = F.struct(F.lit("user").alias("role"), prev.alias("a"), x["s"].alias("b"),
                        (x["s"] > prev).alias("keep"))
        resp = F.struct(F.lit("assistant").alias("role"), x["s"].alias("a"), x["e"].alias("b"),
                        F.lit(True).alias("keep"))
        return F.array(user, resp)

    last_end = F.element_at(sb, -1)["e"]
    tail = F.struct(F.lit("user").alias("role"), last_end.alias("a"), n.alias("b"),
                    (last_end < n).alias("keep"))
    segs = F.concat(F.flatten(F.zip_with(sb, prev_end, pieces)), F.array(tail))
    return F.filter(segs, lambda s: s["keep"])


def unit_messages(blocks: Column, sb: Column, n: Column) -> Column:
    """Messages of one unit before their clean-up: array<struct<role, raw, char_start, char_end>>.

    ``blocks``: ``text_blocks`` of the unit's text; ``sb``: 0-based bounds
    sorted by start, ties in drawer order; ``n``: the text's length; all columns
    of the row.
    """
    return F.transform(_segments(n, sb), lambda s: F.struct(
        s["role"].alias("role"), py_slice(blocks, s["a"], s["b"], n).alias("raw"),
        s["a"].cast("int").alias("char_start"), s["b"].cast("int").alias("char_end")))


FACTS = ("date", "bad_date", "length", "bounds", "model", "system_prompt")


def stage_notes(files: DataFrame) -> DataFrame:
    """One row per section of (file_path, content) texts: file_path, k, text, n (its length) and, at k = 0, the file's facts.

    Piece 0 is what precedes the first section.  Facts: date, bad_date (a dated
    name whose date does not exist), length, and of the file's drawer bounds,
    model and system_prompt.
    """
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    dated = name.rlike(DATE_NAME)
    date = F.when(dated, F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd"))
    f = files.select("file_path", "content", date.alias("date"), (dated & date.isNull()).alias("bad_date"),
                     F.length("content").cast("long").alias("length"), drawer_text(F.col("content")).alias("drawer"))
    f = f.select("file_path", "content", "date", "bad_date", "length",
                 drawer_value(F.col("drawer"), "GPTEL_BOUNDS").alias("bounds"),
                 *[drawer_value(F.col("drawer"), f"GPTEL_{k}").alias(c)
                   for k, c in (("MODEL", "model"), ("SYSTEM", "system_prompt"))])
    f = f.withColumn("bounds", parse_bounds(F.col("bounds")))
    # A newline in front lets a headline on the first line start a section like any other.
    pieces = f.select("file_path", *FACTS, F.posexplode(F.split(F.concat(F.lit("\n"), "content"), HEADLINE_SPLIT, -1))
                      .alias("k", "piece"))
    first = F.col("k") == 0
    text = F.when(first, F.substr("piece", F.lit(2))).otherwise(F.col("piece"))
    return staged(pieces.select("file_path", "k", text.alias("text"), F.length(text).cast("long").alias("n"),
                                *[F.when(first, F.col(c)).alias(c) for c in FACTS]), "notes")


def file_facts(notes: DataFrame) -> DataFrame:
    """One row per file of staged notes: file_path and its facts."""
    return notes.where("k = 0").select("file_path", *FACTS)


def section_spans(notes: DataFrame) -> DataFrame:
    """(file_path, k, start, end) of every section; a file without sections has one whole span, k = 0."""
    every = Window.partitionBy("file_path")
    w = every.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(w), F.lit(0))
    spans = notes.select("file_path", "k", start.alias("start"), (start + F.col("n")).alias("end"),
                         F.max("k").over(every).alias("last"))
    return spans.where((F.col("k") > 0) | (F.col("last") == 0)).drop("last")


def assign_bounds(bounds: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_path, k, i, s, e): every bound of a file with the sections that it lies in.

    ``bounds``: file_path, i, s, e, length (of the file).  A bound lies in the
    sections with start <= s and e <= end.  The last of them is the last that
    starts up to s, the first the last that starts before e (or section 1); so
    one ordered pass over the starts and both ends finds the range, which for a
    bound of positive length has at most one section.
    """
    none = F.lit(None)
    at_sections = spans.select("file_path", F.col("start").alias("at"), F.lit(1).alias("kind"), "k",
                               none.cast("int").alias("i"), none.cast("long").alias("s"), none.cast("long").alias("e"),
                               none.cast("long").alias("length"))
    ends = [bounds.select("file_path", F.col(c).alias("at"), F.lit(kind).alias("kind"), none.cast("int").alias("k"),
                          "i", "s", "e", "length") for c, kind in (("e", 0), ("s", 2))]
    w = Window.partitionBy("file_path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = at_sections.unionByName(ends[0]).unionByName(ends[1]).select(
        "*", F.last("k", ignorenulls=True).over(w).alias("hit"),
        F.max("k").over(Window.partitionBy("file_path")).alias("last"))
    found = (swept.where("i is not null").groupBy("file_path", "i", "s", "e", "length", "last")
             .agg(F.max(F.when(F.col("kind") == 2, F.col("hit"))).alias("high"),
                  F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("hit"))), F.lit(1)).alias("low")))
    whole = F.col("last") == 0
    # Behind the end of the file there is no section that holds the bound.
    inside = (F.col("e") <= F.col("length")) & (F.col("low") <= F.col("high"))
    return found.where(whole | inside).select("file_path", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(
        F.sequence("low", "high"))).alias("k"), "i", "s", "e")


def note_bounds(notes: DataFrame, strict_offsets: bool = True) -> DataFrame:
    """(file_path, k, i, s, e): the bounds of each section, relative to its start, i in the order of the drawer.

    ``strict_offsets``: 1-based bounds are compared with 0-based sections as
    they are, as the format's parser does, so a response that ends where the
    next headline starts, or at the end of the file, is dropped; False takes
    one off the bounds first and keeps it.
    """
    spans, shift = section_spans(notes), F.lit(0 if strict_offsets else 1)
    bounds = file_facts(notes).where(~F.col("bad_date")).select(
        "file_path", "length", F.posexplode("bounds").alias("i", "b")).select(
        "file_path", "length", "i", (F.col("b.s") - shift).alias("s"), (F.col("b.e") - shift).alias("e"))
    start = F.col("start") - shift
    return assign_bounds(bounds, spans).join(spans, ["file_path", "k"]).select(
        "file_path", "k", "i", (F.col("s") - start).alias("s"), (F.col("e") - start).alias("e"))


def section_topic(text: Column, k: Column) -> Column:
    """The topic of a section's own drawer, else its title; of a file without sections its drawer's."""
    own = drawer_value(drawer_text(text), "GPTEL_TOPIC")
    title = strip_ws(F.substr(F.substring_index(text, "\n", 1), F.lit(3)))
    return F.when(k > 0, F.coalesce(F.nullif(own, F.lit("")), title)).otherwise(own)


def note_sections(notes: DataFrame) -> DataFrame:
    """(file_path, k, start, end, topic) of every section (see ``section_spans``)."""
    return notes.select("file_path", "k", section_topic(F.col("text"), F.col("k")).alias("topic")).join(
        section_spans(notes), ["file_path", "k"]).select("file_path", "k", "start", "end", "topic")


def parse_notes(notes: DataFrame, strict_offsets: bool = True) -> DataFrame:
    """One row per message: file_path, k (order in the file), j (order in the section), role, content, char_start, char_end, n.

    A section is cut in one pass; its messages are then rows that are dealt out
    by their own keys, so those of one long section are cleaned in many tasks.
    They are staged, as the clean-up is the dearest step and several read it;
    ``n``, the content's length, lets those that need no text leave it on disk.
    """
    sb = F.array_sort(F.collect_list(F.struct((F.col("s") - 1).alias("s"), "i", (F.col("e") - 1).alias("e"))))
    cut_at = note_bounds(notes, strict_offsets).groupBy("file_path", "k").agg(sb.alias("sb"))
    # The join keeps the blocks a column of their own; below the cuts they would be made for each.
    unit = notes.select("file_path", "k", "n", text_blocks(F.col("text")).alias("blocks")).join(cut_at, ["file_path", "k"])
    cut = unit.select("file_path", "k", F.posexplode(unit_messages(F.col("blocks"), F.col("sb"), F.col("n"))).alias("j", "m"))
    rows = cut.select("file_path", "k", "j", "m.*").repartition("file_path", "k", "j")
    clean = rows.select("file_path", "k", "j", "role", strip_org_formatting(F.col("raw")).alias("content"),
                        "char_start", "char_end")
    return staged(clean.select("*", F.length("content").alias("n")), "messages").where("n > 0")


def parse_files(files: DataFrame, strict_offsets: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``parse_notes`` rows, one row per section with its topic and the file's facts, one row per file).

    The last has file_path, date and bad_date.
    """
    notes = stage_notes(files)
    facts = file_facts(notes)
    topics = notes.select("file_path", "k", section_topic(F.col("text"), F.col("k")).alias("topic"))
    about = facts.select("file_path", "date", "model", "system_prompt")
    return (parse_notes(notes, strict_offsets),
            topics.join(about, "file_path").select("file_path", "k", "date", "topic", "model", "system_prompt"),
            facts.select("file_path", "date", "bad_date"))


def ingest_notes(spark: SparkSession, directory: str, first_conversation_id: int = 1,
                 first_message_id: int = 1, strict_offsets: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1+S2+W4: parse a folder; returns (conversations, messages, rejected files with a reason).

    Ids follow file-name order, then section order, then message order, and
    start at the given values (pass ``max(id) + 1`` of stored tables to
    append, as AUTOINCREMENT would).
    """
    scanned = scan_note_files(spark, directory)
    convs, messages, rejected = ingest_texts(texts_of(scanned), first_conversation_id, first_message_id,
                                             strict_offsets)
    unread = scanned.where("reason is not null").select("file_path", "reason")
    return convs, messages, unread.unionByName(rejected)


def ingest_texts(files: DataFrame, first_conversation_id: int = 1, first_message_id: int = 1,
                 strict_offsets: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S2+W4 over a frame of (file_path, content) note texts; see ``ingest_notes``.

    Numbering is two distributed ``with_row_index`` over keys, of messages in
    (file name, unit, place) order and of the units that have some; the ids are
    joined back to the texts by the messages' keys.
    """
    parsed, units, info = parse_files(files, strict_offsets)
    rejected = info.where("bad_date").select("file_path", F.lit(BAD_DATE).alias("reason"))
    place = ["file_path", "k", "j"]
    ids = with_row_index(parsed.select(*place), place, "id", first_message_id)
    found = units.join(ids.select("file_path", "k").distinct(), ["file_path", "k"])
    numbered = with_row_index(found, ["file_path", "k"], "id", first_conversation_id)
    convs = numbered.select("id", "file_path", "date", "topic", "model", "system_prompt",
                            F.current_timestamp().alias("created_at"))
    ids = ids.join(numbered.select("file_path", "k", F.col("id").alias("conversation_id")), ["file_path", "k"])
    messages = parsed.join(ids, place).select(
        "id", "conversation_id", "role", "content", "char_start", "char_end", token_estimate(F.col("content")).alias("token_count"))
    return convs, messages, rejected
