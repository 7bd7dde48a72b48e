"""Render conversations as day-note text with response bounds.

A note file is: a file drawer whose ``GPTEL_BOUNDS`` line lists every
response span (1-based, absolute), then one ``* topic`` section per
conversation with its messages.  The reference builds the whole text in one
string per day; here every piece of text is a row:

* one row per conversation head and per message, each carrying the exact
  text it contributes (``piece``) -- a row-local projection;
* the position of each piece in its file is an exclusive running sum of
  piece lengths in (file, conversation order, message order), computed with
  a distributed range sort of keys and lengths (``plans.numbering``), so a
  file that holds a third of all messages is still spread over many tasks,
  and no text is sorted; the texts are joined to their positions by key;
* the drawer length depends on its own digits (the reference iterates ten
  times from ``((response))``).  ``drawer_lengths`` needs no round over the
  spans: a number gains a digit when the drawer is as long as its distance to
  the next power of ten, so one histogram of distances per file answers every
  round; the drawer text itself is emitted as one chunk per span;
* files are written by streaming the ordered chunks: a task opens a file
  when the file key changes and appends chunk by chunk, so its memory does
  not depend on the size of a file.

``note_texts`` assembles whole texts as a DataFrame column (one row per
file) for callers that parse them back; that is the unit of the note
format, which the note reader also takes whole (``wholetext``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import shorten, strip_ws
from chatlake.plans.numbering import with_row_index

# The drawer and headline layout of a rendered note file.
DRAWER_HEAD = ":PROPERTIES:\n:GPTEL_BOUNDS: "
DRAWER_TAIL = "\n:END:\n\n"
EMPTY_BOUNDS = "((response))"
BOUNDS_OPEN = "((response"
BOUNDS_CLOSE = "))"
RESPONSE_HEAD = "*** Response\n"
ROUNDS = 10
CHUNK = 4096

# Parts of a file, in write order.
PART_OPEN, PART_SPAN, PART_CLOSE, PART_BODY = 0, 1, 2, 3


# Lines as Python sees them: only \n ends a line; other white space may lead.
_LEAD = r"[[^\S\n]\x{1c}-\x{1f}]*"
_FENCE_LINE = rf"(?mdU)^{_LEAD}```.*$"
_HEADING_LINE = r"(?mdU)^#{1,6}[^\S\n].*$"
_INLINE = [(r"`([^`\n]+)`", "~$1~"), (r"\*\*(.+?)\*\*", "*$1*"),
           (r"!\[([^\]\n]*)\]\(([^)\n]+)\)", "[[$2]]"), (r"\[([^\]\n]+)\]\(([^)\n]+)\)", "[[$2][$1]]")]


def _prose(text: Column) -> Column:
    """Text outside fences: headings three levels deeper, inline marks elsewhere."""
    def heading(h):
        marks = F.regexp_extract(h, r"^(#{1,6})", 1)
        rest = F.regexp_extract(h, r"(?dU)^#{1,6}\s+(.*)", 1)
        return F.concat(F.repeat(F.lit("*"), F.length(marks) + 3), F.lit(" "), rest)

    def inline(t):
        for pat, rep in _INLINE:
            t = F.regexp_replace(t, "(?d)" + pat, rep)
        return t
    return F.array_join(F.zip_with(
        F.split(text, _HEADING_LINE, -1), F.regexp_extract_all(text, F.lit(_HEADING_LINE), F.lit(0)),
        lambda t, h: F.concat(inline(t), F.coalesce(heading(h), F.lit("")))), "")


def markdown_to_org(text: Column) -> Column:
    """Fences -> src blocks, headings +3 levels, inline code, bold, images, links.

    The text is split at fence lines; pieces are prose and code by turns, and
    code stays as it is.  Prose is split at heading lines in the same way, so
    every character is looked at a fixed number of times.
    """
    def fence(f, i):
        lang = strip_ws(F.substr(strip_ws(f), F.lit(4)))
        begin = F.when(F.length(lang) > 0, F.concat(F.lit("#+begin_src "), lang)).otherwise("#+begin_src")
        return F.when(i % 2 == 0, begin).otherwise("#+end_src")

    fences = F.transform(F.regexp_extract_all(text, F.lit(_FENCE_LINE), F.lit(0)), fence)
    pieces = F.transform(F.split(text, _FENCE_LINE, -1), lambda t, i: F.when(i % 2 == 0, _prose(t)).otherwise(t))
    return F.array_join(F.zip_with(pieces, fences, lambda t, f: F.concat(t, F.coalesce(f, F.lit("")))), "")


def _digits(v: Column) -> Column:
    return F.length(v.cast("string"))


def drawer_lengths(spans: DataFrame) -> DataFrame:
    """(file, h): length of the drawer around the bounds of (file, s, e) spans, 0-based in the body.

    With a drawer of length h an end at p stands as p + h + 1.  Its digits are
    those of p + 1 and one more for every power of ten whose distance to p + 1
    is at most h, so all digits of a file are a constant and a count over a
    histogram of distances; the rounds are taken on that one row.  Only
    distances that h can reach are counted: h is below 42 a span.
    """
    start = len(DRAWER_HEAD) + len(EMPTY_BOUNDS) + len(DRAWER_TAIL)
    fixed = len(DRAWER_HEAD) + len(BOUNDS_OPEN) + len(BOUNDS_CLOSE) + len(DRAWER_TAIL)
    plain = spans.groupBy("file").agg(
        (F.lit(fixed) + F.sum(_digits(F.col("s") + 1) + _digits(F.col("e") + 1) + 4)).alias("plain"),
        (F.lit(start) + 42 * F.count(F.lit(1))).alias("most"))
    powers = F.array(*[F.lit(10 ** d).cast("long") for d in range(1, 19)])
    near = (spans.select("file", F.explode(F.array(F.col("s") + 1, F.col("e") + 1)).alias("p")).join(plain, "file")
            .select("file", F.explode(F.filter(F.transform(powers, lambda t: t - F.col("p")),
                                               lambda d: (d > 0) & (d <= F.col("most")))).alias("d")))
    bins = (near.groupBy("file", "d").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("file").agg(F.collect_list(F.struct("d", "n")).alias("bins")))

    def longer(h, _):
        return F.aggregate("bins", F.col("plain"), lambda sum_, x: sum_ + F.when(x["d"] <= h, x["n"]).otherwise(F.lit(0)))

    solved = F.aggregate(F.sequence(F.lit(2), F.lit(ROUNDS)), F.lit(start).cast("long"), longer)
    none = F.expr("cast(array() as array<struct<d:bigint,n:bigint>>)")
    return (plain.join(bins, "file", "left").withColumn("bins", F.coalesce("bins", none))
            .select("file", solved.alias("h")))


def placed_pieces(msgs: DataFrame, file_col: str, conv_order: list[str], msg_order: str,
                  topic_col: str = "topic") -> tuple[DataFrame, DataFrame]:
    """(pieces, places) of note files.

    Pieces: file, the conversation's order columns, _j, _ai, _lead, piece (one
    head per conversation and one per message).  Places: the same keys with _ai,
    _lead (length of a response), _pos (order in the file) and _off (offset of
    the piece in the body).
    """
    conv_cols = [F.col(file_col).alias("file"), *conv_order]
    heads = msgs.groupBy(*conv_cols).agg(F.first(topic_col).alias("topic"))
    heads = heads.select("file", *conv_order, F.lit(-1).cast("long").alias("_j"),
                         F.lit(False).alias("_ai"), F.lit(0).cast("long").alias("_lead"),
                         F.concat(F.lit("* "), F.col("topic"), F.lit("\n:PROPERTIES:\n:GPTEL_TOPIC: "),
                                  F.col("topic"), F.lit("\n:END:\n\n")).alias("piece"))
    user = F.col("role") == "user"
    content = F.col("content")
    rows = msgs.select(*conv_cols, F.col(msg_order).cast("long").alias("_j"), user.alias("_user"), "content",
                       F.when(~user, markdown_to_org(content)).alias("_body"))
    piece = F.when(F.col("_user"), F.concat(F.lit("** "), shorten(strip_ws(F.substring_index(content, "\n", 1))),
                                            F.lit("\n"), content, F.lit("\n\n"))
                   ).otherwise(F.concat(F.lit(RESPONSE_HEAD), F.col("_body"), F.lit("\n\n")))
    lines = rows.select("file", *conv_order, "_j", (~F.col("_user")).alias("_ai"),
                        F.coalesce(F.length("_body"), F.lit(0)).cast("long").alias("_lead"), piece.alias("piece"))
    pieces = heads.unionByName(lines)
    keys = pieces.select("file", *conv_order, "_j", "_ai", "_lead", F.length("piece").cast("long").alias("_len"))
    places = with_row_index(keys, [*conv_order, "_j"], "_pos", sums={"_off": "_len"}, partition_by=["file"])
    return pieces, places


def response_spans(places: DataFrame) -> DataFrame:
    """(file, _pos, s, e): responses in the body, 0-based, end exclusive."""
    start = F.col("_off") + F.lit(len(RESPONSE_HEAD))
    return places.where("_ai").select("file", "_pos", start.alias("s"), (start + F.col("_lead")).alias("e"))


def rendered_offsets(places: DataFrame) -> DataFrame:
    """(file, _pos, s, e): the 1-based bounds of every response as the file's drawer states them."""
    spans = response_spans(places)
    return spans.join(drawer_lengths(spans), "file").select(
        "file", "_pos", (F.col("s") + F.col("h") + 1).alias("s"), (F.col("e") + F.col("h") + 1).alias("e"))


def render_chunks(msgs: DataFrame, file_col: str, conv_order: list[str], msg_order: str,
                  topic_col: str = "topic") -> DataFrame:
    """Ordered text chunks of note files: (file, part, k1, k2, chunk).

    ``msgs`` has one row per message: the file key, the conversation's
    order columns (they identify the conversation inside its file), the
    message position ``msg_order``, ``role``, ``content`` and the
    conversation's topic.  Writing the chunks of a file in
    (part, k1, k2) order gives exactly the reference's file text.
    """
    pieces, places = placed_pieces(msgs, file_col, conv_order, msg_order, topic_col)
    spans = rendered_offsets(places)
    files = spans.select("file").distinct()

    def chunk(df: DataFrame, part: int, k1: Column, text: Column) -> DataFrame:
        return df.select("file", F.lit(part).alias("part"), k1.cast("long").alias("k1"),
                         F.lit(0).cast("long").alias("k2"), text.alias("chunk"))

    keys = ["file", *conv_order, "_j"]
    body = pieces.select(*keys, "piece").join(places.select(*keys, "_pos"), keys)
    return (chunk(files, PART_OPEN, F.lit(0), F.lit(DRAWER_HEAD + BOUNDS_OPEN))
            .unionByName(chunk(spans, PART_SPAN, F.col("_pos"), F.format_string(" (%d %d)", F.col("s"), F.col("e"))))
            .unionByName(chunk(files, PART_CLOSE, F.lit(0), F.lit(BOUNDS_CLOSE + DRAWER_TAIL)))
            .unionByName(chunk(body, PART_BODY, F.col("_pos"), F.col("piece"))))


def note_texts(chunks: DataFrame, block: int = CHUNK) -> DataFrame:
    """Whole file text per file: (file, content).

    Two ordered string aggregations: first per block of ``block``
    consecutive chunks, then over the block strings, so no task sorts more
    than ``block`` chunks of one file.
    """
    keyed = chunks.select("file", (F.col("part") * F.lit(1 << 40) + F.col("k1")).alias("_k"),
                          "k2", "chunk")
    blocks = (keyed.groupBy("file", F.floor(F.col("_k") / block).alias("_b"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "k2", "chunk"))),
                                            lambda x: x["chunk"]), "").alias("s")))
    return (blocks.groupBy("file")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "s"))),
                                          lambda x: x["s"]), "").alias("content")))


def write_note_files(chunks: DataFrame, out_dir: str, name_col: str = "file") -> None:
    """One file ``<file>`` per file key under ``out_dir``, streamed chunk by chunk.

    Each task writes its files to a temporary name and renames it when the
    file is complete, so a retried or speculative task after an executor
    loss leaves one whole file, never a mix.
    """
    def write(rows):
        import uuid

        from pyarrow import fs as pafs
        filesystem, root = pafs.FileSystem.from_uri(out_dir)
        filesystem.create_dir(root, recursive=True)
        tmp_dir = f"{root}/_tmp-{uuid.uuid4().hex}"
        filesystem.create_dir(tmp_dir, recursive=True)
        current, stream, tmp, count = None, None, None, 0

        def close():
            if stream is not None:
                stream.close()
                filesystem.create_dir(f"{root}/{current}".rpartition("/")[0], recursive=True)
                filesystem.move(tmp, f"{root}/{current}")
        try:
            for r in rows:
                if r[name_col] != current:
                    close()
                    current = r[name_col]
                    count += 1
                    tmp = f"{tmp_dir}/{count}"
                    stream = filesystem.open_output_stream(tmp)
                stream.write(r["chunk"].encode("utf-8"))
            close()
        finally:
            # A failed task leaves nothing behind; its retry starts anew.
            filesystem.delete_dir(tmp_dir)

    (chunks.repartition(name_col)
     .sortWithinPartitions(name_col, "part", "k1", "k2")
     .foreachPartition(write))
