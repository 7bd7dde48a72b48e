"""Text functions as Spark column expressions (JVM-side, codegen friendly).

Regex dialect notes: Python's ``^``/``$``/``.`` see only ``\\n`` as a line
break, Java's see several, so patterns carry ``(?d)`` (UNIX_LINES).  Python's
``\\s`` on ``str`` is Unicode, so patterns that must match Python's white
space carry ``(?U)``.  Offsets are code points: ``length``/``substring``
count code points, ``regexp_instr`` does not and is never used for offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() removes, as a set of characters: Unicode white
# space plus the separator controls U+001C..U+001F.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: trim all white space at both ends (linear time)."""
    return F.btrim(c, F.lit(BLANKS))


def first_line(c: Column) -> Column:
    """Text before the first newline (the whole text if there is none)."""
    return F.substring_index(c, "\n", 1)


def shorten(c: Column, width: int = 60, keep: int = 57, suffix: str = "...") -> Column:
    """Over ``width`` code points: first ``keep`` plus ``suffix``."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, keep), F.lit(suffix))).otherwise(c)


def topic_from_text(first_user_text: Column, default: str = "Conversation") -> Column:
    """Topic rule: first line of the first user message, trimmed, cut at 60."""
    return F.coalesce(shorten(strip_ws(first_line(first_user_text))), F.lit(default))


def token_estimate(content: Column) -> Column:
    """Token count fallback of the reference: ``len(text) // 4``."""
    return F.floor(F.length(content) / 4).cast("long")


def effective_tokens(token_count: Column, content: Column) -> Column:
    """``token_count or count_tokens(content)``: stored zero/NULL is recomputed."""
    return F.coalesce(F.nullif(token_count, F.lit(0)), token_estimate(content))


# Org markup clean-up, in the reference's fixed order.  Each entry is
# (pattern, replacement) for regexp_replace.
_ORG_STEPS = [
    (r"(?mdU)^\*+\s+", ""),                                   # headline stars
    (r"(?si)#\+begin_src.*?#\+end_src", ""),                   # source blocks
    (r"(?si)#\+begin_quote.*?#\+end_quote", ""),               # quote blocks
    (r"(?si)#\+begin_example.*?#\+end_example", ""),           # example blocks
    (r"(?d)#\+RESULTS:.*?\n", ""),                             # results line
    (r"(?d)\[\[.*?\]\[?(.*?)\]?\]", "$1"),                      # links -> label
    (r"(?smd)^:PROPERTIES:.*?:END:(?U)\s*", ""),               # drawers
    (r"(?md)^#\+.*$", ""),                                     # other directives
    (r"(?U)@(user|assistant)\s*", ""),                         # chat markers
    (r"\n{3,}", "\n\n"),                                        # blank runs
]


#: What the steps after the first look for; a text without any of these passes them unchanged.
_ORG_MARKS = ["#+", "[[", ":PROPERTIES:", "@user", "@assistant", "\n\n\n"]


def strip_org_formatting(c: Column) -> Column:
    """The clean-up of ``_ORG_STEPS``, then ``strip_ws``.  ``c``: a column of the row, as it is read several times.

    Plain searches tell which steps can find anything: the first needs a star
    at the start of a line, the others one of ``_ORG_MARKS``.  The first never
    makes such a mark: what it removes lies between a line's start and a
    character that is not white space.
    """
    (pattern, repl), *steps = _ORG_STEPS
    lines = F.when(F.startswith(c, F.lit("*")) | F.contains(c, F.lit("\n*")), F.regexp_replace(c, pattern, repl)).otherwise(c)
    marked, whole = F.lit(False), lines
    for mark in _ORG_MARKS:
        marked = marked | F.contains(c, F.lit(mark))
    for pattern, repl in steps:
        whole = F.regexp_replace(whole, pattern, repl)
    return strip_ws(F.when(marked, whole).otherwise(lines))


def escape_org_headlines(c: Column) -> Column:
    """Line-start ``* `` becomes ``- `` (one star only)."""
    return F.regexp_replace(c, r"(?md)^\* ", "- ")


def ascii_lower(c: Column) -> Column:
    """Case folding of SQLite's LIKE: A-Z only, other letters untouched."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_escape(text: str) -> str:
    """Make user text literal inside a LIKE pattern (escape char ``!``)."""
    return text.replace("!", "!!").replace("%", "!%").replace("_", "!_")


def contains_folded(c: Column, needle: str, wildcards: bool = False) -> Column:
    """``c LIKE '%needle%'`` with SQLite's ASCII-only case folding.

    By default the user's ``%``/``_`` are literal; ``wildcards=True`` keeps
    SQLite's behaviour of treating them as wildcards.
    """
    folded = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                            "abcdefghijklmnopqrstuvwxyz"))
    if wildcards:
        return F.like(ascii_lower(c), F.lit(f"%{folded}%"))
    return F.like(ascii_lower(c), F.lit(f"%{like_escape(folded)}%"), F.lit("!"))
