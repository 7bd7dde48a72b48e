"""Parsing of model replies: fenced or bare JSON inside free text.

Rules (the reference's parse): trim; if a triple back-tick fence occurs,
take the text after the first fence, drop a leading ``json`` tag and trim
again; then cut from the first opening bracket to the last closing one
(``[``/``]`` for insight arrays, ``{``/``}`` for a summary object) when both
exist in that order.  What is left must be exactly one strict JSON value;
the elements of an array are parsed one by one, so a bad one costs only
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import strip_ws

FENCE = "```"

_CORRUPT = "corrupt"
_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": _CORRUPT}
INSIGHT_ITEM = ("struct<category:string,title:string,summary:string,"
                f"tags:array<string>,confidence:string,{_CORRUPT}:string>")
SUMMARY_OBJECT = ("struct<summary:string,key_topics:array<string>,"
                  f"sentiment:string,outcome:string,{_CORRUPT}:string>")

def unfence(t: Column) -> Column:
    """Trimmed reply -> the text inside its first fence, or itself."""
    inner = F.split_part(t, F.lit(FENCE), F.lit(2))
    inner = F.when(F.startswith(inner, F.lit("json")), F.substr(inner, F.lit(5))).otherwise(inner)
    return F.when(F.contains(t, F.lit(FENCE)), strip_ws(inner)).otherwise(t)


def cut_between(text: Column, open_ch: str, close_ch: str) -> Column:
    """From the first ``open_ch`` to the last ``close_ch``, if both exist in that order."""
    a = F.locate(open_ch, text)
    b = F.length(text) - F.length(F.substring_index(text, close_ch, -1))
    return F.when((a > 0) & (b > a), text.substr(a, b - a + 1)).otherwise(text)


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds a column that is evaluated once a row.

    The optimizer copies an expression into every later use of its column; a
    generator of one row stops that, and texts are trimmed and parsed once.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def with_json(df: DataFrame, open_ch: str, close_ch: str, shape: str = "string") -> DataFrame:
    """Adds ``json``: the one strict JSON value in ``reply`` that opens with ``open_ch``, read as ``shape``.

    NULL when the cut text is not exactly one such value: the text is parsed as
    the only element of an array, so text after it, a second value or single
    quotes make it invalid.
    """
    df = once(df, "_s", strip_ws(F.col("reply")))
    df = once(df, "_u", unfence(F.col("_s"))).drop("_s")
    df = once(df, "_t", cut_between(F.col("_u"), open_ch, close_ch)).drop("_u")
    df = once(df, "_v", F.from_json(F.concat(F.lit("["), F.col("_t"), F.lit("]")), f"array<{shape}>",
                                    {"allowSingleQuotes": "false"}))
    one = (F.size("_v") == 1) & F.startswith(F.ltrim(F.col("_t")), F.lit(open_ch))
    return df.withColumn("json", F.when(one, F.get("_v", F.lit(0)))).drop("_t", "_v")


def parse_insight_items(df: DataFrame) -> DataFrame:
    """Adds ``items``: the array's elements as JSON texts; NULL if there is no array."""
    return with_json(df, "[", "]", "array<string>").withColumnRenamed("json", "items")


def parse_insight(item: Column) -> Column:
    """One element -> struct, NULL when it is no object; ``corrupt`` is set when a field doesn't parse."""
    return F.when(F.startswith(F.ltrim(item), F.lit("{")), F.from_json(item, INSIGHT_ITEM, _OPTIONS))


def parse_summary_object(df: DataFrame) -> DataFrame:
    """Adds ``o``: the summary object; NULL if there is none or its fields don't parse."""
    df = once(with_json(df, "{", "}"), "_o", F.from_json("json", SUMMARY_OBJECT, _OPTIONS))
    return df.withColumn("o", F.when(F.col(f"_o.{_CORRUPT}").isNull() & F.col("json").isNotNull(),
                                     F.col("_o"))).drop("_o", "json")
