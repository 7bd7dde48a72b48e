"""Helpers shared by the operators: scratch tables, text constants, tokens."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import ensure_checkpoint_dir

#: White space as the contracts define it: blank, tab, LF, VT, FF, CR.
WS = "\\x20\\x09-\\x0D"
WORD = f"[^{WS}]+"

#: The same six characters, and the byte table that lower-cases A-Z only.
#: ``bytes.split()`` without an argument splits on exactly these six bytes.
WS_CHARS = " \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage with files that outlive any executor; later steps read
    only the columns they use.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_groups(rows: int, per_group: int, at_least: int = 1) -> int:
    """How many groups keep ``rows`` rows at about ``per_group`` a group."""
    return max(at_least, math.ceil(rows / per_group))


#: Rows of a key that make it a hub, and most hubs of a join.
HUB_ROWS, HUBS = 2_000, 5_000


def spread_join(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``side``, which has few rows a key, whatever the number of rows of a key.

    Keys with very many rows would meet in one task; their part of ``side`` is
    broadcast instead.  There are at most ``HUBS`` such keys, as each has at
    least that part of all rows.  Keys are never null.
    """
    many = max(HUB_ROWS, rows.count() // HUBS)
    hubs = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > many).select(*on)
    told = rows.join(F.broadcast(side.join(hubs, on, "left_semi")), on)
    return told.unionByName(rows.join(F.broadcast(hubs), on, "left_anti").join(side, on))


def crc32_of_id(col) -> F.Column:
    """crc32 of a document id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def utf8_bytes(col) -> F.Column:
    """Length of the UTF-8 form, 0 for null."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def word_count(col) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")
