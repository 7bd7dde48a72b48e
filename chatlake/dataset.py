"""The dataset: named tables of one archive, full or text-free export.

A full dataset has ``messages``; an export dataset does not and carries the
per-conversation measures in ``conversations`` instead.  Optional tables
(summaries, embeddings) may be missing; operators then return an empty
DataFrame of the right schema, as the reference returns empty results.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chatlake import schemas
from chatlake.plans.publish import Folder, bucket_count, recover


@dataclass
class ChatData:
    spark: SparkSession
    conversations: DataFrame
    messages: DataFrame | None = None
    insights: DataFrame | None = None
    summaries: DataFrame | None = None
    embeddings: DataFrame | None = None
    daily_stats: DataFrame | None = None
    tags: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @property
    def is_export(self) -> bool:
        return self.messages is None

    def table(self, name: str) -> DataFrame:
        """A table by name; an empty frame of the stored schema when missing."""
        df = getattr(self, name, None)
        if df is not None:
            return df
        schema = {
            "insights": schemas.EXPORT_INSIGHTS if self.is_export else schemas.INSIGHTS,
            "summaries": schemas.SUMMARIES,
            "embeddings": schemas.EMBEDDINGS,
            "daily_stats": schemas.DAILY_STATS,
            "tags": schemas.EXPORT_TAGS,
            "messages": schemas.MESSAGES,
        }[name]
        return self.spark.createDataFrame([], schema)

    def has(self, name: str) -> bool:
        return getattr(self, name, None) is not None

    # -- storage -----------------------------------------------------------------
    TABLES = ("conversations", "messages", "insights", "summaries", "embeddings",
              "daily_stats", "tags")

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> "ChatData":
        """Open a stored archive: one Parquet folder per table under ``root``.

        A folder that does not exist is an absent table (export datasets have
        no messages; summaries and embeddings are optional).
        """
        recover(spark, root)
        found = {name: read_table(spark, root, name) for name in cls.TABLES}
        return cls(spark=spark, **{k: v for k, v in found.items() if v is not None})

    def write(self, root: str, mode: str = "overwrite") -> list[str]:
        """Write every present table under ``root``; returns the names written."""
        written = []
        for name in self.TABLES:
            df = getattr(self, name, None)
            if df is None:
                continue
            df.write.mode(mode).parquet(os.path.join(root, name))
            written.append(name)
        return written


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A stored table without its bucket column; None where there is no folder."""
    path = os.path.join(root, name)
    if not Folder(spark, path).exists(path):
        return None
    df = spark.read.parquet(path)
    n = bucket_count(spark, path)
    return df.drop(f"bucket{n}") if n else df
