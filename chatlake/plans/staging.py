"""Tables staged once in the shared folder and read column by column.

A value that several later steps use is written as Parquet under
``spark.checkpoint.dir``: each step then reads only the columns it needs, the
lineage is cut, and files outlive a lost executor.  ``clean_up`` removes what a
session has staged once nothing reads it any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chatlake.session import checkpoint_dir


def staging_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/chatlake-staged/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> bool:
    """Delete everything staged by this session's application; True if there was something."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
