"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings the operators assume.  AQE re-plans joins at run time from
# measured shuffle sizes (runtime broadcast only below the threshold,
# skewed partitions split), and UTC keeps dates stable across hosts.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "chatlake", extra: dict | None = None) -> SparkSession:
    """A session with ``BASE_CONF``.

    Master and shuffle partitions are those of the launcher (spark-submit,
    spark-defaults) unless given here; without either the master is local.
    """
    builder = SparkSession.builder.appName(app_name)
    if master or not SparkConf().contains("spark.master"):
        builder = builder.master(master or "local[*]")
    conf = dict(BASE_CONF)
    # spark.checkpoint.dir is not set here: a cluster names its shared folder;
    # ensure_checkpoint_dir makes a scratch one only in local mode.
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local["):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is only read.
    In local mode, where it may be unset, a scratch folder is made.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chatlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)
