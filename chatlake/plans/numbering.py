"""Dense, ordered surrogate keys and running sums without a single-task window.

``with_row_index`` is the DataFrame form of zipWithIndex: sort with a
range-partitioned ``orderBy`` (distributed; a hot group spans several range
partitions), tag rows with ``monotonically_increasing_id`` (partition index
in the high bits, position in the low bits, both increasing in sort order),
checkpoint so the tags are stable under recomputation, reduce every
(partition, group) block to one row of counts and sums, give those blocks
running offsets, and add them back.

The block table has at most ``partitions + groups`` rows (rows are sorted by
group first, so a partition holds one contiguous run of groups).  Without
groups that is one row per partition, a bound known before the join, so it
is broadcast; with groups the join is left to AQE, which broadcasts it at run
time only when its measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def with_row_index(df: DataFrame, order_cols: list, name: str = "idx", start: int = 0,
                   sums: dict[str, str] | None = None,
                   partition_by: list[str] | None = None) -> DataFrame:
    """Add ``name`` = start + position of the row in ``order_cols`` order.

    ``partition_by``: positions (and sums) restart in every group.
    ``sums``: ``{out: col}`` adds ``out`` = sum of ``col`` over all earlier
    rows of the same group (exclusive running sum), in the same order.
    """
    groups = list(partition_by or [])
    sums = dict(sums or {})
    tagged = (df.orderBy(*groups, *order_cols)
              .withColumn("__ri_mid", F.monotonically_increasing_id())
              .withColumn("__ri_p", F.shiftright("__ri_mid", 33))
              .checkpoint(eager=True))
    aggs = [F.count(F.lit(1)).alias("__ri_n"), F.min("__ri_mid").alias("__ri_first")]
    aggs += [F.sum(c).alias(f"__ri_s_{o}") for o, c in sums.items()]
    blocks = tagged.groupBy("__ri_p", *groups).agg(*aggs)
    w = Window.partitionBy(*groups).orderBy("__ri_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("__ri_n").over(w), F.lit(0)).alias("__ri_off")]
    offs += [F.coalesce(F.sum(f"__ri_s_{o}").over(w), F.lit(0)).alias(f"__ri_so_{o}") for o in sums]
    offsets = blocks.select("__ri_p", *groups, "__ri_first", *offs)
    if not groups:
        offsets = F.broadcast(offsets)
    joined = tagged.join(offsets, ["__ri_p", *groups])
    out = joined.withColumn(
        name, (F.lit(start) + F.col("__ri_off") + F.col("__ri_mid") - F.col("__ri_first")).cast("long"))
    if sums:
        # Running sums inside one block: rows of one sort partition only.
        wp = (Window.partitionBy("__ri_p", *groups).orderBy("__ri_mid")
              .rowsBetween(Window.unboundedPreceding, -1))
        for o, c in sums.items():
            out = out.withColumn(o, (F.col(f"__ri_so_{o}") + F.coalesce(F.sum(c).over(wp), F.lit(0)))
                                 .cast("long"))
    drop = ["__ri_mid", "__ri_p", "__ri_off", "__ri_first"] + [f"__ri_so_{o}" for o in sums] + \
        [f"__ri_s_{o}" for o in sums]
    return out.drop(*drop)
