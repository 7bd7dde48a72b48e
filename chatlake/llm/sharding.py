"""Sharding by the minimax contiguous partition of ordered atomic groups.

Documents with equal texts form a group that is never split.  Groups, in
order of their smallest document id, are cut into contiguous shards whose
largest shard is as small as possible: the smallest feasible capacity is
found by binary search, and each candidate capacity is checked greedily by
filling shard after shard to the last group end within the capacity.

Scale: sizes and running sums are DataFrames (a range sort of narrow rows, so
a hot group spans tasks).  The greedy check needs only the last group end
below a position.  The driver holds a summary of the group ends: cells with
smallest end, largest end and count, at most ``CELLS`` at first.  Whenever a
check falls inside a cell, that cell alone is read again at higher resolution,
``ZOOM`` cells at a time, so the search is exact and what the driver holds
depends on the number of shards and not on the data.

With the capacity known, cuts aim at an equal share of what is left, kept
between the earliest cut from which the rest still fits and the latest cut
within the capacity; the largest shard is minimal either way.

Defined results: null text has size 1, a null crc32 and forms a group with
other null texts; empty texts likewise with crc32 0; repeated rows are rows;
with fewer groups than shards the last shards are empty; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import stored, utf8_bytes
from chatlake.plans.numbering import with_row_index

#: Cells of the first summary, and of each cell that is read again.
CELLS = 4096
ZOOM = 256


class _Ends:
    """Group ends known to the driver, as cells (first, last, count)."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        # 0 and the total are ends; every other end lies in one cell.
        self.cells = self._summary([(0, total, CELLS)])
        self.cells.append((0, 0, 1))
        self.cells.sort()
        self.starts = [c[0] for c in self.cells]

    def _summary(self, ranges) -> list[tuple[int, int, int]]:
        """Cells of the ends in each (first, last) range, at the given resolution."""
        e, no, keep = F.col("end"), None, None
        for k, (a, b, cells) in enumerate(ranges):
            width = max(1, -(-(b - a + 1) // cells))
            inside = (e >= a) & (e <= b)
            cell = F.struct(F.lit(k).alias("range"), F.floor((e - F.lit(a)) / F.lit(width)).cast("long").alias("cell"))
            no = F.when(inside, cell) if no is None else no.when(inside, cell)
            keep = inside if keep is None else keep | inside
        rows = (self.ends.where(keep).groupBy(no.alias("no"))
                .agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")))
        return [(r["a"], r["b"], r["n"]) for r in rows.collect()]  # at most one row a cell

    def refine(self, cells: set) -> None:
        fresh = self._summary([(a, b, ZOOM) for a, b, _ in sorted(cells)])
        self.cells = sorted([c for c in self.cells if c not in cells] + fresh)
        self.starts = [c[0] for c in self.cells]

    def last(self, t: int):
        """(least, most, cell): bounds of the last end <= t; cell: read it again to know more."""
        first, end, n = cell = self.cells[bisect_right(self.starts, t) - 1]
        if t >= end:
            return end, end, None
        return (first, first, None) if n <= 2 else (first, t, cell)

    def next(self, t: int):
        """(end, cell): the first end >= t, or the cell to read again."""
        k = bisect_right(self.starts, t - 1)
        first, end, n = cell = self.cells[k - 1]
        if t > end:
            return self.cells[k][0], None
        if t <= first:
            return first, None
        return (end, None) if n <= 2 else (None, cell)

    def last_exact(self, t: int) -> int:
        while (found := self.last(t))[2]:
            self.refine({found[2]})
        return found[0]

    def next_exact(self, t: int) -> int:
        while (found := self.next(t))[1]:
            self.refine({found[1]})
        return found[0]


def _fits(ends: _Ends, capacity: int, shards: int) -> bool:
    """Greedy check: do ``shards`` shards of this capacity hold everything?"""
    while True:
        low = high = 0
        unsure = set()
        for _ in range(shards):
            low, _, cell = ends.last(low + capacity)
            unsure.add(cell)
            _, high, cell = ends.last(high + capacity)
            unsure.add(cell)
        if low >= ends.total:
            return True
        if high < ends.total:
            return False
        ends.refine(unsure - {None})


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the ``shards - 1`` cut positions (in bytes).

    ``groups``: rows with ``start`` (sum of sizes before) and ``size`` > 0.
    """
    head = groups.agg(F.sum("size").alias("total"), F.max("size").alias("most")).first()
    total = head["total"] or 0
    if not total:
        return 0, [0] * (shards - 1)
    ends = _Ends(groups.select((F.col("start") + F.col("size")).alias("end")), total)
    low = max(head["most"], -(-total // shards))
    high = -(-total // shards) + head["most"]  # greedy fills more than total / shards each
    while low < high:
        mid = (low + high) // 2
        if _fits(ends, mid, shards):
            high = mid
        else:
            low = mid + 1
    capacity = low
    need = [total]  # need[k]: earliest cut from which k shards hold the rest
    for _ in range(shards - 1):
        need.append(ends.next_exact(max(0, need[-1] - capacity)))
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        if at >= total:
            cuts.append(total)
            continue
        share = ends.last_exact(at + -(-(total - at) // left))
        at = min(max(share, need[left - 1], ends.next_exact(at + 1)), ends.last_exact(at + capacity))
        cuts.append(at)
    return capacity, cuts


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key."""
    data = F.col("text").cast("binary")
    rows = stored(docs.select(
        "doc_id", (utf8_bytes("text") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
        F.coalesce(F.sha2(data, 256), F.lit("null")).alias("group_key")), "shardrows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("size"), F.min("doc_id").alias("first_id"))
    groups = stored(with_row_index(groups, ["first_id", "group_key"], name="group_no",
                                   sums={"start": "size"}), "shardgroups")
    _, cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("start") >= F.lit(c)).cast("int")
    placed = rows.join(groups.select("group_key", "group_no", shard.alias("shard")), "group_key")
    placed = with_row_index(placed, ["group_no", "doc_id"], name="row_no")
    placed = stored(placed, "shardplaced")
    first = placed.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("row_no") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "group_key")
