"""SimHash near-duplicates, candidates pruned by pigeonring chains.

Fingerprint: bit b of the 64 is set when it is set in over half of the XXH64
values of the word shingles.  Two fingerprints link at ``max_bits`` or fewer
differing bits, and the components of those links are the result.

Pigeonring: cut the bits into ``m = max_bits + 1`` segments on a ring.  If two
fingerprints differ in at most ``max_bits`` bits, then from some segment on,
every chain of 1, 2, ..., m consecutive segments holds at most its share
``length * max_bits / m`` of the differences.  So the first segment of the
chain is equal and the first two differ in at most one bit.  The index has a
key for each start segment and each bit of the next segment: the start
segment's value and the next one's without that bit (65 keys of 25 bits for
``max_bits = 4``).  Pairs that share a key are held against the budgets of
all longer chains, the last of which is the full Hamming check.

Scale: copies collapse first, so the links are between distinct fingerprints.
Keys of one fingerprint only are dropped by a partial aggregate and a merge
join, as nothing that grows with the keys may be broadcast.  Keys are dealt to
groups of bounded rows; a key with more than ``BLOCK`` fingerprints
is split into blocks, and each pair of blocks is a group of its own.  A task
compares its pairs in numpy and returns a spanning forest (at most one row a
fingerprint), never the pairs.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; texts are read whole;
repeated rows get the same component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LOWER, n_groups, shuffle_partitions, stored
from chatlake.llm.graph import connected_components

#: Fingerprints of one key compared in one task; larger keys go in blocks.
BLOCK = 512
#: Key rows a group holds.
GROUP_ROWS = 200_000
#: Keys a task makes and counts; nearly all are different, so the counts need memory for each.
KEY_ROWS = 400_000
#: Texts a task holds as Python objects at once.
TEXTS = 500


def simhash(text: bytes | None, words: int, seed: int = 42) -> int:
    """64-bit SimHash of one text (UTF-8), as an unsigned number."""
    import xxhash

    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(tokens) - words + 1].tolist(), ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), "<u8", len(starts))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, row, fp): the signed 64-bit form of every row's fingerprint.

    ``row`` is a hash of the text, which tells rows of one doc_id apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                fp = np.array([simhash(t, words) for t in part.column(2).cast(pa.large_binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))],
                                                 names=["doc_id", "row", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(
        run, f"doc_id {ids}, row long, fp long")


class Ring:
    """Segments of the 64 bits on a ring, and the budgets of their chains."""

    def __init__(self, max_bits: int):
        self.m = max_bits + 1
        at = [round(64 * k / self.m) for k in range(self.m + 1)]
        self.first, self.width = at[:-1], [b - a for a, b in zip(at, at[1:])]
        seg = [((1 << w) - 1) << a for a, w in zip(self.first, self.width)]
        #: mask[i, k]: the k + 1 segments from segment i on.
        self.mask = np.zeros((self.m, self.m), np.uint64)
        for i in range(self.m):
            for k in range(self.m):
                self.mask[i, k] = sum(seg[(i + j) % self.m] for j in range(k + 1))
        self.budget = [(k + 1) * max_bits // self.m for k in range(self.m)]

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """Keys of each fingerprint, one row each; the start segment is in the top bits."""
        out = []
        for i in range(self.m):
            here = (fp >> np.uint64(self.first[i])) & np.uint64((1 << self.width[i]) - 1)
            j = (i + 1) % self.m
            after = (fp >> np.uint64(self.first[j])) & np.uint64((1 << self.width[j]) - 1)
            for bit in range(self.width[j] if self.m > 1 else 1):
                # All ones but the left-out bit; with one segment there is no next one.
                rest = after & ~np.uint64(1 << bit) if self.m > 1 else np.uint64(0)
                tag = np.uint64((i << 58) | (bit << 52))
                out.append(tag ^ (here << np.uint64(26)) ^ rest)
        return np.stack(out, axis=1)

    def start(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(58)).astype(np.int64)

    def near(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which differences ``x`` keep to the budget of every chain from ``start``."""
        ok = np.ones(len(x), bool)
        for k in range(1, self.m + 1):
            ok[ok] = np.bitwise_count(x[ok] & self.mask[start[ok], k - 1]) <= self.budget[k - 1]
        return ok


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b): every node ends at the smallest of its set."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def forest(cell: np.ndarray, start: np.ndarray, fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its set) among fingerprints of equal cells."""
    order = np.argsort(cell, kind="stable")
    cell, start, fp = cell[order], start[order], fp[order]
    known, node = np.unique(fp, return_inverse=True)
    parent = np.arange(len(known))
    at, off = np.arange(len(cell)), 0
    while len(at):
        off += 1
        at = at[at + off < len(cell)]
        at = at[cell[at] == cell[at + off]]
        pair = at[parent[node[at]] != parent[node[at + off]]]
        pair = pair[ring.near(fp[pair] ^ fp[pair + off], start[pair])]
        parent = _join_up(parent, node[pair], node[pair + off])
    moved = np.flatnonzero(parent != np.arange(len(known)))
    return known[moved], known[parent[moved]]


def ring_keys(fps: DataFrame, ring: Ring) -> DataFrame:
    """Distinct fingerprints (fp) -> (key, fp), dealt to tasks of about ``KEY_ROWS`` keys.

    A fingerprint has so many keys that the few files of ``fps`` would make tasks too large to count them.
    """
    each = ring.keys(np.zeros(1, np.uint64)).shape[1]
    tasks = n_groups(fps.count() * each, KEY_ROWS, shuffle_partitions(fps.sparkSession))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 5000):
                fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)[part:part + 5000]).view(np.uint64)
                k = ring.keys(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, k.shape[1]).view(np.int64))],
                    names=["key", "fp"])

    return fps.select("fp").repartition(tasks, "fp").mapInArrow(keyed, "key long, fp long")


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that span every component."""
    ring = Ring(max_bits)
    keys = ring_keys(fps, ring)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes the keys like the fingerprints they are made of and would broadcast either side.
    rows = keys.join(shared.hint("merge"), "key")
    # A large key: the fingerprint's block meets every block, one cell a pair of blocks.
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = stored(rows.select("key", "fp", cell.alias("cell")), "simkeys")
    groups = n_groups(rows.count(), GROUP_ROWS, shuffle_partitions(fps.sparkSession))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy(np.int64).view(np.uint64)
        a, b = forest(pdf["cell"].to_numpy(), ring.start(key), pdf["fp"].to_numpy(np.int64).view(np.uint64), ring)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (rows.groupBy(F.pmod("cell", F.lit(groups)).alias("g"))
            .applyInPandas(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, row, fp, root, component_id): smallest doc_id reachable over links.

    ``root`` is the component's smallest fingerprint.
    """
    own = stored(fingerprints(docs, words), "simhash")
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simfps")
    roots = connected_components(links(fps, max_bits))
    grouped = stored(fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
                     .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simroots")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = grouped.join(least, "root").select("fp", "root", "component_id")
    return own.join(ids, "fp").select("doc_id", "row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents, one row of every component: its smallest doc_id."""
    found = near_duplicates(docs, words, max_bits).groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row", "n")).alias("x"))
    first = stored(first.groupBy(F.col("x.doc_id").alias("__d"), F.col("x.row").alias("__r"))
                   .agg(F.sum("x.n").alias("__n")), "simkept")
    rows = docs.withColumn("__row", F.xxhash64("text"))

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, rows["doc_id"].eqNullSafe(some["__d"]) & (rows["__row"] == some["__r"]), "left_semi")

    kept = of(first.where("__n = 1"))
    # Rows that are the same in id and text are copies of each other; only their texts are shuffled once more.
    if first.agg(F.max("__n") > 1).first()[0]:
        kept = kept.unionByName(of(first.where("__n > 1")).dropDuplicates(["doc_id", "__row"]))
    return kept.select(*docs.columns)
