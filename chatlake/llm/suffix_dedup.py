"""Suffix-array deduplication: remove every byte of a string that repeats.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else, in the same text or another one.

1. Windows.  Every ``length``-byte window has the smallest hash of the strings
   of a quarter of its length in it as its key; equal windows have equal keys.  A
   run of windows with one key is a fragment of text.  A key that occurs in
   one fragment only holds a repeat only if two windows of that fragment are
   equal, that is if the fragment repeats itself with some period; then its
   key stands at the left edge of one window and, further on, at the right
   edge of another.  Such fragments are flagged.  A partial aggregate drops the
   keys of one fragment without a flag.
2. Shards.  Equal fragments collapse to one with a count, so thousands of
   copies are one row.  Fragments are dealt to shards by key, which brings
   equal windows together.  A key with more than ``HOT`` different fragments
   is dealt to several shards.
3. Each shard sorts its windows with a suffix array: Larsson-Sadakane
   refinement in numpy, where groups of equal prefixes of 8 bytes are refined
   to 16, 32, ... bytes with the ranks of what follows, and settled groups rest.
   Kasai's common prefixes of neighbours (an entry follows from the one before
   unless the neighbour changes) tell which windows repeat.
4. Shards that share a key pass on their windows' sorted 128-bit fingerprints
   in ranges; each range is merged pairwise by binary search, and windows found
   in two shards repeat as well.
5. Repeated windows go back to the documents that hold the fragment, as ranges.

Scale: only keys travel for text that doesn't repeat.  Keys and fragments with
very many rows are looked up by broadcasts of bounded size.  Texts are shuffled
twice, to cut their fragments and to remove their spans.  Shards hold about
``SHARD_BYTES``; a merge range holds about ``MERGE`` windows.  Rows are known
by 128 bits of id and text, so repeated rows need no numbering.

Defined results: null text is the empty text; texts shorter than ``length``
stay whole; matches never cross documents; repeated rows are documents of
their own and lose what they share; an empty table gives an empty result.
Other columns are passed on when named in ``keep`` (by ``without_repeats``:
all of them), whatever their names; a kept column with the name of a result
column is refused with an error, as its meaning would be open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import n_groups, spread_join, stored

#: Strings whose hashes key the windows have ``length // GRAM_SHARE`` bytes.
GRAM_SHARE = 4
SHARD_BYTES, HOT, MERGE = 2_000_000, 2_000, 1_000_000
_SLICE = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STIR = np.uint64(0xFF51AFD7ED558CCD)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        both = np.ones((2, n + _SLICE), np.uint64)
        both[0, 1:], both[1, 1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        _POWERS[base] = tuple(np.cumprod(both, axis=1, dtype=np.uint64))
    return _POWERS[base]


def string_hashes(a: np.ndarray, n: int, base: int = _BASES[0]) -> np.ndarray:
    """Hash of the ``n`` bytes from every position of ``a``."""
    power, inverse = _powers(base, len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
    h = (total[n:] - total[:-n]) * inverse[: len(a) - n + 1]
    h ^= h >> np.uint64(31)
    h *= _STIR
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` consecutive entries."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[: -size or None], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def gram_of(length: int) -> int:
    return max(1, length // GRAM_SHARE)


def fragments_of(text: bytes | memoryview, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key, flag) of every fragment of one text.

    ``flag``: two windows of the fragment may be equal.  Equal windows i and
    i + p give the bytes from i to i + p + length the period p, so the key
    stands among the first p strings from i on (left edge of a window) and among
    the last p (right edge of a window), at different places as p < wide.
    """
    gram = gram_of(length)
    wide = length - gram + 1
    a = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, len(a) - length + 1, _SLICE):
        part = a[at:at + _SLICE + length - 1]
        h = string_hashes(part, gram)
        m = sliding_min(h, wide)
        new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        # Long runs (a text that repeats itself) are cut into bounded ones.
        size = np.diff(np.append(new, len(m)))
        pieces = -(-size // wide)
        first = np.repeat(new, pieces) + wide * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.minimum(first + wide, np.repeat(new + size, pieces)) - 1
        left, right = np.flatnonzero(h[: len(m)] == m), np.flatnonzero(h[wide - 1:] == m)
        # The first left edge from ``first`` on, and the last right edge up to ``last``.
        low = np.append(left, len(h))[np.searchsorted(left, first)]
        high = np.append(-1, right)[np.searchsorted(right, last, "right")]
        flag = (low <= last) & (high >= first) & (low < high + wide - 1)
        out.append((first + at, last + at, m[first], flag))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- suffix array of one shard ---------------------------------------------------

def _words(a: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number."""
    padded = np.concatenate([a, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = np.zeros(len(a), np.uint64)
    for i in range(8):
        w = (w << np.uint64(8)) | padded[i:i + len(a)]
    return w


def _regroup(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For sorted rows: the index of the first row of each row's group."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def sort_windows(a: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Positions with ``length`` bytes left, ordered by those bytes, then position.

    ``left``: bytes from each position to the end of its fragment.  Ranks at a
    depth are group numbers of the order by so many bytes; positions whose
    fragment ends before take no part at that depth.
    """
    n = len(a)
    depth = min(8, length)
    key = _words(a)
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    pos = np.flatnonzero(left >= depth)
    order = pos[np.argsort(key[pos], kind="stable")]
    rank = np.zeros(n, np.int64)
    if not len(order):
        return order
    rank[order] = _regroup(order, key[order])
    while depth < length:
        step = min(depth, length - depth)  # the last step overlaps
        group = np.bincount(rank[pos], minlength=n)
        pos = pos[left[pos] >= depth + step]
        open_ = pos[group[rank[pos]] > 1]  # the others are settled
        both = rank[open_] * n + rank[open_ + step]
        at = np.argsort(both, kind="stable")
        open_, both = open_[at], both[at]
        old = rank[open_]
        head = np.concatenate([[True], old[1:] != old[:-1]]) if len(old) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(head, np.arange(len(old)), 0)) if len(old) else old
        after = rank.copy()
        if len(old):
            after[open_] = old + _regroup(open_, both) - start
        rank, depth = after, depth + step
    return pos[np.argsort(rank[pos], kind="stable")]


def common_prefixes(a: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: bytes that each window shares with the one before it in ``order``.

    In text order the neighbour of position p is most often one after the
    neighbour of p - 1; then the prefix is one byte shorter.  All other entries
    are compared, eight bytes at a time.
    """
    n = len(a)
    near = np.full(n + 1, -1, np.int64)
    near[order[1:]] = order[:-1]
    pos = np.sort(order)
    has = pos[near[pos] >= 0]
    out = np.zeros(n + 1, np.int64)
    words = _words(a)

    def compare(p: np.ndarray) -> None:
        q = near[p]
        most = np.minimum(left[p], left[q])
        same = np.zeros(len(p), np.int64)
        todo = np.arange(len(p))
        while len(todo):
            x = words[p[todo] + same[todo]] ^ words[q[todo] + same[todo]]
            equal = np.zeros(len(todo), np.int64)
            for k in range(1, 9):
                equal += x < np.uint64(1 << (64 - 8 * k)) if k < 8 else x == 0
            same[todo] += equal
            todo = todo[(equal == 8) & (same[todo] < most[todo])]
        out[p] = np.minimum(same, most)

    follows = (has > 0) & (near[has - 1] >= 0) & (near[has - 1] + 1 == near[has]) & \
        (left[has - 1] == left[has] + 1) & (left[near[has] - 1] == left[near[has]] + 1)
    compare(has[~follows])
    head = np.maximum.accumulate(np.where(follows, 0, has)) if len(has) else has
    guess = out[head] - (has - head)
    out[has[follows]] = guess[follows]
    compare(has[follows & (guess < 0)])
    return out[order]


def repeated_windows(a: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Mask over positions: a window that starts there starts elsewhere in the shard."""
    order = sort_windows(a, left, length)
    hit = common_prefixes(a, left, order) >= length
    found = np.zeros(len(a), bool)
    found[order[hit]] = True
    found[order[np.flatnonzero(hit) - 1]] = True
    return found


def _layout(frags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(f) for f in frags], np.int64)
    start = np.cumsum(size) - size
    a = np.frombuffer(b"".join(frags), np.uint8)
    owner = np.repeat(np.arange(len(frags)), size)
    return a, start, owner, np.repeat(start + size, size) - np.arange(len(a))


def _intervals(mask: np.ndarray, start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(fragment, first, last) of the maximal runs of marked windows of a fragment."""
    at = np.flatnonzero(mask)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])) \
        if len(at) else np.zeros(0, np.int64)
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
    return owner[first], first - start[owner[first]], last - start[owner[first]]


_MARK = np.dtype([("x", "<u8"), ("y", "<u8"), ("f1", "<i8"), ("f2", "<i8"), ("at", "<i4")])
_FOUND = "f1 long, f2 long, first int, last int, h long, slice int, marks binary"


def _shard(length: int, slices: int):
    """Repeated windows of a shard, and for keys in several shards their fingerprints."""
    def compared(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        a, start, owner, left = _layout([bytes(f) for f in pdf["frag"]])
        f1, f2, hot = pdf["f1"].to_numpy(), pdf["f2"].to_numpy(), pdf["hot"].to_numpy()
        whole = pdf["n"].to_numpy() > 1
        mask = repeated_windows(a, left, length) | (whole[owner] & (left >= length))
        own, first, last = _intervals(mask, start, owner)
        out = [pd.DataFrame({"f1": f1[own], "f2": f2[own], "first": first, "last": last})]
        if hot.any():
            at = np.flatnonzero(hot[owner] & (left >= length))
            keys = np.zeros(len(at), _MARK)
            keys["x"], keys["y"] = (string_hashes(a, length, b)[at] for b in _BASES)
            keys["f1"], keys["f2"], keys["at"] = f1[owner[at]], f2[owner[at]], at - start[owner[at]]
            h, part = pdf["h"].to_numpy()[owner[at]], (keys["x"] >> np.uint64(32)).astype(np.int64) % slices
            # Sorted once; every run of one key and slice is then a sorted list of fingerprints.
            order = np.lexsort((keys["y"], keys["x"], part, h))
            keys, h, part = keys[order], h[order], part[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]))
            runs = [keys[i:j].tobytes() for i, j in zip(new, np.append(new[1:], len(keys)))]
            out.append(pd.DataFrame({"h": h[new], "slice": part[new], "marks": runs}))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "f1", "f2"])
        # A key whose only fragment occurs several times: all of its windows repeat, and nothing is left to compare.
        alone = (~pdf["h"].duplicated(keep=False) & (pdf["n"] > 1) & ~pdf["hot"]).to_numpy()
        copies, pdf = pdf[alone], pdf[~alone]
        out = [pd.DataFrame({"f1": copies["f1"], "f2": copies["f2"], "first": 0, "last": copies["frag"].map(len) - length})]
        if len(pdf):
            out += compared(pdf)
        cols = [c.split()[0] for c in _FOUND.split(", ")]
        # Nullable integers before joining: 64-bit keys don't survive as doubles.
        whole_numbers = {c: "Int64" for c in cols if c != "marks"}
        return pd.concat([o.astype({c: t for c, t in whole_numbers.items() if c in o}).reindex(columns=cols)
                          .astype(whole_numbers) for o in out])
    return run


def _find(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of sorted fingerprints ``y`` in sorted ``x``: places and hits."""
    xs, ys = ((np.stack([v["x"], v["y"]], axis=1).astype(">u8")).view("S16").reshape(-1) for v in (x, y))
    at = np.searchsorted(xs, ys)
    hit = at < len(xs)
    hit[hit] = xs[at[hit]] == ys[hit]
    return at, hit


def merge_shards(runs: list[np.ndarray]) -> list[np.ndarray]:
    """Marks of each shard that another shard has too.

    Neighbours are merged pairwise until one sorted list is left; ``twice``
    remembers what was met on both sides.  Each shard then looks itself up.
    """
    def once(run):
        first = np.concatenate([[True], (run["x"][1:] != run["x"][:-1]) | (run["y"][1:] != run["y"][:-1])])
        return run[["x", "y"]][first], np.zeros(int(first.sum()), bool)

    level = [once(r) for r in runs]
    while len(level) > 1:
        merged = []
        for (x, xt), (y, yt) in zip(level[::2], level[1::2]):
            at, hit = _find(x, y)
            xt[at[hit]] = True
            merged.append((np.insert(x, at[~hit], y[~hit]), np.insert(xt, at[~hit], yt[~hit])))
        level = merged + ([level[-1]] if len(level) % 2 else [])
    every, twice = level[0]
    out = []
    for r in runs:
        at, hit = _find(every, r)
        out.append(r[hit & twice[np.minimum(at, len(every) - 1)]])
    return out


def _merge_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    marks = np.concatenate(merge_shards([np.frombuffer(m, _MARK) for m in pdf["marks"]]))
    marks = np.unique(marks[["f1", "f2", "at"]])
    new = np.flatnonzero(np.concatenate([[True], (marks["f1"][1:] != marks["f1"][:-1]) | (
        marks["f2"][1:] != marks["f2"][:-1]) | (marks["at"][1:] != marks["at"][:-1] + 1)])) if len(marks) else []
    end = np.append(new[1:], len(marks)) - 1 if len(marks) else []
    return pd.DataFrame({"f1": marks["f1"][new], "f2": marks["f2"][new], "first": marks["at"][new],
                         "last": marks["at"][end]}) if len(marks) else pd.DataFrame(
        {"f1": [], "f2": [], "first": [], "last": []}, dtype="int64")


# --- the operator -----------------------------------------------------------------

RESULT = ("doc_id", "kept", "kept_text", "n_bytes", "n_removed", "n_spans")


def _column(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _known(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with their 128-bit key (r1, r2), text bytes and the kept columns as c0, c1, ...

    Only these names are used inside, so no column of ``docs`` can stand for another one.
    """
    text = F.coalesce(_column("text"), F.lit(""))
    return docs.select(*[_column(c).alias(f"c{i}") for i, c in enumerate(keep)],
                       F.xxhash64(_column("doc_id"), text).alias("r1"),
                       F.xxhash64(text, F.lit(1), _column("doc_id")).alias("r2"), text.cast("binary").alias("bytes"))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(r1, r2, spans): window ranges (first, last) of each row that repeat."""
    rows = _known(docs, []).where(F.length("bytes") >= length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [fragments_of(t.as_buffer(), length) for t in part.column(2)]
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                first, last, key, flag = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(key.view(np.int64)),
                     pa.array(flag)],
                    names=["r1", "r2", "first", "last", "h", "flag"])

    runs = stored(rows.mapInArrow(cut, "r1 long, r2 long, first int, last int, h long, flag boolean"), "fragments")
    again = stored(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("flag").alias("flag"))
                   .where("n > 1 or flag").select("h"), "again")
    wanted = (spread_join(runs, again, ["h"]).groupBy("r1", "r2")
              .agg(F.collect_set(F.struct("first", "last", "h")).alias("wanted")))  # within one text

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                row, first, key, frag = [], [], [], []
                for k, (text, list_) in enumerate(zip(part.column(2), part.column(3))):
                    t = text.as_py()
                    for w in list_.as_py():
                        row.append(k)
                        first.append(w["first"])
                        key.append(w["h"])
                        frag.append(t[w["first"]: w["last"] + length])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), part.column(1).take(pa.array(row, pa.int64())),
                     pa.array(first, pa.int32()), pa.array(key, pa.int64()), pa.array(frag, pa.binary())],
                    names=["r1", "r2", "at", "h", "frag"])

    held = rows.join(wanted, ["r1", "r2"]).mapInArrow(take, "r1 long, r2 long, at int, h long, frag binary")
    held = stored(held.withColumns({"f1": F.xxhash64("frag"), "f2": F.xxhash64(F.lit(1), "frag")}), "held")
    # Copies of a fragment collapse within tasks first, then across.
    kinds = stored(held.groupBy("h", "f1", "f2", "frag").agg(F.count(F.lit(1)).alias("n")), "kinds")
    size = kinds.agg(F.sum(F.length("frag"))).first()[0] or 0
    shards, slices = n_groups(size, SHARD_BYTES), 1
    busy = stored(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > HOT), "hotkeys")
    most = busy.agg(F.max("different")).first()[0]
    if most:
        slices = n_groups(most * (length - gram_of(length)) // 2, MERGE)
    dealt = kinds.join(busy, "h", "left")
    parts = F.coalesce(F.ceil(F.col("different") / F.lit(HOT)), F.lit(1))
    # A hot key's fragments go to shards of their own, others share one by key.
    shard = F.when(parts > 1, F.xxhash64("h", F.pmod(F.col("f1"), parts))).otherwise(
        F.pmod(F.xxhash64("h"), F.lit(shards)))
    dealt = dealt.select("h", "f1", "f2", "frag", "n", (parts > 1).alias("hot"), shard.alias("shard"))
    found = stored(dealt.groupBy("shard").applyInPandas(_shard(length, slices), _FOUND), "found")
    marks = (found.where("marks is not null").groupBy("h", "slice")
             .applyInPandas(_merge_frame, "f1 long, f2 long, first int, last int"))
    hits = found.where("marks is null").select("f1", "f2", "first", "last").unionByName(marks)
    return (spread_join(held.select("r1", "r2", "at", "f1", "f2"), stored(hits, "hits"), ["f1", "f2"])
            .groupBy("r1", "r2").agg(F.collect_set(F.struct(
                (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))).alias("spans")))


def removed_runs(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs (from, to) that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"] + length) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(docs: DataFrame, length: int, cols: list[str]) -> DataFrame:
    """``cols`` as c0, c1, ..., then kept, kept_text, n_bytes, n_removed and n_spans of every row."""
    rows = _known(docs, cols)
    spans = stored(repeated_spans(docs, length), "spans")
    own = [f"c{i}" for i in range(len(cols))]
    same = rows.join(spans, ["r1", "r2"], "left_anti").select(
        *own, F.col("bytes").alias("kept"), F.col("bytes").cast("string").alias("kept_text"),
        F.length("bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, gone, n = [], [], [], []
            for text, list_ in zip(b.column(len(own)), b.column(len(own) + 1)):
                t, at, out = text.as_py(), 0, []
                cuts = removed_runs(list_.as_py(), length)
                for x, y in cuts:
                    out.append(t[at:x])
                    at = y
                out.append(t[at:])
                kept.append(b"".join(out))
                size.append(len(t))
                gone.append(sum(y - x for x, y in cuts))
                n.append(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(own)], pa.array(kept, pa.binary()),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                 *(pa.array(x, pa.int64()) for x in (size, gone, n))],
                names=[*own, "kept", "kept_text", "n_bytes", "n_removed", "n_spans"])

    schema = T.StructType([*[T.StructField(o, docs.schema[c].dataType) for o, c in zip(own, cols)],
                           T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])
    cut = rows.join(spans, ["r1", "r2"]).select(*own, "bytes", "spans").mapInArrow(run, schema)
    return same.unionByName(cut)


def remove_repeats(docs: DataFrame, length: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans (+ ``keep``) of every row.

    ``kept_text`` is ``kept`` as text; bytes of characters cut in two are left out.
    """
    clash = [c for c in keep if c.lower() in RESULT[1:]]
    if clash:
        raise ValueError(f"kept columns {clash} have names of result columns: rename them, or use without_repeats")
    cols = list(dict.fromkeys(["doc_id", *keep]))
    cut = _cut(docs, length, cols)
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], *RESULT[1:])


def without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with its own columns, the repeats cut from ``text``; ``n_chars`` (if there) counts what is left."""
    cols = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut, at = _cut(docs, length, cols), {c: F.col(f"c{i}") for i, c in enumerate(cols)}
    at["text"] = F.col("kept_text")
    if "n_chars" in docs.columns:
        at["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[at[c].alias(c) for c in docs.columns])
