"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; a segment of ``s`` components is summed up by
its mean and standard deviation.  Over one segment the inner product of two
vectors is at most ``s * (mean * mean + dev * dev)`` (Cauchy-Schwarz on the
centred parts; the squared distance has the matching lower bound).  Vectors are
turned first by an orthogonal matrix that orders the directions by their energy
(fitted on at most ``FIT`` vectors; any orthogonal matrix gives right results),
and segments double in width, so few of them hold most of an inner product.
Bounds are computed coarse to fine (every segment cut into 1, 4, 16).  A query's
threshold is its k-th best exact score among the candidates with the largest
coarse bounds; candidates whose bound is below it are dropped, the survivors
get exact scores: pair by pair where few are left, else as a block.  A bound
that equals the threshold survives, so ties are exact.

Scale: candidates are dealt to groups of ``CANDIDATES`` rows and queries to
groups of ``QUERIES`` rows by hash; every pair of groups meets once, in numpy
blocks, and returns at most k rows a query; a window with a rank limit keeps
the k best.  No task holds more than one group of each.

Defined results: vectors that are null or hold a null or non-finite component
take no part; an empty vector scores 0 with all; vectors of different widths
are compared as if the shorter one ended in zeros; a query's own row is every
row of its vec_id; rows with a null vec_id take no part; repeated rows each
take a place as candidates; a query id with several vectors has one result, in
which every candidate row stands once with its best score over them; ties go to
the smaller vec_id; fewer than k candidates give as many rows as there are; an
empty table gives an empty result.  Scores that doubles cannot hold exactly
(over 2**53, by width and largest component) are computed in 64-bit integers;
if they could exceed 64 bits, the operator raises an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import n_groups, stored

#: Rows of a candidate group and of a query group, and queries of one block.
CANDIDATES, QUERIES, BLOCK = 16_384, 16_384, 256
LEVELS = (1, 4, 16)
#: Vectors that the turn is fitted on, and the share of pairs below which survivors are scored pair by pair.
FIT, FEW = 10_000, 0.02


def edges_of(width: int, level: int) -> list[int]:
    """Segment borders: 0, 1, 2, 4, 8, ..., each stretch cut into up to ``level`` parts."""
    octaves = [0, *(1 << i for i in range(width.bit_length()) if 1 << i < width), width]
    cuts = {0, width}
    for a, b in zip(octaves, octaves[1:]):
        cuts.update(np.linspace(a, b, min(level, b - a) + 1).round().astype(int).tolist())
    return sorted(cuts)


def energy_order(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are directions of falling energy."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(sample.shape[1])


def segment_features(x: np.ndarray, level: int) -> np.ndarray:
    """Rows whose inner products are the upper bounds: sqrt(s) * (mean, dev) a segment."""
    edges = edges_of(x.shape[1], level)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part, root = x[:, a:b], np.sqrt(b - a)
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def best_of_block(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int,
                  turn: np.ndarray | None = None, exact=None, survivors: list | None = None):
    """(query row, candidate row, score): the k best candidates of every query.

    ``c`` is ordered by id, so equal scores keep the smaller ids first.
    ``exact``: both sides as 64-bit integers where doubles are not exact.
    ``survivors`` collects the share of pairs left after every level.
    """
    rows = np.arange(len(q))
    own = q_id[:, None] == c_id[None, :]
    qt, ct = (q, c) if turn is None else (q @ turn, c @ turn)
    # Room for rounding: doubles keep 15 digits of the largest product of two lengths.
    room = 1e-6 + 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    bound = segment_features(qt, LEVELS[0]) @ segment_features(ct, LEVELS[0]).T
    bound[own] = -np.inf
    # Exact scores of the most promising candidates give the first thresholds.
    n = min(len(c), 4 * k)
    first = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    tried = np.einsum("qd,qnd->qn", q, c[first])
    tried[own[rows[:, None], first]] = -np.inf
    least = np.sort(tried, axis=1)[:, -k] if n >= k else np.full(len(q), -np.inf)
    alive, cols = ~own, np.arange(len(c))
    for level in LEVELS:
        if level != LEVELS[0]:
            bound = segment_features(qt, level) @ segment_features(ct[cols], level).T
        alive &= bound >= (least - room)[:, None]
        some = alive.any(axis=0)
        alive, cols = alive[:, some], cols[some]
        if survivors is not None:
            survivors.append((level, int(alive.sum()), len(q) * len(c)))
    left, right = exact or (q, c)
    if exact is None and alive.sum() > FEW * len(q) * len(c):
        score = np.where(alive, q @ c[cols].T, -np.inf)
        pick = [np.flatnonzero(a) for a in alive]
        scores = [score[i, p] for i, p in enumerate(pick)]
    else:
        pick = [np.flatnonzero(a) for a in alive]
        scores = [right[cols[p]] @ left[i] for i, p in enumerate(pick)]
    out_q, out_c, out_s = [], [], []
    for i, (p, x) in enumerate(zip(pick, scores)):
        top = np.argsort(-x, kind="stable")[:k]
        out_q.append(np.full(len(top), i))
        out_c.append(cols[p[top]])
        out_s.append(x[top].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers as one array, zeros after their ends."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector, as doubles."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return (vectors.where("vec_id is not null and embedding is not null")
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(~bad)
            .select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v")))


def top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id ``query_step`` divides."""
    rows = stored(quantised(vectors, scale), "vectors")
    most, wide = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    most, wide = int(most or 0), int(wide or 0)
    if most * most * wide >= 1 << 63:
        raise ValueError(f"scores of {wide} components up to {most} may not fit in 64 bits")
    whole = most * most * wide >= 1 << 53
    # A bounded sample, the same at every run; only the speed depends on it.
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(FIT).select("v").toPandas()["v"]
    turn = energy_order(_matrix(sample, max(1, wide))) if wide else np.eye(1)
    asked = rows.where(F.col("vec_id") % query_step == 0)
    c_groups, q_groups = n_groups(rows.count(), CANDIDATES), n_groups(asked.count(), QUERIES)

    def everywhere(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_groups)).cast("int")
    c = rows.select("vec_id", "v", group.alias("c")).withColumn("q", everywhere(q_groups))
    # All vectors of an id are in one group, where their candidates are merged.
    q = asked.dropDuplicates(["vec_id", "v"]).select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(q_groups)).cast("int").alias("q"))
    q = q.withColumn("c", everywhere(c_groups))

    def meet(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and len(cs):
            cs = cs.sort_values("vec_id", kind="stable")
            width = max(1, wide)
            cm, c_id = _matrix(cs["v"], width), cs["vec_id"].to_numpy()
            qm, q_id = _matrix(qs["v"], width), qs["vec_id"].to_numpy()
            for a in range(0, len(qm), BLOCK):
                part = qm[a:a + BLOCK]
                exact = (part.astype(np.int64), cm.astype(np.int64)) if whole else None
                i, j, s = best_of_block(part, q_id[a:a + BLOCK], cm, c_id, k, turn, exact)
                found.append(pd.DataFrame({"query_id": q_id[a:a + BLOCK][i], "vec_id": c_id[j], "score": s, "row": j}))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        out = pd.concat(found)
        if qs["vec_id"].duplicated().any():
            out = out.sort_values("score", ascending=False, kind="stable").drop_duplicates(["query_id", "row"])
        return out.drop(columns="row")

    pairs = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
