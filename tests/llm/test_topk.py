"""Exact top-k against all scores."""

import math

import numpy as np
import pytest

from chatlake.llm import topk


def brute(rows, k=20, step=20):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in ok if i % step == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, rank string")


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (20, [0.5, -0.25]), (40, None), (60, [nan, 1.0]), (1, [0.5, None]), (2, [inf, 0.0]),
            (3, []), (4, [1.0]), (5, [1.0, 1.0, 1.0]), (6, [-1.0, -0.001]), (None, [1.0, 1.0]), (80, [])]
    got = sorted(map(tuple, topk.top_k(frame(spark, rows)).collect()))
    assert got == brute(rows)
    assert topk.top_k(frame(spark, [])).collect() == []
    assert topk.top_k(frame(spark, [(0, [1.0])])).collect() == []


@pytest.mark.parametrize("cand,quer", [(16_384, 16_384), (37, 5)])
def test_random_ties_and_copies(spark, monkeypatch, cand, quer):
    monkeypatch.setattr(topk, "CANDIDATES", cand)
    monkeypatch.setattr(topk, "QUERIES", quer)
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-3, 4, 16) / 64).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    got = sorted(map(tuple, topk.top_k(frame(spark, rows)).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("cand,quer", [(16_384, 16_384), (37, 2)])
def test_ids_with_several_vectors_have_one_result(spark, monkeypatch, cand, quer):
    monkeypatch.setattr(topk, "CANDIDATES", cand)
    monkeypatch.setattr(topk, "QUERIES", quer)
    rng = np.random.default_rng(5)
    rows = [(i % 90, [int(x) for x in rng.integers(-3, 4, 16)]) for i in range(200)]
    rows += rows[:25]  # repeated rows
    want = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        mine = [v for i, v in rows if i == q]
        best = sorted((-max(sum(x * y for x, y in zip(a, b)) for a in mine), i) for i, b in rows if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = sorted(map(tuple, topk.top_k(frame(spark, [(i, [x / 64 for x in v]) for i, v in rows])).collect()))
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(20, 30)), rng.normal(size=(50, 30)) + 1
    for level in topk.LEVELS:
        bound = topk.segment_features(q, level) @ topk.segment_features(c, level).T
        assert (bound >= q @ c.T - 1e-9).all()


def test_whole_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    assert sorted(map(tuple, topk.top_k(v).collect())) == brute(rows)


def test_scores_beyond_doubles(spark):
    """Components whose products doubles round: exact 64-bit scores, ties to the smaller id; beyond 64 bits an error."""
    rng = np.random.default_rng(3)
    # whole numbers up to 2**28 after the scale, whose products differ in bits that doubles don't have
    big = [[float(2 * x + 1) / 64 for x in v] for v in rng.integers(-2 ** 27, 2 ** 27, (40, 6))]
    rows = [(i, v) for i, v in enumerate(big)] + [(100 + i, v) for i, v in enumerate(big[:5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, query_step=20).collect()
    want = []
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:7], 1)]
    assert sorted(map(tuple, got)) == sorted(want) and max(abs(w[3]) for w in want) > 2 ** 53
    huge = spark.createDataFrame([(0, [3e18]), (1, [3e18])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(huge)


def test_pruning_on_clusters():
    """On clustered vectors most pairs go at the coarse levels; the result is that of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64)) * 40 * (0.8 ** np.arange(64))
    base = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = np.floor((centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 64))) @ base * 8)
    ids, seen = np.arange(4000), []
    q = np.flatnonzero(ids % 20 == 0)
    turn = topk.energy_order(x[:1000])
    i, j, s = topk.best_of_block(x[q], ids[q], x, ids, 20, turn, survivors=seen)
    full = x[q] @ x.T
    full[np.arange(len(q)), q] = -np.inf
    for r in range(len(q)):
        order = np.lexsort((ids, -full[r]))[:20]
        assert j[i == r].tolist() == order.tolist() and s[i == r].tolist() == full[r][order].astype(int).tolist()
    shares = [n / all_ for _, n, all_ in seen]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.1


@pytest.mark.parametrize("width", [1, 2, 3, 7, 64, 100])
def test_bounds_hold_at_every_level(width):
    rng = np.random.default_rng(width)
    q, c = rng.normal(size=(20, width)), rng.normal(size=(30, width))
    before = None
    for level in topk.LEVELS:
        e = topk.edges_of(width, level)
        assert e[0] == 0 and e[-1] == width and e == sorted(set(e))
        bound = topk.segment_features(q, level) @ topk.segment_features(c, level).T
        assert (bound >= q @ c.T - 1e-9).all() and (before is None or (bound <= before + 1e-9).all())
        before = bound
