"""Mixing: targets against repeated sharing, samples against their targets."""

import pytest

from chatlake.llm import mixing


def shared_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            target.update({s: level * w[s] for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_samples(docs_of):
    docs = [(i, "w " * (1 + i * 7 % 23), None, f"s{i % 7}") for i in range(400)]
    docs += [(1000 + i, "v " * 3, None, None) for i in range(10)]
    docs += [(2000, None, None, "s1"), (2001, "", None, "s2"), (2002, " \t\n", None, "s3")]
    docs += [(3000, "same words here", None, "tiny")] * 3
    rows = mixing.mix_sources(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = shared_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 23


def test_reruns_agree_and_copies(docs_of):
    docs = docs_of([(i, "w " * (1 + i % 5), None, f"s{i % 4}") for i in range(100)] + [(7, "w w w ", None, "s3")] * 2)
    first = sorted(map(tuple, mixing.mix_sources(docs).select("doc_id", "copies").collect()))
    assert first == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).select("doc_id", "copies").collect()))
    out = mixing.repeat_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(c for _, c in first)


def test_certain_copies_when_capped(docs_of):
    rows = mixing.mix_sources(docs_of([(1, "a b", None, "a"), (2, "c " * 98, None, "b"), (3, "d", None, "c")])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["taken"] == 6 and by[1]["target"] == 6.0


def test_empty(docs_of):
    assert mixing.mix_sources(docs_of([])).collect() == []
    assert mixing.mix_sources(docs_of([(1, None, None, None)])).first()["taken"] == 0


def test_uniform_is_spread(spark):
    u = [r[0] for r in spark.range(2000).select(mixing.uniform("id", seed=3)).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03


def test_inclusion_is_in_proportion_to_size(docs_of):
    """Of many documents of two sizes, the larger are taken as much more often as they are larger; the largest always."""
    docs = [(i, "w " * (2 if i % 2 else 8), None, "a") for i in range(6000)] + [(9000, "x " * 4000, None, "a")]
    docs += [(20_000 + i, "y " * 50, None, "b") for i in range(400)]
    rows = mixing.mix_sources(docs_of(docs)).collect()
    a = [r for r in rows if r["source"] == "a"]
    base = min(r["copies"] for r in a)
    extra = {n: [r["copies"] - base for r in a if r["size"] == n] for n in (2, 8, 4000)}
    assert extra[4000] == [1]
    rest = a[0]["target"] - base * a[0]["source_size"] - 4000
    rate = rest / (3000 * 4 + 3000 * 64)
    for n in (2, 8):
        assert abs(sum(extra[n]) / 3000 - rate * n) < 0.03
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 4


def test_a_document_larger_than_the_rest_is_in_nobodys_way(docs_of):
    docs = [(i, "w " * 5, None, "a") for i in range(50)] + [(99, "x " * 900, None, "a"), (500, "y " * 860, None, "b")]
    rows = [r for r in mixing.mix_sources(docs_of(docs)).collect() if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 450
