"""Sharding against dynamic programming over group sizes."""

import zlib
from collections import defaultdict

import pytest

from chatlake.llm import sharding


def best_capacity(sizes, shards):
    """Least possible largest contiguous shard, by dynamic programming."""
    before = [0]
    for s in sizes:
        before.append(before[-1] + s)
    best = before[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], before[i] - before[j]) for j in range(i + 1)) for i in range(len(before))]
    return best[-1]


def check(rows, docs, shards):
    texts = {}
    size = lambda t: len((t or "").encode()) + 1
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append((i, size(t)))
    order = sorted(groups, key=lambda t: min(i for i, _ in groups[t]))
    sizes = [sum(s for _, s in groups[t]) for t in order]
    load, where, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        where[r["group_key"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        texts[r["doc_id"]] = r
    assert len(rows) == len(docs)
    assert all(len(x) == 1 for x in where.values())
    assert all(0 <= s < shards for s in load)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) == best_capacity(sizes, shards)
    # contiguous in group order
    seen = [next(r["shard"] for r in rows if r["doc_id"] == min(i for i, _ in groups[t])) for t in order]
    assert seen == sorted(seen)
    for i, t in docs:
        assert texts[i]["size"] == size(t)
        assert texts[i]["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    return load


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_minimal_capacity(docs_of, shards):
    docs = [(i, "ab" * (i * 37 % 91)) for i in range(60)] + [(100, None), (101, ""), (102, "é"), (103, None)]
    docs += [(200 + i, "copy" * 30) for i in range(9)]
    rows = sharding.shard_documents(docs_of(docs), shards).collect()
    check(rows, docs, shards)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_hot_group_and_few_groups(docs_of):
    docs = [(i, "hot " * 50) for i in range(40)] + [(100 + i, "x" * i) for i in range(20)]
    check(sharding.shard_documents(docs_of(docs), 16).collect(), docs, 16)
    few = [(1, "a"), (2, "a"), (3, "bb")]
    check(sharding.shard_documents(docs_of(few), 16).collect(), few, 16)


def test_zooming_cells(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 3)
    monkeypatch.setattr(sharding, "ZOOM", 2)
    docs = [(i, "z" * (i * 53 % 97)) for i in range(120)]
    check(sharding.shard_documents(docs_of(docs), 7).collect(), docs, 7)


def test_empty(docs_of):
    assert sharding.shard_documents(docs_of([]), 16).collect() == []


def test_whole_table_is_even(sf_docs):
    rows = sharding.shard_documents(sf_docs, 16).groupBy("shard").sum("size").collect()
    load = [r[1] for r in rows]
    assert len(load) == 16 and max(load) < 1.2 * sum(load) / 16
