"""SimHash against a plain model and all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chatlake.llm import simhash


def plain(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def check(df, docs):
    rows = {r["doc_id"]: r for r in df.collect()}
    ids = [i for i, _ in docs]
    fps = [plain(t) for _, t in docs]
    roots = components(fps)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min(i, least.get(r, i))
    for i, fp, r in zip(ids, fps, roots):
        assert rows[i]["fp"] % (1 << 64) == fp
        assert rows[i]["component_id"] == least[r]


def test_small_cases(docs_of):
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (10, "É é a b c d"), (11, "\x1ca b c d e"),
            (12, "a b c d " * 500), (13, "a b c d " * 501), (2, "zero"), (20, "x y z w v u")]
    check(simhash.near_duplicates(docs_of(docs)), docs)
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_near_copies(docs_of):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = [(1000, " ".join(base))]
    for k in range(80):
        w = base[:]
        for _ in range(k % 4):
            w[rng.randrange(150)] = f"n{k}"
        docs.append((k, " ".join(w)))
    docs += [(2000 + k, " ".join(f"u{rng.randrange(9999)}" for _ in range(60))) for k in range(40)]
    check(simhash.near_duplicates(docs_of(docs)), docs)


def test_repeated_rows(docs_of):
    docs = [(3, "a b c d e f")] * 4 + [(1, "q r s t u")]
    rows = simhash.near_duplicates(docs_of(docs)).collect()
    assert sorted(r["component_id"] for r in rows) == [1, 3, 3, 3, 3]


def test_links_find_every_close_pair(spark, monkeypatch):
    """Random close fingerprints, with small blocks, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                y ^= 1 << b
            fps.add(y)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << rng.randrange(12)) for _ in range(12)} | {hub ^ k for k in range(40)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    at = {signed(x): i for i, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [find(i) for i in range(len(fps))] == components(fps)


def test_keys_are_dealt_to_bounded_tasks(spark, monkeypatch):
    """64 keys a fingerprint: fingerprints that lie in one small file would be one task."""
    monkeypatch.setattr(simhash, "KEY_ROWS", 50_000)
    fps = spark.range(0, 10_000, 1, 1).selectExpr("xxhash64(id) AS fp")
    keys = simhash.ring_keys(fps, simhash.Ring(4))
    sizes = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 640_000 and max(sizes) < 2 * 50_000


def test_links_broadcast_no_keys(spark, monkeypatch):
    """64 keys a fingerprint, whose size Spark takes for that of the fingerprints: neither they nor their counts are sent."""
    plans, stored = {}, simhash.stored

    def watched(df, name):
        if name == "simkeys":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", watched)
    close = "explode(array(0L, 1L, 6L)) AS x"
    fps = spark.range(0, 500, 1, 1).selectExpr("id", close).selectExpr("xxhash64(id) ^ x AS fp")
    assert len({x for link in simhash.links(fps).collect() for x in link}) == 1500
    assert "isFinalPlan=true" in plans["simkeys"]
    assert "SortMergeJoin" in plans["simkeys"] and "Broadcast" not in plans["simkeys"]


def test_one_of_each_moves_texts_once(docs_of):
    """Texts meet their kept id once; only repeated rows (same id and text) are put together."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    a, b, c = text(), text(), text()
    docs = [(1, a), (2, b), (3, a), (None, a), (4, c), (5, None), (6, "")]
    kept = simhash.one_of_each(docs_of(docs))
    assert "Aggregate" not in kept._jdf.queryExecution().executedPlan().toString()
    want = {(None, a), (2, b), (4, c), (5, None)}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    # Rows of one id with other texts are no copies; repeated rows are, also those of a null id.
    docs += [(None, a)] * 3 + [(2, b)] * 2 + [(4, text()), (5, None)]
    kept = simhash.one_of_each(docs_of(docs))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want | {docs[-2]}, key=str)
    assert kept.columns == docs_of(docs).columns


def test_ring_budgets():
    ring = simhash.Ring(4)
    assert sum(ring.width) == 64 and ring.budget == [0, 1, 2, 3, 4]
    rng = random.Random(1)
    for _ in range(2000):  # some start keeps every budget
        x = 0
        for b in rng.sample(range(64), rng.randrange(5)):
            x |= 1 << b
        assert ring.near(np.full(5, x, np.uint64), np.arange(5)).any()


def test_whole_table(sf_docs):
    docs = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    check(simhash.near_duplicates(sf_docs), docs)
