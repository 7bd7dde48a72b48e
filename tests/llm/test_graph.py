"""Connected components against union-find."""

import random

from chatlake.llm import graph
from chatlake.llm.graph import connected_components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    edges += [(7, 7), (8, None), (None, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {x: find(x) for x in parent if find(x) != x}
    assert got == want


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hubs_go_through_the_broadcast(spark, monkeypatch):
    """Stars, chains of stars and a clique, with every node of three links a hub."""
    monkeypatch.setattr(graph, "HUB", 2)
    rng = random.Random(3)
    links = [(0, i) for i in range(1, 60)] + [(1000, i) for i in range(900, 960)] + [(59, 900)]
    links += [(2000 + i, 2000 + j) for i in range(8) for j in range(i)] + [(3000 + i, 3001 + i) for i in range(40)]
    links += [(rng.randrange(4000, 4100), rng.randrange(4000, 4100)) for _ in range(90)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in parent if find(x) != x}
    got = graph.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want
