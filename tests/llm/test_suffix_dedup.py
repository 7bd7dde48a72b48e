"""Suffix-array deduplication against all windows in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chatlake.llm import suffix_dedup as sd


def brute(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p:p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                   for r in df.collect()), key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdeé ") for _ in range(k))
    passages = [text(rng.randrange(20, 90)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages), text(rng.randrange(30))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "z" * 500), (105, "ab" * 300),
             (106, "yz"), (None, passages[0]), (107, passages[1])] + [(107, passages[1])] * 2
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_random_corpora(docs_of, seed):
    docs = corpus(seed)
    assert got(sd.remove_repeats(docs_of(docs), 24)) == brute(docs, 24)


def test_keys_over_several_shards(docs_of, monkeypatch):
    """A hot passage in many texts, with tiny shards and merge ranges."""
    monkeypatch.setattr(sd, "HOT", 3)
    monkeypatch.setattr(sd, "SHARD_BYTES", 500)
    monkeypatch.setattr(sd, "MERGE", 40)
    monkeypatch.setattr(sd, "GRAM_SHARE", 3)
    rng = random.Random(9)
    line = "the same license line in every text"
    docs = [(i, "".join(rng.choice("abc") for _ in range(50)) + line + "".join(rng.choice("abc") for _ in range(50)))
            for i in range(60)]
    docs += corpus(11)[:30]
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    assert got(sd.remove_repeats(docs_of(docs), 24)) == brute(docs, 24)


def test_length_400(docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(60), text(75), text(200), text(70)[:399], text(90)[:400]]
    docs = [(i, text(rng.randrange(20, 150)) + rng.choice(shared) + text(40)) for i in range(30)]
    docs += [(50, shared[2]), (51, shared[4]), (52, shared[3])]
    assert got(sd.remove_repeats(docs_of(docs), 400)) == brute(docs, 400)


def test_length_400_text_that_overlaps_its_own_copy(docs_of):
    """Periodic stretches in one place are one fragment; their key occurs nowhere else."""
    rng = random.Random(2)
    text = lambda k: "".join(rng.choice("etaoinshr ") for _ in range(k))
    docs = [(0, "z" * 500), (1, "ab" * 250), (2, text(700) + text(60) * 8 + text(700)), (3, text(900)),
            (4, text(50) + text(299) * 3 + text(50)), (5, text(300) + "q" * 401), (6, "y" * 400), (7, text(150) * 2),
            (8, text(20) + text(200) * 3), (9, text(399) + text(1) + "w" * 700 + text(30))]
    docs += [(10 + p, text(rng.randrange(500)) + (text(p) * 402)[:400 + rng.randrange(1, 300)] + text(rng.randrange(500)))
             for p in range(1, 302, 7)]
    rows = got(sd.remove_repeats(docs_of(docs), 400))
    assert rows == brute(docs, 400)
    assert {r[0]: r[2] for r in rows}[0] == 500


def test_hubs(docs_of, monkeypatch):
    """Every key and fragment with three rows goes through the broadcasts."""
    from chatlake.llm import common
    monkeypatch.setattr(common, "HUB_ROWS", 2)
    docs = corpus(21) + [(500 + i, "one of very many copies of a text, the same in all") for i in range(40)]
    assert got(sd.remove_repeats(docs_of(docs), 24)) == brute(docs, 24)


def test_long_texts_are_cut_in_slices(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "_SLICE", 100)
    docs = [(i, t) for i, (_, t) in enumerate(corpus(5))] + [(900, "".join(t or "" for _, t in corpus(5)))]
    assert got(sd.remove_repeats(docs_of(docs), 24)) == brute(docs, 24)


INTERNAL = ("r1", "r2", "bytes", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "h", "f1", "f2", "frag",
            "spans", "wanted", "first", "last", "at", "n", "c0", "c1", "c_doc_id", "shard", "different", "a.b")


def test_columns_with_internal_names_pass_through(spark):
    """Every name that the operator uses inside, as a column of the documents."""
    docs = [(i, f"{i} some text" + " the same passage in two texts" * (i % 2), i * 10) for i in range(6)]
    df = spark.createDataFrame(
        [(i, t, len(t), *[f"{c}{i}" for c in INTERNAL]) for i, t, _ in docs],
        "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in INTERNAL))
    rows = sd.without_repeats(df, 24).collect()
    want = {r[0]: r for r in brute([(i, t) for i, t, _ in docs], 24)}
    assert len(rows) == 6 and rows[0].__fields__ == df.columns
    for r in rows:
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][4] and r["n_chars"] == len(r["text"])
        assert [r[c] for c in INTERNAL] == [f"{c}{r['doc_id']}" for c in INTERNAL]
    kept = sd.remove_repeats(df, 24, keep=("r1", "bytes", "c1")).collect()
    assert all((r["r1"], r["bytes"], r["c1"]) == tuple(f"{c}{r['doc_id']}" for c in ("r1", "bytes", "c1")) for r in kept)
    with pytest.raises(ValueError, match="n_bytes"):
        sd.remove_repeats(df, 24, keep=("n_bytes",))


def test_empty(docs_of):
    assert sd.remove_repeats(docs_of([]), 400).collect() == []


@pytest.mark.parametrize("length", [1, 5, 8, 9, 24, 40])
def test_suffix_array_and_prefixes(length):
    rng = random.Random(length)
    for _ in range(20):
        frags = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(length, 4 * length))) for _ in range(6)]
        a, start, owner, left = sd._layout(frags)
        order = sd.sort_windows(a, left, length)
        raw = bytes(a)
        key = [raw[p:p + length] for p in order]
        assert sorted(order) == [p for p in range(len(a)) if left[p] >= length]
        assert key == sorted(key)
        lcp = sd.common_prefixes(a, left, order)
        for k in range(1, len(order)):
            p, q = order[k - 1], order[k]
            x, y = raw[p:p + left[p]], raw[q:q + left[q]]
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert lcp[k] == n
        seen = Counter(key)
        assert [bool(m) for m in sd.repeated_windows(a, left, length)[order]] == [seen[k] > 1 for k in key]


def test_merge_by_binary_search():
    rng = np.random.default_rng(0)
    runs = []
    for s in range(5):
        r = np.zeros(200, sd._MARK)
        r["x"], r["y"], r["f1"], r["at"] = rng.integers(0, 30, 200), rng.integers(0, 30, 200), s, np.arange(200)
        runs.append(np.sort(r, order=["x", "y"]))
    where = {}
    for s, r in enumerate(runs):
        for m in r:
            where.setdefault((int(m["x"]), int(m["y"])), set()).add(s)
    for s, (r, m) in enumerate(zip(runs, sd.merge_shards(runs))):
        assert m.tolist() == [x for x in r.tolist() if len(where[x[0], x[1]]) > 1]
