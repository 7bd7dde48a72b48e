"""Kneser-Ney against a plain model, and as a distribution."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from chatlake.llm import kneser_ney as kn


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.uni.update(w)
            self.bi.update(zip([0] + w[:-1], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.cont, self.ctx, self.follow = Counter(), Counter(), defaultdict(Counter)
        for (a, b), c in self.bi.items():
            self.cont[b] += 1
            self.ctx[a] += c
            self.follow[a][min(c, 3)] += 1
        self.d1, self.d2 = self.disc(self.cont), self.disc(self.bi)
        self.every = sum(self.cont.values())
        self.rest = sum(self.d1[min(c, 3)] for c in self.cont.values()) / max(self.every, 1)

    @staticmethod
    def disc(counts):
        n = Counter(counts.values())
        return (0.0,) + kn.discounts(n[1], n[2], n[3], n[4])

    def word(self, w):
        if not self.every:
            return 1.0
        c = self.cont[w]
        return max(c - self.d1[min(c, 3)], 0) / self.every + self.rest / (self.v + 1)

    def p(self, a, w):
        if not self.ctx[a]:
            return self.word(w)
        back = sum(self.d2[k] * n for k, n in self.follow[a].items()) / self.ctx[a]
        c = self.bi[a, w]
        return max(c - self.d2[min(c, 3)], 0) / self.ctx[a] + back * self.word(w)

    def score(self, text):
        w = words(text)
        return sum(math.log10(self.p(a, b)) for a, b in zip([0] + w[:-1], w))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in words(text))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def check(df, docs):
    model = Plain([t for i, t in docs if i is not None and not held(i)])
    rows = df.collect()
    assert len(rows) == len(docs)
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(t)
    for r in rows:
        t = want[r["doc_id"]][0]
        w = words(t)
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == model.n
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(model.uni[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(model.base(t), rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-9, abs=1e-9)
    return model


def test_small(docs_of, monkeypatch):
    monkeypatch.setattr(kn, "CHUNK", 40)
    monkeypatch.setattr(kn, "_BLOCK", 16)
    docs = [(i, ("the cat sat on the mat " * (i % 4) + f"w{i % 7} é\u00a0x Z") .strip()) for i in range(80)]
    docs += [(100, None), (101, ""), (102, " \n"), (103, "a " * 700), (104, "THE Cat"), (105, "n\x00ul \x00 \x1cq"),
             (None, "never learned"), (106, "rep rep")] + [(106, "rep rep")] * 3
    model = check(kn.score_corpus(docs_of(docs)), docs)
    for a in (0, "the", "cat"):  # a distribution over all words and one unknown word
        assert sum(model.p(a, w) for w in [*model.uni, "unseen"]) == pytest.approx(1.0)


def test_many_ranges_and_large_counts(docs_of, monkeypatch):
    monkeypatch.setattr(kn, "RANGE", 50)
    docs = [(i, f"a b a b c{i % 90} d{i % 60} a b") for i in range(300)]
    check(kn.score_corpus(docs_of(docs)), docs)


def test_nothing_to_learn(docs_of):
    rows = kn.score_corpus(docs_of([(None, "a b")])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(3, 0, 0, 0.0)]
    assert kn.score_corpus(docs_of([])).collect() == []


def test_whole_table(sf_docs):
    docs = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    df = kn.score_corpus(sf_docs).cache()
    check(df, docs)
    s = df.where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert s["sum(score)"] > s["sum(base_score)"]


def test_unmounted_folder():
    with pytest.raises(ValueError):
        kn._folder("hdfs://host/x")


def test_pack_round_trip():
    import numpy as np

    for x in ([], [0], [255, 256], [1, 70000, 3], [1 << 60, 5]):
        assert kn._unpack(kn._pack(np.array(x, np.uint64))).tolist() == x


def test_a_missing_range_is_an_error(spark, sf_docs, tmp_path):
    import glob
    import os
    folder = str(tmp_path / "model")
    model = kn.fit(sf_docs.select("doc_id", "text"), folder)
    texts = [b"some words in a text", b""]
    model.score(texts, model.maps())
    for kind in ("vocab", "words", "bigrams"):
        some = glob.glob(f"{folder}/{kind}/*.npy")
        for f in some:
            os.rename(f, f + ".gone")
        with pytest.raises(FileNotFoundError, match="shared folder"):
            model.score([r.text.encode() for r in sf_docs.where("text is not null").limit(5).collect()], model.maps())
        for f in some:
            os.rename(f + ".gone", f)


def test_too_many_words_are_an_error(spark, sf_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(kn, "MOST_WORDS", 100)
    with pytest.raises(ValueError, match="32 bits"):
        kn.fit(sf_docs.select("doc_id", "text"), str(tmp_path / "model"))
