"""Prefix encoding against the tokenizer library."""

import hashlib
import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatlake.llm import bpe, queries

ODD = ["", " ", "don't they'll 's 'Re", "É é ﬁ ſ İ ı ŉ ŸǅΣας", "a\x1cb\x1d c\x85d e f　g", "x\x00y�",
       "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|", "0123 ٣² ½ Ⅷ 1e5", "漢字かな 한국 👍🏽 é́̈", "z" * 5000,
       "aaaaaaa" * 99, "&&&&!!!!....", "ä́", "̈x ́"]


LIBRARY = Tokenizer.from_file(bpe.default_file())


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    out = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())


def test_query(spark, library, tmp_path):
    texts = ODD + [None, "word " * 60_000]
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, ODD[3], "y", 2)] * 2 + [(None, "no id", "", 3)],
                          "doc_id long, text string, ids string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_bpe(spark, str(tmp_path)).collect()
    want = [(i, *row(library, t)) for i, t in enumerate(texts)] + [(3, *row(library, ODD[3]))] * 2
    assert sorted(map(tuple, rows), key=str) == sorted([*want, (None, *row(library, "no id"))], key=str)


def test_whole_table(spark, sf_docs, library):
    want = {r.doc_id: row(library, r.text) for r in sf_docs.select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_long_words_take_linear_time(library):
    made = bpe.encoder(bpe.default_file())
    took = []
    for n in (20_000, 200_000):
        text = "z" * n + " 漢 " + "ab" * (n // 2) + "é" * n + "¿" * n
        t0 = time.time()
        ids = made.encode(text)
        took.append(time.time() - t0)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert took[1] < 40 * took[0] + 1


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    made, lib = bpe.encoder(bpe.default_file()), LIBRARY
    ids = made.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert made.decode(ids) == lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(12))
def test_random_merges(tmp_path, seed):
    """Tokenizers of few letters, whose merges overlap, tie and make tokens that never stand."""
    with open(bpe.default_file(), encoding="utf-8") as f:
        spec = json.load(f)
    rng = random.Random(seed)
    old = sorted(spec["model"]["vocab"].items(), key=lambda x: x[1])[:512]
    vocab, merges = dict(old), []
    letters = "abc"[: 1 + seed % 3]
    parts = [*letters, *[c + "</w>" for c in letters]]
    while len(merges) < 15:
        x, y = rng.choice([p for p in parts if not p.endswith("</w>")]), rng.choice(parts)
        if x + y not in vocab and len(x + y) < 24:
            vocab[x + y] = len(vocab)
            merges.append([x, y])
            parts.append(x + y)
    spec["model"].update(vocab=vocab, merges=merges)
    spec["added_tokens"] = [{**t, "id": len(vocab) + k} for k, t in enumerate(spec["added_tokens"])]
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    made, lib = bpe.PrefixBpe(path), Tokenizer.from_file(path)
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(made.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_automaton_finds_every_token():
    rng = random.Random(4)
    words = {tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7))) for _ in range(60)}
    auto = bpe.SuffixAutomaton()
    for w in words:
        auto.add(list(w))
    inside = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for n in range(1, 8):
        for _ in range(200):
            w = tuple(rng.randrange(3) for _ in range(n))
            s = 0
            for c in w:
                s = auto.next.get(s << auto.bits | c) if s is not None else None
            assert (s is not None) == (w in inside)


def test_empty(docs_of):
    assert bpe.encode_documents(docs_of([])).collect() == []


def test_other_tokenizers_are_refused():
    import public_tokenizers as P

    with pytest.raises((ValueError, KeyError)):
        bpe.PrefixBpe(P.path("byte_bpe_50k.json"))
