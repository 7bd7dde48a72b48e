"""Language identification: corner cases and held-out accuracy."""

import zlib

import numpy as np

from chatlake.llm import langid


def test_corner_cases(docs_of):
    docs = [(i, "the cat and the dog went out " * 4, "en") for i in range(20)]
    docs += [(100 + i, "der Hund und die Katze gingen hinaus " * 4, "de") for i in range(20)]
    docs += [(200, None, "en"), (201, "", "de"), (202, "123 $$$ \n", None), (203, "the dog and the cat", None),
             (204, "Die Katze und der Hund", None), (205, "日本", None), (206, "x", "fr"), (None, "the cat", "en")]
    docs += [(300, "der Hund " * 300_000, "de")] + [(301, "the dog went", None)] * 3
    rows = {r["doc_id"]: r for r in langid.predict_languages(docs_of(docs)).collect()}
    assert [rows[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3
    assert [rows[i]["lang_pred"] for i in (203, 204, 300, 301)] == ["en", "de", "de", "en"]
    assert rows[205]["lang_pred"] in ("en", "de", "fr") and rows[205]["score"] == 0
    for i, r in rows.items():
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)


def test_nothing_to_learn(docs_of):
    rows = langid.predict_languages(docs_of([(1, "some text"), (2, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
    assert langid.predict_languages(docs_of([])).collect() == []


def test_held_out_accuracy(sf_docs):
    lang = {r["doc_id"]: r["lang"] for r in sf_docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.predict_languages(sf_docs).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97


def test_labels_and_sources_are_no_inputs(sf_docs):
    """A held-out document's prediction doesn't change with its label."""
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    other = sf_docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    a = {r["doc_id"]: tuple(r) for r in langid.predict_languages(sf_docs).collect() if r["held_out"]}
    b = {r["doc_id"]: tuple(r) for r in langid.predict_languages(other).collect() if r["held_out"]}
    assert a == b


def test_chunks_lose_no_ngram(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    whole = np.sort(np.concatenate([h for _, h, _ in langid.ngrams([text])]))
    monkeypatch.setattr(langid, "_CHUNK", 100)
    parts = np.concatenate([h for _, h, _ in langid.ngrams([text])])
    # " abc" and "abc " windows at slice ends are extra only where a text ends
    assert set(whole) <= set(parts)


def plain_ngrams(text):
    t = f" {(text or '').lower()}  "
    t = "".join(c if c.isalpha() else " " for c in t)
    return sorted(t[i:i + 4] for i in range(len(t) - 3) if " " not in t[i + 1:i + 3])


def test_ngrams_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    def of(texts):
        out = [[] for _ in texts]
        for row, h, _ in langid.ngrams(texts):
            for k, x in zip(row.tolist(), h.tolist()):
                out[k].append("".join(chr(x >> s & 0xFFFF) for s in (48, 32, 16, 0)))
        return [sorted(x) for x in out]

    rng = np.random.default_rng(3)
    texts = ["ab", "x", "", None, "the cat", "1a", "ÀÉ", "a b", " on", "ok "] + [
        "".join(rng.choice(list("abc  d1"), n)) for n in (1, 2, 3, 96, 97, 98, 99, 100, 101, 102, 103, 104, 250, 500)]
    for chunk in (langid._CHUNK, 100, 7):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], rng.permutation(len(texts))):
            some = [texts[i] for i in order]
            assert of(some) == [plain_ngrams(t) for t in some]


def test_predictions_do_not_depend_on_row_order(docs_of):
    docs = [(i, "the cat and the dog went out " * 4, "en") for i in range(20)]
    docs += [(100 + i, "der Hund und die Katze gingen hinaus " * 4, "de") for i in range(20)]
    docs += [(200 + i, ("is", "er", "go", "um")[i % 4], ("en", "de")[i % 2]) for i in range(24)]
    rows = [sorted(map(tuple, langid.predict_languages(docs_of(x).coalesce(1)).collect()))
            for x in (docs, docs[::-1], docs[::3] + docs[1::3] + docs[2::3])]
    assert rows[0] == rows[1] == rows[2]


def test_false_positives_are_corrected():
    """A filter so full that each language claims half of all n-grams."""
    rng = np.random.default_rng(0)
    f = langid.LanguageFilter(["a", "b"], "a", 12)
    f.add(np.zeros(5000, np.int64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    f.add(np.ones(600, np.int64), rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    f.close()
    assert f.wrong[0] > 5 * f.wrong[1]
    grams = np.concatenate([h for _, h, _ in langid.ngrams(["zebra crossing ahead"] )])
    f.add(np.ones(len(grams), np.int64), grams)
    f.close()
    assert f.predict(["zebra crossing ahead"])[0] == ["b"]
