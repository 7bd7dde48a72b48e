"""Quality rules: measures and cutoffs against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatlake.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {x for x, n in Counter(tri).items() if n > 1}
    covered = {i + k for i, x in enumerate(tri) if x in again for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(docs_of):
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "a b c a b c"), (5, "a a a a a a"), (6, "x\nx\n x\nx"),
            (7, "# $ % & | < > * é\u2028ü 日本"), (8, "a b c " * 20_000), (9, "a b c d\n" * 3 + "\n\n"),
            (10, "p q r s t p q r u s t p"), (11, "\x0b\x0c\x1c y"), (12, "ab c a bc ab c a bc")]
    rows = {r["doc_id"]: r for r in quality.text_measures(docs_of(docs)).collect()}
    for i, t in docs:
        assert tuple(rows[i][c] for c in COLS) == plain(t), i


def test_whole_table_measures(sf_docs):
    text = {r["doc_id"]: r["text"] for r in sf_docs.select("doc_id", "text").collect()}
    for r in quality.text_measures(sf_docs).collect():
        assert tuple(r[c] for c in COLS) == plain(text[r["doc_id"]])


@pytest.mark.parametrize("n,p", [(1, 0.3), (40, 0.05), (900, 0.01), (5000, 0.004)])
def test_binomial_tail(spark, n, p):
    ks = sorted({0, min(1, n), min(5, n), int(n * p)})
    got = spark.createDataFrame([(k,) for k in ks], "k long").select(
        "k", quality.binomial_tail(F.col("k"), F.lit(n).cast("long"), p).alias("t")).collect()
    for k, t in got:
        assert t == pytest.approx(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def cutoff(values, grid, alpha, limit):
    n, best = len(values), None
    for t in grid:
        k = sum(v > t for v in values)
        if k > n * alpha or sum(math.comb(n, i) * alpha ** i * (1 - alpha) ** (n - i) for i in range(k + 1)) > limit:
            return best
        best = t
    return best


def test_cutoffs_and_verdicts(spark, docs_of):
    docs, labels = [], []
    for i in range(1500):
        bad = i % 10 == 0
        words = [f"w{i}x{k}" for k in range(60)] + ["$$$$$$$$$$$$$$$$$$$"] * (40 if bad else i % 3)
        docs.append((i, "\n".join(words), ("en", "fr", None)[i % 3]))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(5000, "short", "en"), (5001, None, "en"), (5002, "a b c " * 40, "en"), (5003, docs[10][1], "xx")]
    labels += [(7, 1, 0), (9999, 1, 0), (None, 1, 0), (4, None, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = {"symbols": ("n_symbols / n_words", [8.0, 4.0, 2.0, 1.0, 0.5, 0.1])}
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs_of(docs), lab, rules=rules, alpha=0.02).collect()}
    for s in ("en", "fr", None):
        good = [i for i, _, lang in docs if lang == s and i < 1500 and i % 10 and not rows[i]["base_failed"]]
        t = cutoff([rows[i]["n_symbols"] / rows[i]["n_words"] for i in good], rules["symbols"][1], 0.02, 0.05 / 3)
        assert t is not None
        for i, _, lang in docs:
            if lang == s and i < 1500:
                assert rows[i]["kept"] == (not rows[i]["base_failed"] and rows[i]["n_symbols"] / rows[i]["n_words"] <= t)
    assert [rows[i]["base_failed"] for i in (5000, 5001, 5002)] == [True] * 3
    assert rows[5003]["kept"]  # a stratum without labels loses nothing
    assert not rows[10]["kept"] or not rows[20]["kept"]


@pytest.mark.parametrize("sizes", [{"en": 400, "fr": 120, "de": 60}, {"en": 400, "fr": 120, "de": 90, "es": 60},
                                   {"en": 150, "fr": 30}, {"en": 400, "fr": 300}, {"en": 240, "fr": 230}])
def test_strata_with_few_labels_share_a_pool(spark, docs_of, sizes):
    """0.98 ** n <= 0.05 / strata needs about 200 good labels."""
    docs, labels = [], []
    for lang, n in sizes.items():
        for i in range(n + n // 4):
            bad = i >= n
            words = [f"w{i}x{k}" for k in range(60)] + ["$$$$$$"] * (20 if bad else i % 3 if lang == "en" else 0)
            docs.append((len(docs), "\n".join(words), lang))
            labels.append((len(labels), 0 if bad else 1, 0))
    docs.append((5000, docs[-1][1], "xx"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = {"symbols": ("n_symbols / n_words", [8.0, 4.0, 2.0, 1.0, 0.5, 0.1, 0.05])}
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs_of(docs), lab, rules=rules, alpha=0.02).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    value = {i: rows[i]["n_symbols"] / rows[i]["n_words"] for i in rows}
    limit = 0.05 / len(sizes)
    good = {s: [value[i] for i, _, lang in docs if lang == s and i < 5000 and labels[i][1]] for s in sizes}
    small = [s for s in sizes if 0.98 ** len(good[s]) > limit]
    pool = []
    for s in sorted(sizes, key=sizes.get):
        if small and (s in small or 0.98 ** len(pool) > limit):
            pool += good[s]
    grid = rules["symbols"][1]
    for i, _, lang in docs:
        t = None if lang == "xx" else cutoff(pool if lang in small else good[lang], grid, 0.02, limit)
        assert rows[i]["kept"] == (t is None or value[i] <= t), (i, lang, t)
    if sum(sizes.values()) > 203:  # what the pool can certify rejects the bad documents of every language
        assert {lang for i, _, lang in docs if not rows[i]["kept"]} == set(sizes)


def test_empty_tables(spark, docs_of):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs_of([]), lab).collect() == []
    rows = quality.judge_quality(docs_of([(1, "# " * 60, "en"), (2, "a b", None)]), lab).collect()
    assert [r["kept"] for r in sorted(rows)] == [False, False]  # repeats and too short


def test_copies_are_one_trial(spark):
    """100 good documents certify nothing; repeated rows and copies of their texts don't either."""
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    docs = [(i, text(i), "en") for i in range(100)]
    bad = [(5000, text(9) + " ###" * 30, "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")

    def rejected(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return {r.doc_id for r in quality.judge_quality(df, labels).where("not kept").collect()}

    assert rejected(docs + bad) == set()
    assert rejected(docs * 20 + bad) == set()
    assert rejected([(100 * k + i, t, s) for k in range(20) for i, t, s in docs] + bad) == set()
    many = [(i, text(i), "en") for i in range(2500)]
    assert rejected(many + [(9000, *bad[0][1:])]) == {9000}
