"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from chatlake.llm import mixing, simhash


#: Further columns, named like results and internal columns of the stages.
EXTRA = ("score", "r1", "r2", "bytes", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "h", "frag")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    en = [w + x for w in ("th", "sh", "wh", "an") for x in ("e", "at", "is", "ere", "ing", "ough")]
    de = [w + x for w in ("sch", "ei", "zu", "ver") for x in ("en", "ung", "er", "ich", "aus", "tz")]
    text = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, text(en if i % 2 else de, 80 + i), "en" if i % 2 else "de", f"src{i % 3}") for i in range(40)]
    # 51 short words, the shortest passage that the stage must find: 203 to 254 bytes.
    passage = " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.choice((3, 3, 4)))) for _ in range(51))
    assert len(passage) < 260
    rows += [(100 + i, f"{text(en, 60)} {passage} {text(en, 60)}", "en", "src0") for i in range(3)]
    rows += [(200 + i, rows[4][1], "de", "src1") for i in range(3)]                  # exact copies
    rows += [(300, rows[5][1].replace("e1 ", "e2 ", 1), "en", None)]                 # a near copy at most
    rows += [(400, None, "en", "src1"), (401, "123 456 $$$", None, "src2"), (402, "", "de", None)]
    rows += [rows[7]] * 2                                                            # repeated rows
    extra = [f"{c} string" for c in EXTRA]
    rows = [(i, t, lang, s, len(t) if t is not None else None, *[f"{c}{i}" for c in EXTRA]) for i, t, lang, s in rows]
    d = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                               + ", ".join(extra))
    df.write.parquet(f"{d}/documents.parquet")
    return d, rows, passage


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus[0]}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        path = f"{corpus[0]}/out{len(out)}"
        stage(spark, docs, corpus[0]).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_language_rejects_only_texts_without_letters(corpus, stages):
    want = [r for r in corpus[1] if r[0] not in (400, 401, 402)]
    assert Counter(map(tuple, stages[0])) == Counter(want)


def test_language_sends_a_text_once(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    found = corpus_pipeline.language(spark, docs, corpus[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = re.search(r"MapInArrow run\(([^)]*)\)", plan)[1]
    assert len(re.findall(r"\b(?:in_)?text#", sent)) == 1


def test_fingerprint_keys_are_not_broadcast(spark, corpus, monkeypatch):
    """Spark sizes a fingerprint's keys like the fingerprint, so either side of their join looks small enough to send."""
    plans, stored = {}, simhash.stored

    def watched(df, name):
        if name == "simkeys":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", watched)
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    corpus_pipeline.near_duplicates(spark, docs, corpus[0])
    assert "SortMergeJoin" in plans["simkeys"] and "Broadcast" not in plans["simkeys"]


def test_one_document_of_every_group(stages):
    before, after = Counter(r.doc_id for r in stages[0]), Counter(r.doc_id for r in stages[1])
    assert max(after.values()) == 1
    assert set(after) <= set(before) and not set(after) & {200, 201, 202} and {4, 5, 7, 100, 101, 102} <= set(after)
    texts = [r.text for r in stages[1]]
    assert len(texts) == len(set(texts))
    assert {r.doc_id for r in stages[1]} >= set(range(40))


def test_passages_go_and_the_rest_stays(corpus, stages):
    text = {r.doc_id: r.text for r in stages[1]}
    for r in stages[2]:
        assert r.n_chars == len(r.text) and all(r[c] == f"{c}{r.doc_id}" for c in EXTRA)
        if r.doc_id in (100, 101, 102):
            assert corpus[2] not in r.text and corpus[2][5:-5] not in r.text and len(r.text) < len(text[r.doc_id]) - len(corpus[2]) + 2
        elif not (r.doc_id in (5, 300) and {5, 300} <= set(text)):  # 300 may be too far from 5 to be its copy
            assert r.text == text[r.doc_id]


def test_mix_takes_copies(spark, corpus, stages):
    docs = spark.read.parquet(f"{corpus[0]}/out2")
    want = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert Counter(r.doc_id for r in stages[3]) == Counter({k: c for k, c in want.items() if c})


def test_sequences_hold_every_copy(stages):
    docs, pieces, seqs = Counter(r.doc_id for r in stages[3]), Counter(), defaultdict(list)
    for r in stages[4]:
        pieces[r.doc_id] += r.piece == 0
        seqs[r.sequence_id].append((r.offset, r.length))
    assert pieces == docs
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024


def test_run_is_the_stages(spark, corpus, stages):
    rows = corpus_pipeline.run(spark, corpus[0]).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert Counter(map(tuple, rows)) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages[4])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
