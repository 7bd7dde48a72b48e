"""Token counters, pooled embeddings, keyword index, malformed result lines."""

import datetime
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake import fixtures, schemas
from chatlake.dataset import ChatData
from chatlake.operators import derive, stats, store, summaries, vectors

SF = "/root/testdata/sf0.01"


def test_token_counter_is_the_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    data = fixtures.derived_data(spark, SF)
    odd = spark.createDataFrame([(1, 1, None), (2, 1, ""), (3, 1, "  two\n\nlines 's <|endoftext|> é漢 \t"), (4, 1, "x" * 50_000)],
                                "id long, conversation_id long, content string")
    rows = data.messages.select("id", "conversation_id", "content").unionByName(odd)
    counter = derive.rank_file_counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.id: r.token_count for r in derive.token_counts(rows, counter).collect()}
    want = {r.id: len(whole.encode(r.content or "", add_special_tokens=False).ids) for r in rows.collect()}
    assert got == want


def test_counted_messages_keep_stored_counts(spark):
    msgs = spark.createDataFrame([(1, 1, "user", "a b c", 7), (2, 1, "user", "a b c", 0), (3, 1, "assistant", "a b", None)],
                                 "id long, conversation_id long, role string, content string, token_count long")
    conv = spark.createDataFrame([(1, datetime.date(2024, 1, 1))], "id long, date date")
    counted = derive.counted_messages(msgs, lambda: lambda t: len(t.split()))
    assert [r.token_count for r in counted.orderBy("id").collect()] == [7, 3, 2]
    day = stats.daily_stats(counted, conv).first()
    assert (day.user_tokens, day.assistant_tokens) == (10, 2)


def test_embedding_never_builds_a_conversation(spark, monkeypatch):
    monkeypatch.setattr(derive, "conversation_text", None)
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def encode(texts):
            seen.add(max(map(len, texts)) > 50)
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], np.float32)
        return encode

    conv = spark.createDataFrame([(1, "t"), (2, "u"), (3, None), (4, "v")], "id long, topic string")
    msgs = spark.createDataFrame([(10, 1, "user", "a" * 120), (11, 1, "assistant", None), (30, 3, "user", "  ")],
                                 "id long, conversation_id long, role string, content string")
    summ = spark.createDataFrame([(2, "ab" * 40, ["x", "y"]), (3, "", None)],
                                 "conversation_id long, summary string, key_topics array<string>")
    rows, counters = vectors.embed_conversations(conv, msgs, summ, None, factory, chunk=50)
    got = {r.conversation_id: r.embedding for r in rows.collect()}

    def unit(texts):
        pieces = [t[i:i + 50] for t in texts for i in range(0, len(t), 50)]
        v = sum(len(p) * np.array([len(p), p.count("a"), 1.0]) for p in pieces) / sum(map(len, pieces))
        return v / np.linalg.norm(v)

    want = {1: unit(["[USER]\n" + "a" * 120 + "\n", "[ASSISTANT]\n\n"]), 2: unit(["u. " + "ab" * 40 + ". Topics: x, y"]),
            3: unit(["[USER]\n  \n"])}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert counters.first().asDict() == {"embedded": 3, "skipped": 1}
    assert seen.value == 0


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("indexed"))
    data = fixtures.derived_data(spark, SF)
    data.conversations.write.parquet(f"{root}/conversations")
    store.upsert_summaries(spark, root, data.summaries, index=True)
    return root


@pytest.mark.parametrize("query", ["src1", "SRC1", "the", "onth", "é", "a", "", "no such text", "lang", "%", "en", "éau", "\n\n"])
def test_index_gives_the_rows_of_the_scan(spark, indexed, query):
    d = ChatData.read(spark, indexed)
    want = summaries.keyword_search(d.summaries, d.conversations, query, 1000).collect()
    assert summaries.keyword_search_indexed(spark, indexed, d.conversations, query, 1000).collect() == want


def test_index_reads_the_buckets_of_the_candidates(spark, indexed):
    d = ChatData.read(spark, indexed)
    one = d.summaries.orderBy("conversation_id").first()
    needle = one.summary[100:140]
    hits = summaries.keyword_search_indexed(spark, indexed, d.conversations, needle)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*bucket64[^\]]*)\]", plan)
    assert filters and all(re.search(r"bucket64#\d+ (=|IN)", f) for f in filters)
    assert one.conversation_id in [r.id for r in hits.collect()]
    postings = spark.read.parquet(f"{indexed}/{summaries.INDEX}")
    assert summaries.keyword_candidates(postings, needle).count() < d.summaries.count() / 10


def test_index_follows_upserts(spark, indexed, tmp_path):
    import shutil
    root = str(tmp_path / "copy")
    shutil.copytree(indexed, root)
    d = ChatData.read(spark, root)
    k = d.summaries.orderBy("conversation_id").first().conversation_id
    row = spark.createDataFrame([(None, k, "a quite unheard-of word: Zyzzyva", ["Qoph"], None, None, None)], schemas.SUMMARIES)
    store.upsert_summaries(spark, root, row)
    for q in ("zyzzyva", "qOPH"):
        assert [r.id for r in summaries.keyword_search_indexed(spark, root, d.conversations, q).collect()] == [k]
    store.remove_conversations(spark, root, spark.createDataFrame([(k,)], "conversation_id long"))
    assert summaries.keyword_search_indexed(spark, root, d.conversations, "zyzzyva").collect() == []
    assert spark.read.parquet(f"{root}/{summaries.INDEX}").where(F.col("conversation_id") == k).count() == 0


def test_malformed_result_lines(spark, tmp_path):
    def line(i, text):
        return json.dumps({"custom_id": i, "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": text}]}}})

    good = '{"summary": "%s"}'
    (tmp_path / "a.jsonl").write_text("\n".join([line("summary_1", good % "old"), '{"custom_id": "summary_2", "result', "not json",
                                                 line("summary_1", good % "new")]))
    results = derive.read_results(spark, str(tmp_path / "a.jsonl"))
    rows, rejects, counters = derive.load_summaries(results)
    assert sorted((r.reply, r.reason) for r in rejects.collect()) == [
        ("not json", "malformed line"), ('{"custom_id": "summary_2", "result', "malformed line")]
    assert counters.first().asDict() == {"succeeded": 2, "other": 0, "loaded": 2, "errors": 2, "rejected": 0}
    root = str(tmp_path / "archive")
    store.upsert_summaries(spark, root, rows, input_order=["line_no"])
    assert [r.summary for r in store.read_table(spark, root, "summaries").collect()] == ["new"]
    _, rejects, counters = derive.load_insights(results, None)
    assert [r.reason for r in rejects.collect()].count("malformed line") == 2
    assert counters.first().errors == 4


def test_tag_wildcards(spark):
    from chatlake.operators import browse
    rows = spark.createDataFrame([(1, ["Alpha", "b"], 0.5), (2, ["a%b"], 0.4), (3, None, 0.3), (4, ["beta", "ALP"], 0.2)],
                                 "id long, tags array<string>, confidence double")
    ids = lambda **k: [r.id for r in browse.insights_filtered(rows, **k).collect()]
    assert ids(tag="alp%") == [] and ids(tag="alp%", wildcards=True) == [1, 4] and ids(tag="A%B") == [2]
    assert ids(tag="a_b", wildcards=True) == [2] and ids(tag="_", wildcards=True) == [1]
