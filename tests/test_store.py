"""Writes to a stored archive: append with continuing ids, upserts, clear."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from chatlake import fixtures, schemas
from chatlake.dataset import ChatData
from chatlake.operators import store
from chatlake.operators.ingest import ingest_archive
from chatlake.plans import publish
from chatlake.sources import org_notes as O

SF = "/root/testdata/sf0.001"


def _archive(spark, tmp_path):
    root = str(tmp_path / "archive")
    fixtures.fixture_data(spark, SF, stored=False).write(root)
    return root


def test_append_conversations_continues_ids(spark, tmp_path):
    import test_ingest
    root = _archive(spark, tmp_path)
    notes = tmp_path / "notes"
    notes.mkdir()
    for name, text in test_ingest.NOTES.items():
        with open(notes / name, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    before = ChatData.read(spark, root)
    c_max = before.conversations.agg(F.max("id")).first()[0]
    m_max = before.messages.agg(F.max("id")).first()[0]
    n_conv, n_msg = before.conversations.count(), before.messages.count()
    convs, msgs, _ = O.ingest_notes(spark, str(notes))
    new_c, new_m = convs.count(), msgs.count()
    store.append_conversations(spark, root, convs, msgs)
    after = ChatData.read(spark, root)
    assert after.conversations.count() == n_conv + new_c
    assert after.messages.count() == n_msg + new_m
    added = after.conversations.where(F.col("id") > c_max)
    assert sorted(r.id for r in added.collect()) == list(range(c_max + 1, c_max + 1 + new_c))
    added_m = after.messages.where(F.col("id") > m_max)
    assert added_m.join(added.select(F.col("id").alias("conversation_id")), "conversation_id",
                        "left_anti").count() == 0
    days = {r.date for r in after.daily_stats.collect()}
    assert {r.date for r in added.collect() if r.date is not None} <= days


def test_upserts_are_idempotent(spark, tmp_path):
    root = _archive(spark, tmp_path)
    summ = spark.read.parquet(os.path.join(root, "summaries"))
    n = summ.count()
    # Inputs must not be lazy reads of the table being replaced: materialise them.
    new = summ.limit(5).withColumn("outcome", F.lit("resolved")) \
        .withColumn("summarized_at", F.current_timestamp())
    new = spark.createDataFrame(new.collect(), new.schema)
    store.upsert_summaries(spark, root, new)
    store.upsert_summaries(spark, root, new)
    after = ChatData.read(spark, root).summaries
    assert after.count() == n
    changed = {r.conversation_id for r in new.collect()}
    assert {r.outcome for r in after.where(F.col("conversation_id").isin(list(changed))).collect()} \
        == {"resolved"}
    assert after.select("id").distinct().count() == n

    emb = spark.read.parquet(os.path.join(root, "embeddings"))
    k = emb.count()
    repl = emb.limit(3).withColumn("model", F.lit("new-model")) \
        .withColumn("created_at", F.current_timestamp())
    repl = spark.createDataFrame(repl.collect(), repl.schema)
    store.upsert_embeddings(spark, root, repl)
    store.upsert_embeddings(spark, root, repl)
    e2 = ChatData.read(spark, root).embeddings
    assert e2.count() == k
    assert e2.where(F.col("model") == "new-model").count() == 3


def test_append_insights_and_clear(spark, tmp_path):
    root = _archive(spark, tmp_path)
    ins = spark.read.parquet(os.path.join(root, "insights"))
    top = ins.agg(F.max("id")).first()[0]
    n = ins.count()
    store.append_insights(spark, root, ins.limit(4).drop("id"))
    after = spark.read.parquet(os.path.join(root, "insights"))
    assert after.count() == n + 4
    assert sorted(r.id for r in after.where(F.col("id") > top).collect()) == \
        list(range(top + 1, top + 5))
    store.clear(spark, root)
    data = ChatData.read(spark, root)
    for name in ("conversations", "messages", "insights", "summaries", "embeddings", "daily_stats"):
        assert getattr(data, name).count() == 0


def test_new_summary_replaces_an_older_or_later_one(spark, tmp_path):
    root = _archive(spark, tmp_path)
    summ = spark.read.parquet(os.path.join(root, "summaries"))
    n, top = summ.count(), summ.agg(F.max("id")).first()[0]
    keys = [r.conversation_id for r in summ.orderBy("conversation_id").limit(3).collect()]
    new = spark.createDataFrame(
        [(None, k, "new", ["t"], "learning", "resolved", when)
         for k, when in zip(keys, (datetime.datetime(1999, 1, 1), None, datetime.datetime(2999, 1, 1)))]
        + [(None, 10 ** 9, "early", [], None, None, datetime.datetime(2020, 1, 1)),
           (None, 10 ** 9, "late", [], None, None, datetime.datetime(2021, 1, 1))], summ.schema)
    store.upsert_summaries(spark, root, new)
    after = {r.conversation_id: r for r in ChatData.read(spark, root).summaries.collect()}
    assert len(after) == n + 1
    assert [after[k].summary for k in keys] == ["new"] * 3
    assert after[10 ** 9].summary == "late"
    assert all(after[k].id > top for k in keys)


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_of_one_key_rewrites_one_bucket(spark, tmp_path):
    root = _archive(spark, tmp_path)
    summ = spark.read.parquet(os.path.join(root, "summaries"))
    rows = spark.createDataFrame(summ.withColumn("summary", F.lit("x")).collect(), summ.schema)
    store.upsert_summaries(spark, root, rows.limit(3))  # lays the table out in buckets
    before = _files(os.path.join(root, "summaries"))
    assert len({os.path.dirname(f) for f in before}) > 5
    n = ChatData.read(spark, root).summaries.count()
    one = rows.limit(1)
    store.upsert_summaries(spark, root, one)
    after = _files(os.path.join(root, "summaries"))
    changed = {os.path.dirname(f) for f in before ^ after}
    assert len(changed) == 1 and ChatData.read(spark, root).summaries.count() == n
    assert ChatData.read(spark, root).summaries.columns == summ.columns


@pytest.mark.parametrize("at", [1, 2])
def test_crash_while_a_batch_is_published(spark, tmp_path, monkeypatch, at):
    """Whatever rename fails, opening the archive again finishes the batch."""
    root = _archive(spark, tmp_path)
    summ = spark.read.parquet(os.path.join(root, "summaries"))
    rows = spark.createDataFrame(summ.withColumn("summary", F.lit("x")).limit(2).collect(), summ.schema)
    n, calls, rename = summ.count(), [], publish.Folder.rename

    def crash(self, a, b):
        calls.append(b)
        if len(calls) == at:
            raise OSError("lost")
        rename(self, a, b)

    monkeypatch.setattr(publish.Folder, "rename", crash)
    with pytest.raises(OSError):
        store.upsert_summaries(spark, root, rows)
    monkeypatch.setattr(publish.Folder, "rename", rename)
    after = ChatData.read(spark, root).summaries.collect()
    assert len(after) == n and sum(r.summary == "x" for r in after) == 2
    assert publish.Folder(spark, root).names(f"{root}/{publish.PENDING}") == []


def test_batch_that_is_not_ready_is_not_seen(spark, tmp_path):
    root = _archive(spark, tmp_path)
    before = sorted(map(str, ChatData.read(spark, root).summaries.collect()))
    publish.Batch(spark, root).replace("summaries", spark.createDataFrame([], "id long"))
    assert sorted(map(str, ChatData.read(spark, root).summaries.collect())) == before
    assert publish.discard(spark, root) == 1 and publish.discard(spark, root) == 0


def test_last_summary_of_the_input_stays(spark, tmp_path):
    """Several new rows of one conversation: the last in the input, or the last content, whatever the partitions."""
    root = _archive(spark, tmp_path)
    when = datetime.datetime(2024, 1, 1)
    rows = [(7, f"s{i}", ["t"], "learning", "ongoing", when, i) for i in (3, 9, 1, 5)]
    df = spark.createDataFrame(rows, "conversation_id long, summary string, key_topics array<string>, sentiment string, "
                                     "outcome string, summarized_at timestamp, line int")
    for parts in (1, 4):
        store.upsert_summaries(spark, root, df.repartition(parts), input_order=["line"])
        assert [r.summary for r in ChatData.read(spark, root).summaries.where("conversation_id = 7").collect()] == ["s9"]


def test_insights_of_other_categories_are_refused(spark, tmp_path):
    root = _archive(spark, tmp_path)
    bad = spark.createDataFrame([(1, "trivia", "t", "s", ["x"], 0.5, datetime.datetime(2024, 1, 1))],
                                "message_id long, category string, title string, summary string, tags array<string>, "
                                "confidence double, extracted_at timestamp")
    n = ChatData.read(spark, root).insights.count()
    with pytest.raises(ValueError, match="trivia"):
        store.append_insights(spark, root, bad)
    assert ChatData.read(spark, root).insights.count() == n


# -- one-call ingest ----------------------------------------------------------------------

def _notes(tmp_path, names=None):
    import test_ingest
    folder = tmp_path / "notes"
    folder.mkdir(exist_ok=True)
    for name, text in test_ingest.NOTES.items():
        if names is None or name in names:
            with open(folder / name, "w", encoding="utf-8", newline="") as f:
                f.write(text)
    return folder


def _content(spark, root):
    d = ChatData.read(spark, root)
    names = d.conversations.select(F.col("id").alias("conversation_id"), F.regexp_extract("file_path", "[^/]*$", 0).alias("f"))
    return sorted((r.f, r.role, r.content) for r in d.messages.join(names, "conversation_id").collect())


def _daily_is_right(spark, root):
    from chatlake.operators import stats
    d = ChatData.read(spark, root)
    want = stats.daily_stats(d.messages, d.conversations).collect()
    assert sorted(map(str, d.daily_stats.select(*want[0].__fields__).collect())) == sorted(map(str, want))


def test_ingest_archive(spark, tmp_path):
    import test_ingest
    root, folder = str(tmp_path / "archive"), _notes(tmp_path, ["2024-01-02.org", "2024-02-30.org"])
    first = ingest_archive(spark, str(folder), root)
    assert (first.files, first.skipped, first.conversations) == (1, 0, 2)
    assert [os.path.basename(r.file_path) for r in first.rejected.collect()] == ["2024-02-30.org"]
    again = ingest_archive(spark, str(folder), root)
    assert (again.files, again.skipped, again.messages) == (0, 1, 0)
    _notes(tmp_path)
    more = ingest_archive(spark, str(folder), root)
    assert (more.files, more.skipped, more.replaced) == (4, 1, 0)
    flat = sorted((name, role, text) for name, _, _, ms in test_ingest.EXPECTED for role, text in ms)
    assert _content(spark, root) == flat
    ids = [r.id for r in ChatData.read(spark, root).messages.orderBy("id").collect()]
    assert ids == list(range(1, len(flat) + 1))
    _daily_is_right(spark, root)
    # without dedupe all files are added again, and clear starts anew
    assert ingest_archive(spark, str(folder), root, dedupe=None).files == 5
    assert _content(spark, root) == sorted(flat * 2)
    _daily_is_right(spark, root)
    assert ingest_archive(spark, str(folder), root, clear=True).files == 5
    assert _content(spark, root) == flat
    _daily_is_right(spark, root)


def test_changed_file_replaces_its_conversations(spark, tmp_path):
    import test_ingest
    root, folder = str(tmp_path / "archive"), _notes(tmp_path)
    ingest_archive(spark, str(folder), root)
    old = ChatData.read(spark, root).conversations.where("file_path like '%notes.org'").first().id
    store.upsert_embeddings(spark, root, spark.createDataFrame(
        [(old, [1.0], "m", datetime.datetime(2024, 1, 1)), (10 ** 6, [2.0], "m", None)], schemas.EMBEDDINGS))
    (folder / "notes.org").write_text(test_ingest._note([("text", "* New\nq2\n"), ("resp", "a2\n"), ("text", "z\n")]))
    done = ingest_archive(spark, str(folder), root)
    assert (done.files, done.replaced, done.conversations) == (1, 1, 1)
    mine = [c[1:] for c in _content(spark, root) if c[0] == "notes.org"]
    assert mine == [("assistant", "a2"), ("user", "New\nq2"), ("user", "z")]
    assert [r.conversation_id for r in ChatData.read(spark, root).embeddings.collect()] == [10 ** 6]
    _daily_is_right(spark, root)


@pytest.mark.parametrize("at", range(1, 8))
def test_retry_after_a_crash_adds_nothing_twice(spark, tmp_path, monkeypatch, at):
    import test_ingest
    root, folder = str(tmp_path / "archive"), _notes(tmp_path)
    calls, rename = [], publish.Folder.rename

    def crash(self, a, b):
        calls.append(b)
        if len(calls) == at:
            raise OSError("lost")
        rename(self, a, b)

    monkeypatch.setattr(publish.Folder, "rename", crash)
    try:
        ingest_archive(spark, str(folder), root)
    except OSError:
        pass
    monkeypatch.setattr(publish.Folder, "rename", rename)
    ingest_archive(spark, str(folder), root)
    assert _content(spark, root) == sorted((name, role, text) for name, _, _, ms in test_ingest.EXPECTED for role, text in ms)
    _daily_is_right(spark, root)


def test_missing_tables_are_empty(spark):
    from chatlake.operators import summaries
    assert summaries.sentiment_counts(None).collect() == []
    assert [tuple(r) for r in summaries.summary_stats(None).collect()] == [("total", None, 0)]
    assert summaries.latest_summary(None).collect() == []
    assert summaries.get_summary(None, 1).collect() == []


def test_request_and_result_files(spark, tmp_path):
    """Request lines, and result lines of every faulty kind."""
    from chatlake.operators import derive
    reqs = spark.createDataFrame([("conv_1", "m", 5, "hi\n\"q\"")],
                                 "custom_id string, model string, max_tokens long, prompt string")
    derive.write_requests(reqs, str(tmp_path / "req"))
    line = [x for f in sorted((tmp_path / "req").glob("part*")) for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in line] == [{"custom_id": "conv_1", "params": {
        "model": "m", "max_tokens": 5, "messages": [{"role": "user", "content": "hi\n\"q\""}]}}]

    def result(i, text=None, rtype="succeeded", content=None):
        content = [{"type": "text", "text": text}] if content is None else content
        return json.dumps({"custom_id": i, "result": {"type": rtype, "message": {"content": content}}})

    item = '{"category": "wisdom", "title": "t", "summary": "s"%s}'
    good = "[" + item % "" + "]"
    lines = [result("conv_1", good), result("conv_2", content=[]), result("conv_3", rtype="errored"),
             result("conv_4", good + " and see [1]"), result("conv_5", good.replace('"', "'")),
             result("conv_6", f"[{item % ''}, 5, null, {item % ', \"confidence\": \"x\"'}]"),
             result("conv_7", "nope"), result("conv_8", good[:-1]), result("conv_x", good),
             result("conv_9", item % ""), result("conv_10", "[]"), result("conv_11", rtype="expired"),
             json.dumps({"custom_id": "conv_12", "result": {"type": "succeeded"}})]
    (tmp_path / "res.jsonl").write_text("\n".join(lines))
    rows, rejects, counters = derive.load_insights(derive.read_results(spark, str(tmp_path / "res.jsonl")), None)
    assert sorted(r.conversation_id for r in rows.collect()) == [1, 6]
    assert {r.confidence for r in rows.collect()} == {0.5}
    assert sorted((r.conversation_id or 0, -1 if r.pos is None else r.pos, r.reason) for r in rejects.collect()) == [
        (0, 0, "bad custom_id"), (4, -1, "not a JSON array"), (5, -1, "not a JSON array"),
        (6, 1, "item not an insight object"), (6, 2, "item not an insight object"), (6, 3, "bad confidence"),
        (7, -1, "not a JSON array"), (8, -1, "not a JSON array"), (9, -1, "not a JSON array")]
    assert counters.first().asDict() == {"succeeded": 11, "other": 1, "loaded": 2, "errors": 7, "rejected": 3}


def test_summary_results(spark, tmp_path):
    from chatlake.operators import derive
    texts = ['{"summary": "s", "key_topics": ["a"], "sentiment": "learning", "outcome": "ongoing"}', "{}", "nope",
             "{'summary': 's'}", '{"summary": "s"} or {"x": 1}', "[1, 2]", '{"summary": "s"', "```json\n{}\n```"]
    lines = [json.dumps({"custom_id": f"summary_{i}", "result": {"type": "succeeded", "message": {
        "content": [{"type": "text", "text": t}]}}}) for i, t in enumerate(texts)]
    (tmp_path / "res.jsonl").write_text("\n".join(lines))
    rows, rejects, counters = derive.load_summaries(derive.read_results(spark, str(tmp_path / "res.jsonl")))
    got = {r.conversation_id: (r.summary, r.key_topics, r.sentiment, r.outcome) for r in rows.collect()}
    assert got == {0: ("s", ["a"], "learning", "ongoing"), 1: ("", [], "unknown", "unknown"),
                   7: ("", [], "unknown", "unknown")}
    assert sorted(r.conversation_id for r in rejects.collect()) == [2, 3, 4, 5, 6]
    assert counters.first().asDict() == {"succeeded": 8, "other": 0, "loaded": 3, "errors": 5, "rejected": 0}


def test_vectors_of_other_widths_have_no_score(spark):
    from chatlake.operators import vectors
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 1.0])],
                               "conversation_id long, embedding array<float>")
    got = {r[0]: r[1] for r in vectors.similarity(df, [2.0, 0.0]).collect()}
    assert (got[1], got[2], got[3], got[4]) == (1.0, None, None, None)
    assert round(got[5], 6) == 0.707107
    blob = spark.createDataFrame([(bytearray(b"\x00\x00\x80?\x00\x00\x00@"),), (None,)], "b binary")
    assert [r[0] for r in blob.select(vectors.decode_float32(F.col("b"))).collect()] == [[1.0, 2.0], None]


def test_staged_tables_can_be_cleaned_up(spark, tmp_path, monkeypatch):
    from chatlake.plans import staging
    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path / "staged"))
    rows = staging.staged(spark.range(5), "numbers")
    assert rows.count() == 5 and len(os.listdir(tmp_path / "staged")) == 1
    assert staging.clean_up(spark) and not (tmp_path / "staged").exists()
    assert not staging.clean_up(spark)
