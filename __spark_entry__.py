"""

``entry(spark)`` runs the flagship query (daily usage statistics) on
sf0.001; ``queries()`` maps every implemented operator to a callable
``(spark, sf_dir) -> DataFrame`` over the fixture views of the supplied
tables; ``oracle_sql()`` gives the equivalent DuckDB SQL per key.
Array columns are returned as JSON text so both engines compare equal.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
# Workers of a session started after this import find the package as well.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from chatlake import fixtures  # noqa: E402
from chatlake.dataset import ChatData, read_table  # noqa: E402
from chatlake.functions import text as txt  # noqa: E402
from chatlake.functions.replies import once, parse_insight, parse_insight_items  # noqa: E402
from chatlake.operators import browse, derive, screens, stats, summaries, vectors  # noqa: E402
from chatlake.operators import render, store  # noqa: E402
from chatlake.operators.export import export_conversations, export_to_path  # noqa: E402
from chatlake.operators.ingest import ingest_archive  # noqa: E402
from chatlake.plans.staging import staging_root  # noqa: E402
from chatlake.sources import history_csv, org_notes  # noqa: E402

FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _json_arrays(df: DataFrame) -> DataFrame:
    """Array columns as JSON text (the reference stores them that way)."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _data(spark, sf_dir):
    return fixtures.fixture_data(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    d = _data(spark, FLAGSHIP_DIR)
    return stats.daily_stats(d.messages, d.conversations)


def _daily(d):
    return stats.daily_stats(d.messages, d.conversations)


class _Archive:
    """The tables of ``_data``, written when a query first asks for one of them."""

    def __init__(self, spark, sf_dir):
        self._of = spark, sf_dir

    def __getattr__(self, name):
        return getattr(_data(*self._of), name)


def _q(fn):
    """Wrap ``fn(data, spark, sf_dir)`` into the driver's ``(spark, sf_dir)`` shape."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _json_arrays(fn(_Archive(spark, sf_dir), spark, sf_dir))
    return run


def _marked(spark, sf_dir):
    return fixtures.marked(fixtures.raw(spark, sf_dir, "conversations"))


def _replies(spark, sf_dir):
    return fixtures.replies(fixtures.raw(spark, sf_dir, "documents"), fixtures.raw(spark, sf_dir, "conversations"))


def _summary_replies(spark, sf_dir):
    return fixtures.summary_replies(fixtures.raw(spark, sf_dir, "documents"),
                                    fixtures.raw(spark, sf_dir, "conversations"))


def _parse_insight_json(d, spark, sf_dir):
    reply = F.try_element_at(F.col("result.message.content"), F.lit(1))["text"]
    done = _replies(spark, sf_dir).where("result.type = 'succeeded'")
    r = parse_insight_items(done.select("custom_id", reply.alias("reply")))
    items = once(r.select("custom_id", F.explode("items").alias("i")), "item", parse_insight(F.col("i")))
    items = items.where("item is not null")
    return items.select("custom_id", "item.category", "item.title", "item.summary", "item.tags",
                        F.col("item.confidence").try_cast("double").alias("confidence"))


def _insights(d, spark, sf_dir):
    return derive.load_insights(_replies(spark, sf_dir), d.messages, extracted_at="2024-02-02 00:00:00")


def _summaries(d, spark, sf_dir):
    return derive.load_summaries(_summary_replies(spark, sf_dir), summarized_at="2024-02-02 00:00:00")


def _load_counters(d, spark, sf_dir):
    kinds = [c.select(F.lit(k).alias("kind"), "*") for k, c in (
        ("insights", _insights(d, spark, sf_dir)[2]), ("summaries", _summaries(d, spark, sf_dir)[2]))]
    return kinds[0].unionByName(kinds[1])


def _upsert_summaries(d, spark, sf_dir):
    """Stored summaries after loading replies that are older than all of them; the last reply of each conversation stays."""
    from chatlake.session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/chatlake-upsert-{uuid.uuid4().hex}"
    d.summaries.write.parquet(f"{root}/summaries")
    rows = derive.load_summaries(_summary_replies(spark, sf_dir), summarized_at="2020-01-01 00:00:00")[0]
    store.upsert_summaries(spark, root, rows, input_order=["line_no"])
    return read_table(spark, root, "summaries")


def _conversation_topics(d, spark, sf_dir):
    m = d.messages
    first_user = F.min(F.when(F.col("role") == "user", F.struct("id", "content")))
    return (m.groupBy("conversation_id").agg(first_user.alias("fu"))
            .select("conversation_id", txt.topic_from_text(F.col("fu.content")).alias("topic")))


def _semantic(d, spark, sf_dir):
    q = vectors.query_vector(d.embeddings, 0)
    return vectors.semantic_search(d.embeddings, d.conversations, d.summaries, q, limit=20)


def _embed(d, spark, sf_dir):
    """New vectors as rows (conversation, position, value) of their non-zero components."""
    rows, _ = vectors.embed_conversations(d.conversations, d.messages, d.summaries, d.embeddings,
                                          vectors.hashed_token_encoder(64), chunk=1000)
    return (rows.select("conversation_id", "model", F.posexplode("embedding").alias("position", "v"))
            .where("v <> 0").select("conversation_id", "model", "position", F.round(F.col("v").cast("double"), 4)
                                    .alias("value")))


def _keyword_index(d, spark, sf_dir):
    """The rows of ``keyword_search`` over an indexed table."""
    root = f"{staging_root(spark)}/indexed-{uuid.uuid4().hex}"
    store.upsert_summaries(spark, root, d.summaries, index=True)
    return summaries.keyword_search_indexed(spark, root, d.conversations, "src1", 50)


def _token_counts_bpe(d, spark, sf_dir):
    import public_tokenizers as P
    return derive.token_counts(d.messages, counter=derive.rank_file_counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


def _search_text(d, spark, sf_dir):
    return vectors.search_text(d.embeddings, d.conversations, d.summaries, "how to index a table",
                               vectors.hashed_token_encoder(64), limit=20)


def _csv_history_rows(d, spark, sf_dir):
    export = fixtures.history_export(fixtures.raw(spark, sf_dir, "conversations"))
    rows = history_csv.history_rows(export, keep=["conv_id", "turn"])
    return (rows.select("conv_id", "turn", "ts", "day", "topic",
                        F.posexplode("messages").alias("position", "m"))
            .select("conv_id", "turn", "ts", "day", "topic", "position",
                    F.col("m.role").alias("role"), F.col("m.content").alias("content")))


def _csv_file_rows(d, spark, sf_dir):
    """V12 read from its files, as ``csv_history_rows`` reads the table."""
    export = history_csv.read_history_csv(spark, fixtures.history_files(fixtures.raw(spark, sf_dir, "conversations")))
    rows = history_csv.history_rows(export, keep=["Row"])
    key = F.split("Row", ":")
    return (rows.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "ts", "day", "topic",
                        F.posexplode("messages").alias("position", "m"))
            .select("conv_id", "turn", "ts", "day", "topic", "position",
                    F.col("m.role").alias("role"), F.col("m.content").alias("content")))


def _notes(spark, sf_dir):
    return org_notes.stage_notes(fixtures.note_files(fixtures.raw(spark, sf_dir, "conversations")))


def _note_messages(d, spark, sf_dir):
    files = fixtures.note_files(fixtures.raw(spark, sf_dir, "conversations"))
    convs, msgs, _ = org_notes.ingest_texts(files)
    meta = convs.select(F.col("id").alias("conversation_id"), "file_path", "date", "topic", "model", "system_prompt")
    return msgs.join(meta, "conversation_id")


def _scratch(spark, name):
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def _note_folder(spark, sf_dir):
    """The note files of V10 written to a folder, one real file each."""
    files = fixtures.note_files(fixtures.raw(spark, sf_dir, "conversations"))
    zero = F.lit(0).cast("long")
    chunks = files.select(F.regexp_replace("file_path", "^notes/", "").alias("file"), zero.alias("part"), zero.alias("k1"),
                          zero.alias("k2"), F.col("content").alias("chunk"))
    folder = _scratch(spark, "notes")
    render.write_note_files(chunks, folder)
    return folder


def _note_file_messages(d, spark, sf_dir):
    """``note_messages`` from files on disk."""
    convs, msgs, _ = org_notes.ingest_notes(spark, _note_folder(spark, sf_dir))
    name = F.concat(F.lit("notes/"), F.regexp_extract("file_path", "[^/]*$", 0)).alias("file_path")
    meta = convs.select(F.col("id").alias("conversation_id"), name, "date", "topic", "model", "system_prompt")
    return msgs.join(meta, "conversation_id")


def _ingested_daily(d, spark, sf_dir):
    """Daily table of an archive that was filled by two calls, the second one finding nothing new."""
    folder, root = _note_folder(spark, sf_dir), _scratch(spark, "archive")
    ingest_archive(spark, folder, root)
    ingest_archive(spark, folder, root)
    return read_table(spark, root, "daily_stats")


def _upsert_embeddings(d, spark, sf_dir):
    """Vectors after those of odd conversations have been replaced by ones of a later model."""
    root = _scratch(spark, "embeddings")
    store.upsert_embeddings(spark, root, d.embeddings)
    later = d.embeddings.where("conversation_id % 2 = 1").select(
        "conversation_id", F.slice("embedding", 1, 4).alias("embedding"), F.lit("later").alias("model"), "created_at")
    store.upsert_embeddings(spark, root, later)
    return read_table(spark, root, "embeddings").select("conversation_id", "model", "created_at", F.posexplode("embedding")
                                                        .alias("position", "value"))


def _decoded_embeddings(d, spark, sf_dir):
    """Vectors as stored bytes (little-endian float32) and back."""
    stored = d.embeddings.select("conversation_id", vectors.encode_float32(F.col("embedding")).alias("blob"))
    return stored.select("conversation_id", F.octet_length("blob").cast("long").alias("n_bytes"),
                         F.posexplode(vectors.decode_float32(F.col("blob"))).alias("position", "value"))


def _request_files(d, spark, sf_dir):
    """Request lines written as JSON files and read back."""
    path = _scratch(spark, "requests")
    derive.write_requests(derive.summary_requests(d.conversations, d.messages, d.summaries, 4), path)
    lines = spark.read.schema("custom_id string, params struct<model:string,max_tokens:long,"
                              "messages:array<struct<role:string,content:string>>>").json(path)
    return lines.select("custom_id", "params.model", "params.max_tokens", F.col("params.messages")[0]["content"].alias("prompt"))


def _export_deep(d, spark, sf_dir):
    """Deepest conversations of a written export, which has no messages."""
    path = _scratch(spark, "export")
    export_to_path(d, path)
    out = ChatData.read(spark, path)
    assert out.is_export
    return browse.deep_conversations(out.conversations, out.messages, 20)


def _rendered_offsets(d, spark, sf_dir):
    """Bounds of day files that hold all conversations of a day."""
    topics = d.conversations.select(F.col("id").alias("conversation_id"), "file_path", "topic")
    msgs = d.messages.join(topics, "conversation_id")
    _, places = render.placed_pieces(msgs, "file_path", ["conversation_id"], "id")
    return render.rendered_offsets(places).select("file", F.col("_pos").alias("position"), "s", "e")


def _notes_roundtrip(d, spark, sf_dir):
    chunks = render.render_chunks(fixtures.note_messages(d), "file", ["conversation_id"], "id")
    texts = render.note_texts(chunks).select(F.col("file").alias("file_path"), "content")
    convs, msgs, _ = org_notes.ingest_texts(texts)
    meta = convs.select(F.col("id").alias("conversation_id"), "file_path", "date", "topic")
    return msgs.join(meta, "conversation_id")


def _latest(d, spark, sf_dir):
    return summaries.latest_summary(fixtures.summary_versions(
        fixtures.raw(spark, sf_dir, "documents"), fixtures.raw(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable] = {
    # usage statistics
    "daily_stats": lambda d, s, p: _daily(d),
    "usage_summary": lambda d, s, p: stats.usage_summary(_daily(d)),
    "top_days": lambda d, s, p: stats.top_days(_daily(d), 10),
    "model_distribution": lambda d, s, p: stats.model_distribution(d.messages, d.conversations),
    "topic_distribution": lambda d, s, p: stats.topic_distribution(d.conversations, 20),
    "histogram_month": lambda d, s, p: stats.histogram(_daily(d), "month", "tokens"),
    "histogram_week": lambda d, s, p: stats.histogram(_daily(d), "week", "messages"),
    "histogram_conversations": lambda d, s, p: stats.histogram(_daily(d), "month", "conversations"),
    "daily_rows": lambda d, s, p: stats.read_daily_stats(_daily(d)),
    "histogram_scaled": lambda d, s, p: stats.histogram_scaled(
        stats.histogram(_daily(d), "month", "tokens"), 40),
    "table_counts": lambda d, s, p: stats.table_counts(d.conversations, d.messages),
    # browse: filters, joins, rankings
    "messages_by_date": lambda d, s, p: browse.messages_with_conversation(
        d.messages, d.conversations, date="2024-01-05"),
    "messages_with_conversation": lambda d, s, p: browse.messages_with_conversation(
        d.messages, d.conversations),
    "insights_by_category": lambda d, s, p: browse.insights_filtered(d.insights,
                                                                     category="wisdom"),
    "insights_by_tag": lambda d, s, p: browse.insights_filtered(d.insights, tag="SRC1"),
    "insights_tag_and_category": lambda d, s, p: browse.insights_filtered(
        d.insights, tag="fr", category="question", limit=20),
    "insights_top": lambda d, s, p: browse.insights_filtered(d.insights, limit=20),
    "insights_bottom": lambda d, s, p: browse.insights_filtered(d.insights, ascending=True,
                                                                limit=20),
    "random_insight": lambda d, s, p: browse.random_insight(d.insights, seed=7),
    "conversation_messages": lambda d, s, p: browse.conversation_messages(d.messages),
    "deep_conversations": lambda d, s, p: browse.deep_conversations(d.conversations,
                                                                    d.messages, 20),
    "conversation_detail": lambda d, s, p: browse.conversation_detail(d.conversations,
                                                                      d.messages),
    "insight_context": lambda d, s, p: browse.insight_context(d.insights, d.messages,
                                                              d.conversations),
    "export_insights": lambda d, s, p: browse.insights_to_conversation(d.insights, d.messages),
    "export_conversations": lambda d, s, p: export_conversations(d.conversations, d.messages),
    "unextracted_conversations": lambda d, s, p: browse.unextracted_conversations(
        d.conversations, d.insights, d.messages),
    "unsummarized_conversations": lambda d, s, p: browse.unsummarized_conversations(
        d.conversations, d.messages, d.summaries, 4),
    "unembedded_conversations": lambda d, s, p: browse.unembedded_conversations(
        d.conversations, d.embeddings),
    "conversation_insights": lambda d, s, p: browse.conversation_insights(d.insights,
                                                                          d.messages),
    "first_message": lambda d, s, p: browse.first_message(d.messages),
    "tag_counts": lambda d, s, p: browse.tag_counts(d.insights, 50),
    "unique_tags": lambda d, s, p: browse.unique_tag_total(d.insights),
    "conversation_preview": lambda d, s, p: browse.conversation_preview(d.messages, 6, 200),
    # datasets of the detail screens
    "insight_list": lambda d, s, p: screens.insight_list(d.insights, category="wisdom"),
    "insight_detail": lambda d, s, p: screens.insight_detail(d.insights, d.messages, d.conversations),
    "deep_list": lambda d, s, p: screens.deep_list(d.conversations, d.messages),
    "summary_list": lambda d, s, p: screens.summary_list(d.summaries, d.conversations, d.messages, sentiment="technical"),
    "conversation_screen": lambda d, s, p: screens.conversation_screen(d.conversations, d.messages, d.summaries, d.insights),
    # summaries
    "sentiment_counts": lambda d, s, p: summaries.sentiment_counts(d.summaries),
    "outcome_counts": lambda d, s, p: summaries.outcome_counts(d.summaries),
    "one_summary": lambda d, s, p: summaries.get_summary(d.summaries, 25),
    "summary_stats": lambda d, s, p: summaries.summary_stats(d.summaries),
    "summaries_filtered": lambda d, s, p: summaries.summaries_filtered(
        d.summaries, d.conversations, d.messages, outcome="resolved", limit=20),
    "keyword_search": lambda d, s, p: summaries.keyword_search(d.summaries, d.conversations,
                                                               "src1", 50),
    "keyword_search_indexed": _keyword_index,
    "latest_summary": _latest,
    # text and derived facts
    "clean_markup": lambda d, s, p: _marked(s, p).select(
        "id", txt.strip_org_formatting(F.col("text")).alias("text")),
    "escape_headlines": lambda d, s, p: _marked(s, p).select(
        "id", txt.escape_org_headlines(F.col("text")).alias("text")),
    "conversation_topics": _conversation_topics,
    "conversation_text": lambda d, s, p: derive.conversation_text(d.messages),
    "parse_insight_json": _parse_insight_json,
    "load_insights": lambda d, s, p: _insights(d, s, p)[0],
    "load_rejects": lambda d, s, p: _insights(d, s, p)[1].drop("reply"),
    "load_summaries": lambda d, s, p: _summaries(d, s, p)[0].drop("id", "line_no"),
    "load_summary_rejects": lambda d, s, p: _summaries(d, s, p)[1],
    "load_counters": _load_counters,
    "upsert_summaries": _upsert_summaries,
    "extract_requests": lambda d, s, p: derive.extract_requests(d.conversations, d.messages,
                                                                d.insights),
    "extract_requests_cut": lambda d, s, p: derive.extract_requests(
        d.conversations, d.messages, d.insights, cut=300, min_text=0),
    "extract_requests_whole": lambda d, s, p: derive.extract_requests(
        d.conversations, d.messages, d.insights, cut=None, min_text=0),
    "summary_requests": lambda d, s, p: derive.summary_requests(d.conversations, d.messages,
                                                                d.summaries, 4),
    "embedding_text": lambda d, s, p: derive.embedding_text(d.conversations, d.summaries,
                                                            d.messages),
    "token_counts": lambda d, s, p: derive.token_counts(d.messages),
    "token_counts_bpe": _token_counts_bpe,
    # ingest: the two input formats, derived from the conversations table
    "csv_history_rows": _csv_history_rows,
    "csv_file_rows": _csv_file_rows,
    "note_sections": lambda d, s, p: org_notes.note_sections(_notes(s, p)),
    "note_bounds": lambda d, s, p: org_notes.note_bounds(_notes(s, p)),
    "note_messages": _note_messages,
    "note_file_messages": _note_file_messages,
    "ingested_daily": _ingested_daily,
    "note_rejects": lambda d, s, p: org_notes.ingest_texts(fixtures.note_files(fixtures.raw(s, p, "conversations")))[2],
    "markdown_to_org": lambda d, s, p: fixtures.markdown(fixtures.raw(s, p, "conversations")).select(
        "id", render.markdown_to_org(F.col("text")).alias("text")),
    "rendered_offsets": _rendered_offsets,
    "notes_roundtrip": _notes_roundtrip,
    # stored forms
    "upsert_embeddings": _upsert_embeddings,
    "decoded_embeddings": _decoded_embeddings,
    "request_files": _request_files,
    "export_deep": _export_deep,
    "one_conversation": lambda d, s, p: browse.conversation_detail(d.conversations, d.messages, 3),
    # vectors
    "semantic_search": _semantic,
    "semantic_search_text": _search_text,
    "embed_hashed": _embed,
}


def _llm() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and oracles of the llm subpackage, or nothing where it is absent."""
    found, oracles = {}, {}
    try:
        from chatlake.llm.queries import ORACLES, QUERIES as LLM_QUERIES
        found.update(LLM_QUERIES)
        oracles.update(ORACLES)
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name is None or not e.name.startswith(("chatlake.llm", "corpus_pipeline")):
            raise
    else:
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _q(fn) for k, fn in QUERIES.items()} | _llm()[0]


def oracle_sql() -> dict[str, str]:
    from oracles import oracle_sql as _oracles
    q = _oracles()
    return {k: v for k, v in q.items() if k in QUERIES} | _llm()[1]
