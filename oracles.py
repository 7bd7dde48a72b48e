"""DuckDB oracle SQL for every key of ``__spark_entry__.queries()``.

Each statement first rebuilds the fixture views (FIXTURES.md section 2)
from the raw tables with the same formulas as ``chatlake.fixtures``, then
states the operator in plain SQL.  Rules: integer sums are cast to
BIGINT, NULL order is spelled out, every limit has an id tie key, arrays
are compared as JSON text.
"""

from __future__ import annotations

from chatlake.functions import prompts

V = {}
V["msg"] = """msg AS (
  SELECT conv_id * 100 + turn + 1 AS id, conv_id AS conversation_id, role, text AS content,
         CAST(NULL AS INTEGER) AS char_start, CAST(NULL AS INTEGER) AS char_end,
         CASE WHEN (conv_id * 100 + turn + 1) % 11 = 0 THEN NULL WHEN (conv_id * 100 + turn + 1) % 13 = 0 THEN 0
              ELSE CAST(length(text) // 4 AS BIGINT) END AS token_count
  FROM conversations WHERE role IN ('user', 'assistant'))"""
V["conv"] = r"""conv AS (
  SELECT conv_id AS id,
         'notes/' || coalesce(CAST(d AS VARCHAR), 'undated') || '.org' AS file_path,
         d AS date,
         coalesce(CASE WHEN length(fl) > 60 THEN substr(fl, 1, 57) || '...' ELSE fl END,
                  'Conversation') AS topic,
         model, system_prompt, TIMESTAMP '2024-03-01 00:00:00' AS created_at
  FROM (
    SELECT conv_id,
           CASE WHEN conv_id % 17 = 0 THEN NULL
                ELSE DATE '2024-01-01' + CAST(conv_id % 60 AS INTEGER) END AS d,
           CASE conv_id % 4 WHEN 1 THEN 'model-a' WHEN 2 THEN 'model-b'
                            WHEN 3 THEN 'model-c' END AS model,
           arg_min(text, turn) FILTER (WHERE role = 'system') AS system_prompt,
           regexp_replace(split_part(arg_min(text, turn) FILTER (WHERE role = 'user'), chr(10), 1),
                          '^\s+|\s+$', '', 'g') AS fl
    FROM conversations GROUP BY conv_id))"""
_TAGS = """CASE WHEN doc_id % 13 = 0 THEN NULL
              WHEN doc_id % 10 = 0 THEN CAST([] AS VARCHAR[])
              ELSE [lang, source] END"""
V["docs"] = """docs AS (
  SELECT *, CASE WHEN doc_id % 10 = 7 THEN 1 ELSE doc_id % (SELECT max(conv_id) + 1 FROM conversations) END AS conv
  FROM documents)"""
V["ins"] = V["docs"] + f""",
ins AS (
  SELECT doc_id AS id,
         CASE WHEN conv % 5 = 0 THEN NULL ELSE conv * 100 + 2 END AS message_id,
         CASE doc_id % 4 WHEN 0 THEN 'wisdom' WHEN 1 THEN 'product_idea'
                         WHEN 2 THEN 'programming_tip' ELSE 'question' END AS category,
         split_part(text, chr(10), 1) AS title, text AS summary,
         {_TAGS} AS tags,
         CAST(n_chars % 101 AS DOUBLE) / 100.0 AS confidence,
         TIMESTAMP '2024-02-01 00:00:00' AS extracted_at
  FROM docs)"""
_CONV = "CASE WHEN doc_id % 10 = 7 THEN 1 ELSE doc_id % (SELECT max(conv_id) + 1 FROM conversations) END"
V["versions"] = f"""versions AS (
  SELECT doc_id AS id, conversation_id, text AS summary,
         {_TAGS} AS key_topics,
         CASE (doc_id // 2) % 9 WHEN 0 THEN 'technical' WHEN 1 THEN 'exploratory'
              WHEN 2 THEN 'debugging' WHEN 3 THEN 'learning' WHEN 4 THEN 'planning'
              WHEN 5 THEN 'creative' WHEN 6 THEN 'frustrated' WHEN 7 THEN 'collaborative' END
           AS sentiment,
         CASE (doc_id // 3) % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ongoing'
              WHEN 2 THEN 'abandoned' WHEN 3 THEN 'learning' WHEN 4 THEN 'decision_made'
              ELSE 'idea_generated' END AS outcome,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS summarized_at
  FROM (SELECT *, {_CONV} AS conversation_id FROM documents)
  WHERE doc_id % 3 <> 0 AND conversation_id % 7 <> 2)"""
V["summ"] = V["versions"] + """,
summ AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) = 1)"""
V["emb"] = """emb AS (
  SELECT conversation_id, arg_max(embedding, vec_id) AS embedding
  FROM (SELECT *, CASE WHEN vec_id % 50 = 49 THEN vec_id + 1000000
                       ELSE vec_id % (SELECT max(conv_id) + 1 FROM conversations) END AS conversation_id FROM embeddings)
  WHERE conversation_id % 7 <> 3 GROUP BY conversation_id)"""
V["daily"] = """daily AS (
  SELECT c.date,
         CAST(count(*) AS BIGINT) AS total_messages,
         CAST(sum(CASE WHEN m.role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_messages,
         CAST(sum(CASE WHEN m.role = 'user' THEN 0 ELSE 1 END) AS BIGINT) AS assistant_messages,
         CAST(sum(CASE WHEN m.role = 'user'
                  THEN coalesce(nullif(m.token_count, 0), length(m.content) // 4) ELSE 0 END)
              AS BIGINT) AS user_tokens,
         CAST(sum(CASE WHEN m.role = 'user' THEN 0
                  ELSE coalesce(nullif(m.token_count, 0), length(m.content) // 4) END)
              AS BIGINT) AS assistant_tokens,
         CAST(count(DISTINCT m.conversation_id) AS BIGINT) AS conversation_count
  FROM msg m JOIN conv c ON m.conversation_id = c.id
  WHERE c.date IS NOT NULL GROUP BY c.date)"""
V["convtext"] = """convtext AS (
  SELECT conversation_id,
         string_agg('[' || CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END || ']'
                    || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY id) AS text
  FROM msg GROUP BY conversation_id)"""
# The text of conversations with a summary; those without have the text of convtext.
V["embtext"] = V["convtext"] + """,
embtext AS (
  SELECT c.id AS conversation_id,
         CASE WHEN length(s.summary) > 0
              THEN concat_ws('. ', nullif(c.topic, ''), s.summary,
                             CASE WHEN s.key_topics IS NOT NULL
                                  THEN 'Topics: ' || array_to_string(s.key_topics, ', ') END)
              ELSE coalesce(t.text, '') END AS text
  FROM conv c LEFT JOIN summ s ON s.conversation_id = c.id
  LEFT JOIN convtext t ON t.conversation_id = c.id)"""
# The stand-in encoder's component of a token, and the text its query is made of.
_DIM = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64"
SEARCH_TEXT = "Represent this sentence for searching relevant passages: how to index a table"
V["extracted"] = """extracted AS (
  SELECT DISTINCT m.conversation_id AS id FROM ins i JOIN msg m ON i.message_id = m.id)"""
V["counts"] = """counts AS (
  SELECT conversation_id, CAST(count(id) AS BIGINT) AS message_count
  FROM msg GROUP BY conversation_id)"""
_V7_CATS = "CASE doc_id % 5 WHEN 0 THEN 'wisdom' WHEN 1 THEN 'product_idea' " \
           "WHEN 2 THEN 'programming_tip' WHEN 3 THEN 'question' ELSE 'trivia' END"
V["replies"] = V["docs"] + f""",
items AS (
  SELECT *, doc_id % 23 AS kind, {_V7_CATS} AS category, split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 101 AS DOUBLE) / 100.0 END AS confidence
  FROM docs),
replies AS (
  SELECT 'conv_' || CAST(conv AS VARCHAR) AS custom_id, conv AS conversation_id, *,
         kind NOT IN (1, 2, 9, 10) AS has_text, kind IN (3, 4, 6, 7, 8) AS unread
  FROM items)"""
V["sreplies"] = f"""sreplies AS (
  SELECT doc_id, {_CONV} AS conversation_id, doc_id % 23 AS kind, text, doc_id % 23 NOT IN (1, 2, 9, 10) AS has_text,
         doc_id % 23 IN (3, 4, 6, 7, 8) AS unread,
         CASE WHEN doc_id % 6 <> 0 THEN [lang, source] ELSE CAST([] AS VARCHAR[]) END AS key_topics,
         CASE WHEN doc_id % 4 <> 0 THEN 'learning' ELSE 'unknown' END AS sentiment,
         CASE WHEN doc_id % 5 <> 0 THEN 'resolved' ELSE 'unknown' END AS outcome
  FROM documents)"""


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(V[n] for n in names) + "\n"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template_sql(template: str, **slots: str) -> str:
    parts = []
    for kind, value in prompts.template_parts(template):
        if kind == "text":
            parts.append(" || ".join(
                _sql_str(seg) if seg else "chr(10)"
                for seg in _interleave_newlines(value)))
        else:
            parts.append(f"CAST({slots[value]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def _interleave_newlines(text: str) -> list[str]:
    """Split on newlines so SQL literals stay single-line: 'a\\nb' -> ['a','', 'b']."""
    out = []
    for i, seg in enumerate(text.split("\n")):
        if i:
            out.append("")
        if seg:
            out.append(seg)
    return out


def _requests_sql(kind: str, cut: int | None, min_text: int = 200) -> str:
    if kind == "extract":
        work = """SELECT c.* FROM conv c WHERE c.id NOT IN (SELECT id FROM extracted)"""
        views = ("msg", "conv", "ins", "extracted", "convtext")
        template, prefix, max_tokens = prompts.EXTRACTION_PROMPT, "conv_", 8196
        extra = {}
    else:
        work = """SELECT c.*, k.message_count FROM conv c JOIN counts k ON k.conversation_id = c.id
                  WHERE c.id NOT IN (SELECT conversation_id FROM summ) AND k.message_count >= 4"""
        views = ("msg", "conv", "summ", "counts", "convtext")
        template, prefix, max_tokens = prompts.SUMMARY_PROMPT, "summary_", 1024
        extra = {"message_count": "w.message_count"}
    slots = dict(topic="coalesce(nullif(w.topic, ''), 'Unknown')",
                 date="coalesce(CAST(w.date AS VARCHAR), 'Unknown')",
                 conversation="t.text" if cut is None else f"""CASE WHEN length(t.text) > {cut}
                     THEN substr(t.text, 1, {cut}) || chr(10) || '[TRUNCATED]' ELSE t.text END""",
                 **extra)
    return with_views(*views) + f"""
SELECT '{prefix}' || CAST(w.id AS VARCHAR) AS custom_id, CAST(NULL AS VARCHAR) AS model,
       CAST({max_tokens} AS BIGINT) AS max_tokens,
       {_template_sql(template, **slots)} AS prompt
FROM ({work}) w JOIN convtext t ON t.conversation_id = w.id
WHERE length(t.text) >= {min_text}"""


DEEP = """SELECT c.id, c.topic, c.date, c.model, c.file_path,
       CAST(count(m.id) AS BIGINT) AS message_count,
       CAST(sum(CASE WHEN m.role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_messages,
       CAST(sum(CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS assistant_messages,
       CAST(sum(CASE WHEN m.role = 'user' THEN m.token_count ELSE 0 END) AS BIGINT) AS user_tokens,
       CAST(sum(CASE WHEN m.role = 'assistant' THEN m.token_count ELSE 0 END) AS BIGINT)
         AS assistant_tokens,
       CAST(sum(m.token_count) AS BIGINT) AS total_tokens
FROM conv c JOIN msg m ON c.id = m.conversation_id
GROUP BY c.id, c.topic, c.date, c.model, c.file_path"""

INS_COLS = "i.id, i.message_id, i.category, i.title, i.summary, to_json(i.tags) AS tags, " \
           "i.confidence, i.extracted_at"

COS = """list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
         / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
            * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"""

MARKED = r"""marked AS (
  SELECT conv_id * 100 + turn + 1 AS id,
         '* Head ' || CAST(turn AS VARCHAR) || chr(10) || ':PROPERTIES:' || chr(10)
         || ':GPTEL_TOPIC: t' || CAST(turn AS VARCHAR) || chr(10) || ':END:' || chr(10)
         || text || chr(10) || '#+begin_src python' || chr(10) || 'print(1)' || chr(10)
         || '#+END_SRC' || chr(10) || 'see [[http://x][label]] and [[http://y]]'
         || chr(10) || chr(10) || chr(10) || chr(10) || '#+TITLE: t' || chr(10)
         || '#+RESULTS: r' || chr(10) || '@user hi' || chr(10) || '** sub' || chr(10)
         || '* star line' || chr(10) AS text
  FROM conversations WHERE role IN ('user', 'assistant'))"""

# The reference's clean-up chain in DuckDB's dialect (RE2): same steps, same order.
CLEAN = [
    (r"(?m)^\*+\s+", ""),
    (r"(?si)#\+begin_src.*?#\+end_src", ""),
    (r"(?si)#\+begin_quote.*?#\+end_quote", ""),
    (r"(?si)#\+begin_example.*?#\+end_example", ""),
    (r"#\+RESULTS:.*?\n", ""),
    (r"\[\[.*?\]\[?(.*?)\]?\]", r"\1"),
    (r"(?sm)^:PROPERTIES:.*?:END:\s*", ""),
    (r"(?m)^#\+.*$", ""),
    (r"@(user|assistant)\s*", ""),
    (r"\n{3,}", "\n\n"),
]


def _clean_sql(col: str) -> str:
    expr = col
    for pat, rep in CLEAN:
        expr = f"regexp_replace({expr}, {_sql_str(pat)}, {_sql_str(rep)}, 'g')"
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


# -- note files (V10): every offset follows from lengths, as the drawer's numbers have nine digits ----

V["note_pieces"] = r"""raw_pieces AS (
  SELECT conv_id AS c, conv_id * 100 + turn + 1 AS id, role = 'assistant' AS ai, text AS content,
         max(conv_id * 100 + turn + 1) OVER (PARTITION BY conv_id) AS last
  FROM conversations WHERE role IN ('user', 'assistant')),
pieces AS (
  SELECT c, id, ai, length(content) + CASE WHEN ai AND c % 4 = 1 AND id = last THEN 1 ELSE 0 END AS n,
         CASE WHEN ai THEN content || chr(10)
              ELSE '** ask' || chr(10) || content
                   || CASE WHEN c % 5 = 0 THEN chr(10) || 'see [[http://x][label]] now' || chr(10) || '#+begin_src a'
                      || chr(10) || 'x' || chr(10) || '#+END_SRC' || chr(10) || chr(10) || chr(10) || chr(10) || 'end'
                      ELSE '' END || chr(10) END AS piece
  FROM raw_pieces
  UNION ALL
  SELECT DISTINCT c, -1, false, 0,
         CASE WHEN c % 17 = 0 THEN ''
              ELSE '* Conv ' || c || chr(10) || CASE WHEN c % 3 = 0 THEN ':PROPERTIES:' || chr(10) || ':GPTEL_TOPIC: t'
                   || c || chr(10) || ':END:' || chr(10) ELSE '' END END
  FROM raw_pieces),
filed AS (
  SELECT *, 'notes/' || CASE WHEN c % 17 = 0 THEN 'undated' WHEN c % 60 = 59 THEN '2024-02-30'
              ELSE CAST(DATE '2024-01-01' + CAST(c % 60 AS INTEGER) AS VARCHAR) END || '.org' AS file_path
  FROM pieces),
placed AS (
  SELECT *, (CASE WHEN (c % 17 <> 0 AND c % 2 = 1)
                  THEN 61 + 24 * count(*) FILTER (ai) OVER f ELSE 65 + 22 * count(*) FILTER (ai) OVER f END)
            + coalesce(sum(length(piece)) OVER (PARTITION BY file_path ORDER BY c, id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM filed WINDOW f AS (PARTITION BY file_path)),
sections AS (
  SELECT file_path, c, dense_rank() OVER (PARTITION BY file_path ORDER BY c) AS k, min(off) AS start,
         max(off + length(piece)) AS stop, string_agg(piece, '' ORDER BY id) AS text
  FROM placed WHERE c % 17 <> 0 GROUP BY file_path, c
  UNION ALL
  SELECT file_path, NULL, 0, 0, max(off + length(piece)),
         repeat('-', min(off)::INTEGER) || string_agg(piece, '' ORDER BY c, id)
  FROM placed WHERE c % 17 = 0 GROUP BY file_path),
bounds AS (
  SELECT p.file_path, s.k, s.c, p.i, p.off + 1 - s.start AS s, p.off + p.n + 1 - s.start AS e, s.text
  FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY c, id) - 1 AS i FROM placed WHERE ai) p
  JOIN sections s ON s.file_path = p.file_path AND (s.k = 0 OR s.c = p.c)
  WHERE p.file_path <> 'notes/2024-02-30.org' AND (s.k = 0 OR p.off + p.n + 1 <= s.stop))"""
V["org"] = r"""org_lines AS (
  SELECT id, i, line, regexp_matches(line, '^\s*```') AS fence,
         count(*) FILTER (regexp_matches(line, '^\s*```')) OVER (PARTITION BY id ORDER BY i) AS fences
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM md)),
org AS (
  SELECT id, string_agg(CASE
           WHEN fence AND fences % 2 = 0 THEN '#+end_src'
           WHEN fence THEN rtrim('#+begin_src ' || trim(substr(trim(line), 4)))
           WHEN fences % 2 = 1 THEN line
           WHEN regexp_matches(line, '^#{1,6}\s') THEN
             repeat('*', length(regexp_extract(line, '^(#{1,6})\s', 1)) + 3) || ' '
             || regexp_extract(line, '^#{1,6}\s+(.*)$', 1)
           ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
                  '`([^`]+)`', '~\1~', 'g'), '\*\*(.+?)\*\*', '*\1*', 'g'),
                  '!\[([^\]]*)\]\(([^)]+)\)', '[[\2]]', 'g'), '\[([^\]]+)\]\(([^)]+)\)', '[[\2][\1]]', 'g')
           END, chr(10) ORDER BY i) AS text
  FROM org_lines GROUP BY id)"""


def _hist(period: str, metric: str) -> str:
    label = "strftime(date, '%Y-%m')" if period == "month" else "strftime(date, '%G-W%V')"
    value = {"messages": "total_messages", "conversations": "conversation_count",
             "tokens": "user_tokens + assistant_tokens"}[metric]
    return f"SELECT {label} AS label, CAST(sum({value}) AS BIGINT) AS value FROM daily GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    w = with_views
    q = {}
    q["daily_stats"] = w("msg", "conv", "daily") + "SELECT * FROM daily"
    q["usage_summary"] = w("msg", "conv", "daily") + """
SELECT CAST(count(*) AS BIGINT) AS total_days,
       CAST(coalesce(sum(total_messages), 0) AS BIGINT) AS total_messages,
       CAST(coalesce(sum(user_tokens), 0) AS BIGINT) AS total_user_tokens,
       CAST(coalesce(sum(assistant_tokens), 0) AS BIGINT) AS total_assistant_tokens,
       CAST(coalesce(sum(user_tokens), 0) + coalesce(sum(assistant_tokens), 0) AS BIGINT)
         AS total_tokens,
       CAST(coalesce(sum(conversation_count), 0) AS BIGINT) AS total_conversations,
       min(date) AS first_date, max(date) AS last_date,
       round(avg(total_messages), 6) AS avg_messages_per_day,
       (SELECT date FROM daily ORDER BY total_messages DESC, date ASC LIMIT 1) AS most_active_day,
       (SELECT total_messages FROM daily ORDER BY total_messages DESC, date ASC LIMIT 1)
         AS most_active_day_messages
FROM daily"""
    q["top_days"] = w("msg", "conv", "daily") + \
        "SELECT * FROM daily ORDER BY total_messages DESC, date ASC LIMIT 10"
    q["model_distribution"] = w("msg", "conv") + """
SELECT c.model, CAST(count(m.id) AS BIGINT) AS count
FROM msg m JOIN conv c ON m.conversation_id = c.id
WHERE c.model IS NOT NULL GROUP BY c.model"""
    q["topic_distribution"] = w("conv") + """
SELECT topic, CAST(count(*) AS BIGINT) AS count FROM conv WHERE topic IS NOT NULL
GROUP BY topic ORDER BY count DESC, topic ASC LIMIT 20"""
    q["histogram_month"] = w("msg", "conv", "daily") + _hist("month", "tokens")
    q["histogram_week"] = w("msg", "conv", "daily") + _hist("week", "messages")
    q["histogram_scaled"] = w("msg", "conv", "daily") + f"""
SELECT label, value, round(CAST(value AS DOUBLE) / max(value) OVER (), 6) AS share,
       CAST(floor(CAST(value AS DOUBLE) / max(value) OVER () * 40) AS BIGINT) AS bar
FROM ({_hist("month", "tokens")})"""
    q["table_counts"] = w("msg", "conv") + """
SELECT 'conversations' AS table_name, CAST(count(*) AS BIGINT) AS count FROM conv
UNION ALL SELECT 'messages', CAST(count(*) AS BIGINT) FROM msg"""
    q["messages_by_date"] = w("msg", "conv") + """
SELECT m.*, c.date, c.topic, c.model FROM msg m JOIN conv c ON m.conversation_id = c.id
WHERE c.date = DATE '2024-01-05'"""
    q["messages_with_conversation"] = w("msg", "conv") + """
SELECT m.*, c.date, c.topic, c.model FROM msg m JOIN conv c ON m.conversation_id = c.id"""
    q["insights_by_category"] = w("ins") + \
        f"SELECT {INS_COLS} FROM ins i WHERE i.category = 'wisdom'"
    q["insights_by_tag"] = w("ins") + f"""
SELECT {INS_COLS} FROM ins i
WHERE len(list_filter(i.tags, lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') = 'src1')) > 0"""
    q["insights_tag_and_category"] = w("ins") + f"""
SELECT {INS_COLS} FROM ins i
WHERE list_contains(i.tags, 'fr') AND i.category = 'question'
ORDER BY i.confidence DESC, i.id ASC LIMIT 20"""
    q["insights_top"] = w("ins") + \
        f"SELECT {INS_COLS} FROM ins i ORDER BY i.confidence DESC, i.id ASC LIMIT 20"
    q["insights_bottom"] = w("ins") + \
        f"SELECT {INS_COLS} FROM ins i ORDER BY i.confidence ASC, i.id ASC LIMIT 20"
    q["random_insight"] = w("ins") + \
        f"SELECT {INS_COLS} FROM ins i ORDER BY md5('7:' || CAST(i.id AS VARCHAR)), i.id LIMIT 1"
    q["conversation_messages"] = w("msg") + "SELECT * FROM msg"
    q["deep_conversations"] = w("msg", "conv") + DEEP + \
        "\nORDER BY message_count DESC, c.id ASC LIMIT 20"
    q["conversation_detail"] = w("msg", "conv") + """
SELECT c.*, k.message_count, k.user_messages, k.assistant_messages, k.total_tokens
FROM conv c JOIN (
  SELECT conversation_id, CAST(count(id) AS BIGINT) AS message_count,
         CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_messages,
         CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS assistant_messages,
         CAST(sum(token_count) AS BIGINT) AS total_tokens
  FROM msg GROUP BY conversation_id) k ON k.conversation_id = c.id"""
    q["insight_context"] = w("msg", "conv", "ins") + f"""
SELECT {INS_COLS}, m.role AS message_role, m.content AS message_content,
       c.id AS conversation_id, c.topic AS conversation_topic, c.date AS conversation_date,
       c.model AS conversation_model, c.file_path AS conversation_file
FROM ins i LEFT JOIN msg m ON i.message_id = m.id LEFT JOIN conv c ON m.conversation_id = c.id"""
    q["export_insights"] = w("msg", "ins") + """
SELECT i.id, m.conversation_id, i.category, i.title, i.summary, to_json(i.tags) AS tags,
       i.confidence, i.extracted_at
FROM ins i LEFT JOIN msg m ON i.message_id = m.id"""
    q["export_conversations"] = w("msg", "conv") + """
SELECT c.id, c.file_path, c.date, c.topic, c.model,
       CAST(count(m.id) AS BIGINT) AS message_count,
       CAST(coalesce(sum(CASE WHEN m.role = 'user' THEN 1 ELSE 0 END), 0) AS BIGINT) AS user_messages,
       CAST(coalesce(sum(CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END), 0) AS BIGINT)
         AS assistant_messages,
       CAST(sum(m.token_count) AS BIGINT) AS total_tokens
FROM conv c LEFT JOIN msg m ON c.id = m.conversation_id
GROUP BY c.id, c.file_path, c.date, c.topic, c.model"""
    q["unextracted_conversations"] = w("msg", "conv", "ins", "extracted") + """
SELECT c.* FROM conv c WHERE NOT EXISTS (SELECT 1 FROM extracted e WHERE e.id = c.id)"""
    q["unsummarized_conversations"] = w("msg", "conv", "summ", "counts") + """
SELECT c.*, k.message_count FROM conv c JOIN counts k ON k.conversation_id = c.id
WHERE NOT EXISTS (SELECT 1 FROM summ s WHERE s.conversation_id = c.id)
  AND k.message_count >= 4"""
    q["unembedded_conversations"] = w("conv", "emb") + """
SELECT c.id FROM conv c WHERE NOT EXISTS (SELECT 1 FROM emb e WHERE e.conversation_id = c.id)"""
    q["conversation_insights"] = w("msg", "ins") + f"""
SELECT {INS_COLS}, m.conversation_id,
       CAST(row_number() OVER (PARTITION BY m.conversation_id
                               ORDER BY i.confidence DESC, i.id ASC) AS INTEGER) AS rank
FROM ins i JOIN msg m ON i.message_id = m.id"""
    q["first_message"] = w("msg") + \
        "SELECT conversation_id, min(id) AS message_id FROM msg GROUP BY conversation_id"
    q["tag_counts"] = w("ins") + """
SELECT tag, CAST(count(*) AS BIGINT) AS count
FROM (SELECT unnest(tags) AS tag FROM ins WHERE tags IS NOT NULL AND len(tags) > 0)
GROUP BY tag ORDER BY count DESC, tag ASC LIMIT 50"""
    q["sentiment_counts"] = w("summ") + \
        "SELECT sentiment, CAST(count(*) AS BIGINT) AS count FROM summ GROUP BY sentiment"
    q["outcome_counts"] = w("summ") + \
        "SELECT outcome, CAST(count(*) AS BIGINT) AS count FROM summ GROUP BY outcome"
    q["summary_stats"] = w("summ") + """
SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count FROM summ
UNION ALL SELECT 'sentiment', sentiment, CAST(count(*) AS BIGINT) FROM summ GROUP BY sentiment
UNION ALL SELECT 'outcome', outcome, CAST(count(*) AS BIGINT) FROM summ GROUP BY outcome"""
    q["summaries_filtered"] = w("msg", "conv", "summ", "counts") + """
SELECT s.id, s.conversation_id, s.summary, to_json(s.key_topics) AS key_topics, s.sentiment,
       s.outcome, s.summarized_at, c.topic, c.date, c.model,
       CAST(coalesce(k.message_count, 0) AS BIGINT) AS message_count
FROM summ s JOIN conv c ON s.conversation_id = c.id
LEFT JOIN counts k ON k.conversation_id = c.id
WHERE s.outcome = 'resolved'
ORDER BY c.date DESC NULLS LAST, s.id ASC LIMIT 20"""
    q["keyword_search"] = w("conv", "summ") + """
SELECT c.id, c.topic, c.date, c.model, s.summary, to_json(s.key_topics) AS key_topics,
       s.sentiment, s.outcome
FROM conv c JOIN summ s ON c.id = s.conversation_id
WHERE contains(translate(s.summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'src1')
   OR len(list_filter(s.key_topics, lambda t: contains(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), 'src1'))) > 0
ORDER BY c.date DESC NULLS LAST, c.id ASC LIMIT 50"""
    q["latest_summary"] = w("versions") + """
SELECT id, conversation_id, summary, to_json(key_topics) AS key_topics, sentiment, outcome,
       summarized_at
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id
                                   ORDER BY summarized_at DESC, id DESC) AS rn FROM versions)
WHERE rn = 1"""
    q["conversation_preview"] = w("msg") + """
SELECT conversation_id, id, CAST(position AS INTEGER) AS position, role,
       CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END
         AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS position FROM msg)
WHERE position <= 6"""
    q["clean_markup"] = MARKED_WITH + f"SELECT id, {_clean_sql('text')} AS text FROM marked"
    q["escape_headlines"] = MARKED_WITH + \
        r"SELECT id, regexp_replace(text, '(?m)^\* ', '- ', 'g') AS text FROM marked"
    q["conversation_topics"] = w("msg") + r"""
SELECT conversation_id,
       coalesce(CASE WHEN length(fl) > 60 THEN substr(fl, 1, 57) || '...' ELSE fl END,
                'Conversation') AS topic
FROM (SELECT conversation_id,
             regexp_replace(split_part(arg_min(content, id) FILTER (WHERE role = 'user'),
                                       chr(10), 1), '^\s+|\s+$', '', 'g') AS fl
      FROM msg GROUP BY conversation_id)"""
    q["conversation_text"] = w("msg", "convtext") + "SELECT * FROM convtext"
    good = "has_text AND NOT unread"
    reason = """CASE WHEN unread THEN 'not a JSON array' ELSE 'bad category' END"""
    q["parse_insight_json"] = w("replies") + f"""
SELECT custom_id, category, title, text AS summary, to_json([lang, source]) AS tags, confidence
FROM replies WHERE {good}"""
    q["load_insights"] = w("msg", "replies") + f"""
SELECT f.message_id, p.conversation_id, category, title, text AS summary, to_json([lang, source]) AS tags,
       coalesce(confidence, 0.5) AS confidence, TIMESTAMP '2024-02-02 00:00:00' AS extracted_at
FROM replies p
LEFT JOIN (SELECT conversation_id, min(id) AS message_id FROM msg GROUP BY conversation_id) f
  ON f.conversation_id = p.conversation_id
WHERE {good} AND category <> 'trivia'"""
    q["load_rejects"] = w("replies") + f"""
SELECT conversation_id, CASE WHEN unread THEN NULL ELSE 0 END AS pos, {reason} AS reason
FROM replies WHERE has_text AND (unread OR category = 'trivia')
UNION ALL SELECT conversation_id, 1, 'item not an insight object' FROM replies WHERE kind = 5"""
    q["load_summaries"] = w("sreplies") + f"""
SELECT conversation_id, text AS summary, to_json(key_topics) AS key_topics, sentiment, outcome,
       TIMESTAMP '2024-02-02 00:00:00' AS summarized_at FROM sreplies WHERE {good}"""
    q["load_summary_rejects"] = w("sreplies") + """
, obj AS (
  SELECT *, '{' || concat_ws(',', '"summary":' || to_json(text),
         CASE WHEN len(key_topics) > 0 THEN '"key_topics":' || to_json(key_topics) END,
         CASE WHEN sentiment = 'learning' THEN '"sentiment":"learning"' END,
         CASE WHEN outcome = 'resolved' THEN '"outcome":"resolved"' END) || '}' AS o
  FROM sreplies)
SELECT conversation_id, '```json' || chr(10) || CASE kind WHEN 3 THEN o || ' or {}'
       WHEN 4 THEN '{''summary'': ''s''}' WHEN 6 THEN 'nope' WHEN 7 THEN '{"summary": "s"' ELSE '[1, 2]' END
       || chr(10) || '```' AS reply, 'not a JSON object' AS reason
FROM obj WHERE unread"""
    q["load_counters"] = w("replies", "sreplies") + """
SELECT 'insights' AS kind, count(*) FILTER (kind NOT IN (2, 10)) AS succeeded,
       count(*) FILTER (kind = 10) AS other,
       count(*) FILTER (has_text AND NOT unread AND category <> 'trivia') AS loaded,
       count(*) FILTER (kind = 2 OR unread) AS errors,
       count(*) FILTER (has_text AND NOT unread AND category = 'trivia') + count(*) FILTER (kind = 5) AS rejected
FROM replies
UNION ALL
SELECT 'summaries', count(*) FILTER (kind NOT IN (2, 10)), count(*) FILTER (kind = 10),
       count(*) FILTER (has_text AND NOT unread), count(*) FILTER (kind = 2 OR unread), 0
FROM sreplies"""
    q["upsert_summaries"] = w("summ", "sreplies") + f"""
, fresh AS (
  SELECT (SELECT max(id) FROM summ) + row_number() OVER (ORDER BY conversation_id) AS id, conversation_id,
         text AS summary, key_topics, sentiment, outcome, TIMESTAMP '2020-01-01 00:00:00' AS summarized_at
  FROM (SELECT * FROM sreplies WHERE {good}
        QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY doc_id DESC) = 1))
SELECT id, conversation_id, summary, to_json(key_topics) AS key_topics, sentiment, outcome, summarized_at
FROM (SELECT * FROM fresh UNION ALL
      SELECT * FROM summ WHERE conversation_id NOT IN (SELECT conversation_id FROM fresh))"""
    q["extract_requests"] = _requests_sql("extract", 50000)
    q["extract_requests_cut"] = _requests_sql("extract", 300, 0)
    q["extract_requests_whole"] = _requests_sql("extract", None, 0)
    q["summary_requests"] = _requests_sql("summary", 80000)
    q["histogram_conversations"] = w("msg", "conv", "daily") + _hist("month", "conversations")
    q["daily_rows"] = w("msg", "conv", "daily") + "SELECT * FROM daily"
    q["unique_tags"] = w("ins") + "SELECT count(DISTINCT tag) AS unique_tags FROM (SELECT unnest(tags) AS tag FROM ins)"
    q["one_summary"] = w("summ") + """
SELECT id, conversation_id, summary, to_json(key_topics) AS key_topics, sentiment, outcome, summarized_at
FROM summ WHERE conversation_id = 25"""
    q["embedding_text"] = w("msg", "conv", "summ", "embtext") + "SELECT * FROM embtext"
    q["embed_hashed"] = w("msg", "conv", "summ", "embtext", "emb") + f"""
, whole AS (
  SELECT conversation_id, text FROM embtext WHERE conversation_id IN (
    SELECT conversation_id FROM summ WHERE length(summary) > 0)
  UNION ALL
  SELECT conversation_id, '[' || CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END || ']' || chr(10)
         || coalesce(content, '') || chr(10) FROM msg
  WHERE conversation_id NOT IN (SELECT conversation_id FROM summ WHERE length(summary) > 0)),
pieces AS (
  SELECT conversation_id, row_number() OVER () AS piece, substr(text, CAST(k * 1000 + 1 AS BIGINT), 1000) AS text
  FROM (SELECT *, unnest(range(greatest((length(text) + 999) // 1000, 1))) AS k FROM whole)
  WHERE conversation_id NOT IN (SELECT conversation_id FROM emb)),
tok AS (
  SELECT conversation_id, length(text) AS weight, piece, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t
  FROM pieces WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
cnt AS (
  SELECT conversation_id, {_DIM} AS position, CAST(sum(weight) AS DOUBLE) AS n FROM tok WHERE t <> '' GROUP BY ALL)
SELECT conversation_id, 'hashed-64' AS model, CAST(position AS INTEGER) AS position,
       round(n / sqrt(sum(n * n) OVER (PARTITION BY conversation_id)), 4) AS value
FROM cnt"""
    q["token_counts"] = w("msg") + \
        "SELECT id, conversation_id, CAST(length(content) // 4 AS BIGINT) AS token_count FROM msg"
    q["semantic_search"] = w("conv", "summ", "emb") + f"""
SELECT top.conversation_id AS id, c.topic, c.date, c.model, s.summary,
       to_json(s.key_topics) AS key_topics, s.sentiment, s.outcome,
       round(top.sim, 6) AS similarity
FROM (SELECT e.conversation_id, {COS} AS sim
      FROM emb e, (SELECT embedding FROM emb WHERE conversation_id = 0 LIMIT 1) q
      WHERE {COS} IS NOT NULL AND NOT isnan({COS})
      ORDER BY sim DESC, e.conversation_id ASC LIMIT 20) top
JOIN conv c ON c.id = top.conversation_id
LEFT JOIN summ s ON s.conversation_id = top.conversation_id"""
    q["semantic_search_text"] = w("conv", "summ", "emb") + f"""
, tok AS (SELECT unnest(regexp_split_to_array(lower({_sql_str(SEARCH_TEXT)}), '\\s+')) AS t),
cnt AS (SELECT {_DIM} AS position, CAST(count(*) AS DOUBLE) AS n FROM tok GROUP BY ALL),
q AS (SELECT list(coalesce(n, 0.0) ORDER BY i) AS v FROM range(64) r(i) LEFT JOIN cnt ON cnt.position = i),
s AS (
  SELECT conversation_id, list_dot_product(CAST(embedding AS DOUBLE[]), v)
         / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
            * sqrt(list_dot_product(v, v))) AS sim
  FROM emb, q)
SELECT top.conversation_id AS id, c.topic, c.date, c.model, s.summary, to_json(s.key_topics) AS key_topics,
       s.sentiment, s.outcome, round(top.sim, 6) AS similarity
FROM (SELECT * FROM s WHERE sim IS NOT NULL AND NOT isnan(sim) ORDER BY sim DESC, conversation_id LIMIT 20) top
JOIN conv c ON c.id = top.conversation_id
LEFT JOIN summ s ON s.conversation_id = top.conversation_id"""
    q["csv_history_rows"] = r"""
WITH p AS (
  SELECT a.conv_id, a.turn, a.role AS r1, a.text AS t1, b.role AS r2, b.text AS t2
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE (a.conv_id + a.turn) % 11 <> 0),
d AS (
  SELECT *, make_timestamp(
           CASE WHEN (conv_id * 7 + turn) % 100 >= 69 THEN 1900 ELSE 2000 END
             + (conv_id * 7 + turn) % 100,
           conv_id % 12 + 1, conv_id % 28 + 1,
           ((conv_id + turn) % 12 + 1) % 12 + CASE WHEN (conv_id + turn) % 2 = 1 THEN 12 ELSE 0 END,
           (turn * 7) % 60, 0) AS ts,
         regexp_replace(split_part(CASE WHEN r1 = 'user' THEN t1 WHEN r2 = 'user' THEN t2 END,
                                   chr(10), 1), '^\s+|\s+$', '', 'g') AS fl
  FROM p),
m AS (
  SELECT conv_id, turn, ts, fl, 0 AS position, r1 AS r, t1 AS t FROM d
  UNION ALL
  SELECT conv_id, turn, ts, fl, 1 AS position, r2 AS r, t2 AS t FROM d)
SELECT conv_id, turn, ts, CAST(ts AS DATE) AS day,
       coalesce(CASE WHEN length(fl) > 60 THEN substr(fl, 1, 57) || '...' ELSE fl END,
                'Conversation') AS topic,
       position, CASE WHEN r = 'user' THEN 'user' ELSE 'assistant' END AS role,
       regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(^|\n)\* ', '\1- ', 'g') AS content
FROM m"""
    q["csv_file_rows"] = q["csv_history_rows"]
    pct = "CAST(round_even(confidence * 100, 0) AS INTEGER)"
    q["insight_list"] = w("ins") + f"""
SELECT CAST(rank AS INTEGER) AS rank, id, category, title, {pct} AS percent,
       CASE WHEN rank <= 5 THEN summary END AS summary, CASE WHEN rank <= 5 THEN to_json(tags) END AS tags
FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS rank FROM ins WHERE category = 'wisdom')
WHERE rank <= 20"""
    q["insight_detail"] = w("msg", "conv", "ins") + f"""
SELECT i.id, i.title, i.category, {pct} AS percent, i.summary, to_json(i.tags) AS tags, c.id AS conversation_id,
       coalesce(nullif(c.topic, ''), 'Unknown') AS conversation_topic,
       coalesce(CAST(c.date AS VARCHAR), 'Unknown') AS conversation_date,
       coalesce(nullif(c.model, ''), 'Unknown') AS conversation_model,
       coalesce(nullif(c.file_path, ''), 'Unknown') AS conversation_file, m.role AS message_role,
       CASE WHEN length(m.content) > 1500 THEN substr(m.content, 1, 1500) || chr(10) || '... [truncated]'
            ELSE m.content END AS message_content
FROM ins i LEFT JOIN msg m ON m.id = i.message_id LEFT JOIN conv c ON c.id = m.conversation_id"""
    per = """per AS (
  SELECT conversation_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user,
         count(*) FILTER (role = 'assistant') AS n_ai, CAST(sum(token_count) AS BIGINT) AS tokens
  FROM msg GROUP BY conversation_id)"""
    q["deep_list"] = w("msg", "conv") + f""", {per}
SELECT c.id, substr(coalesce(nullif(c.topic, ''), 'Unknown'), 1, 35) AS topic, coalesce(CAST(c.date AS VARCHAR), '') AS date,
       n AS message_count, n_user AS user_messages, n_ai AS assistant_messages, tokens AS total_tokens
FROM conv c JOIN per ON per.conversation_id = c.id ORDER BY n DESC, c.id LIMIT 20"""
    q["summary_list"] = w("msg", "conv", "summ") + f""", {per},
listed AS (
  SELECT s.*, c.date, c.topic, per.n, row_number() OVER (ORDER BY c.date DESC NULLS LAST, s.id) AS rank
  FROM summ s LEFT JOIN conv c ON c.id = s.conversation_id LEFT JOIN per ON per.conversation_id = s.conversation_id
  WHERE s.sentiment = 'technical')
SELECT CAST(rank AS INTEGER) AS rank, conversation_id, coalesce(CAST(date AS VARCHAR), '') AS date,
       substr(coalesce(nullif(topic, ''), 'Untitled'), 1, 30) AS topic, coalesce(sentiment, 'unknown') AS sentiment,
       coalesce(outcome, 'unknown') AS outcome, nullif(n, 0) AS message_count,
       CASE WHEN rank <= 5 THEN coalesce(nullif(topic, ''), 'Untitled') END AS whole_topic,
       CASE WHEN rank <= 5 THEN summary END AS summary, CASE WHEN rank <= 5 THEN to_json(key_topics) END AS key_topics
FROM listed WHERE rank <= 20"""
    q["conversation_screen"] = w("msg", "conv", "ins", "summ") + f""", {per},
owned AS (
  SELECT m.conversation_id, i.id, i.category, i.title, {pct} AS percent,
         row_number() OVER (PARTITION BY m.conversation_id ORDER BY i.confidence DESC, i.id) AS rank
  FROM ins i JOIN msg m ON m.id = i.message_id),
best AS (
  SELECT conversation_id, count(*) AS insight_count,
         to_json(list({{'id': id, 'category': category, 'title': title, 'percent': percent}} ORDER BY rank)
                 FILTER (rank <= 10)) AS insights
  FROM owned GROUP BY conversation_id),
heads AS (
  SELECT conversation_id, to_json(list({{'label': CASE WHEN role = 'user' THEN 'YOU' ELSE 'AI' END,
           'text': CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END}} ORDER BY id)) AS preview
  FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS no FROM msg) WHERE no <= 6
  GROUP BY conversation_id)
SELECT c.id AS conversation_id, coalesce(nullif(c.topic, ''), 'Untitled') AS topic,
       coalesce(CAST(c.date AS VARCHAR), 'Unknown') AS date, coalesce(nullif(c.model, ''), 'Unknown') AS model,
       coalesce(nullif(c.file_path, ''), 'Unknown') AS file_path, n AS message_count, n_user AS user_messages,
       n_ai AS assistant_messages, tokens AS total_tokens, s.summary, to_json(s.key_topics) AS key_topics, s.sentiment,
       s.outcome, b.insights, coalesce(b.insight_count, 0) AS insight_count, h.preview, greatest(n - 6, 0) AS more_messages
FROM conv c JOIN per ON per.conversation_id = c.id LEFT JOIN summ s ON s.conversation_id = c.id
LEFT JOIN best b ON b.conversation_id = c.id LEFT JOIN heads h ON h.conversation_id = c.id"""
    q["keyword_search_indexed"] = q["keyword_search"]
    q["note_sections"] = with_views("note_pieces") + """
SELECT file_path, CAST(k AS INTEGER) AS k, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
       CASE WHEN k = 0 THEN NULL WHEN c % 3 = 0 THEN 't' || c ELSE 'Conv ' || c END AS topic
FROM sections"""
    q["note_bounds"] = with_views("note_pieces") + """
SELECT file_path, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e
FROM bounds"""
    q["note_rejects"] = with_views("note_pieces") + """
SELECT DISTINCT file_path, 'impossible date in file name' AS reason FROM filed WHERE file_path = 'notes/2024-02-30.org'"""
    q["note_messages"] = with_views("note_pieces") + f""",
cuts AS (
  SELECT file_path, k, c, text, 2 * i AS j, 'user' AS role,
         coalesce(lag(e - 1) OVER (PARTITION BY file_path, k ORDER BY i), 0) AS a, s - 1 AS b FROM bounds
  UNION ALL
  SELECT file_path, k, c, text, 2 * i + 1, 'assistant', s - 1, e - 1 FROM bounds
  UNION ALL
  SELECT file_path, k, any_value(c), any_value(text), 2 * max(i) + 2, 'user', max(e) - 1, length(any_value(text))
  FROM bounds GROUP BY file_path, k),
cleaned AS (
  SELECT *, {_clean_sql("CASE WHEN k = 0 AND a = 0 THEN regexp_replace(substr(text, 1, CAST(b AS BIGINT)), '^-+', '') "
                        "ELSE substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) END")} AS content
  FROM cuts WHERE role = 'assistant' OR b > a),
kept AS (
  SELECT *, CAST(row_number() OVER (ORDER BY file_path, k, j) AS BIGINT) AS id,
         CAST(dense_rank() OVER (ORDER BY file_path, k) AS BIGINT) AS conversation_id
  FROM cleaned WHERE length(content) > 0)
SELECT id, conversation_id, role, content, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end,
       CAST(length(content) // 4 AS BIGINT) AS token_count, file_path,
       CASE WHEN k > 0 THEN CAST(substr(file_path, 7, 10) AS DATE) END AS date,
       CASE WHEN k = 0 THEN NULL WHEN c % 3 = 0 THEN 't' || c ELSE 'Conv ' || c END AS topic,
       CASE WHEN k = 0 OR c % 2 = 0 THEN 'm-1' END AS model, CASE WHEN k > 0 AND c % 2 = 1 THEN 'be brief' END AS system_prompt
FROM kept"""
    q["note_file_messages"] = q["note_messages"]
    q["ingested_daily"] = q["note_messages"].replace("SELECT id, conversation_id, role, content, CAST(a AS INTEGER)",
                                                     "SELECT id, conversation_id, role, content, c, k, CAST(a AS INTEGER)")
    head, tail = q["ingested_daily"].rsplit("SELECT id, conversation_id, role", 1)
    q["ingested_daily"] = head.rstrip() + """,
rows AS (SELECT id, conversation_id, role""" + tail + """)
SELECT date, count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages,
       count(*) FILTER (role <> 'user') AS assistant_messages,
       CAST(coalesce(sum(length(content) // 4) FILTER (role = 'user'), 0) AS BIGINT) AS user_tokens,
       CAST(coalesce(sum(length(content) // 4) FILTER (role <> 'user'), 0) AS BIGINT) AS assistant_tokens,
       count(DISTINCT conversation_id) AS conversation_count
FROM rows WHERE date IS NOT NULL GROUP BY date"""
    q["upsert_embeddings"] = w("emb") + """
SELECT conversation_id, CASE WHEN conversation_id % 2 = 1 THEN 'later' ELSE 'fixture' END AS model,
       TIMESTAMP '2024-03-01 00:00:00' AS created_at, CAST(i AS INTEGER) AS position, CAST(embedding[i + 1] AS FLOAT) AS value
FROM (SELECT *, unnest(range(CASE WHEN conversation_id % 2 = 1 THEN 4 ELSE len(embedding) END)) AS i FROM emb)"""
    q["decoded_embeddings"] = w("emb") + """
SELECT conversation_id, 4 * len(embedding) AS n_bytes, CAST(i AS INTEGER) AS position, CAST(embedding[i + 1] AS FLOAT) AS value
FROM (SELECT *, unnest(range(len(embedding))) AS i FROM emb)"""
    q["request_files"] = q["summary_requests"]
    q["export_deep"] = "SELECT id, topic, date, model, file_path, message_count, user_messages, assistant_messages, " \
        "total_tokens FROM (" + q["deep_conversations"] + ")"
    q["one_conversation"] = "SELECT * FROM (" + q["conversation_detail"] + ") WHERE id = 3"
    q["markdown_to_org"] = r"""WITH md AS (
  SELECT conv_id * 100 + turn + 1 AS id,
         repeat('#', CAST(turn % 7 AS INTEGER)) || ' Head **b** `c`' || chr(10) || text || chr(10) || '```py' || chr(10)
         || '# x `y` **z**' || chr(10) || CASE WHEN turn % 2 = 0 THEN '```' || chr(10) ELSE '' END
         || '`c` **d** ![p](u) [l](v) **e' || chr(10)
         || CASE WHEN turn % 3 = 0 THEN '  ``` ' || chr(10) ELSE '' END || '### T' || chr(10) || '`open **f** g' AS text
  FROM conversations WHERE role IN ('user', 'assistant')),
""" + V["org"] + "\nSELECT id, text FROM org"
    q["rendered_offsets"] = with_views("msg", "conv") + """,
md AS (SELECT id, content AS text FROM msg WHERE role = 'assistant'),
""" + V["org"] + r""",
lines AS (
  SELECT c.file_path AS file, c.id AS conv, m.id AS j, m.role <> 'user' AS ai, length(o.text) AS body,
         CASE WHEN m.role = 'user'
              THEN 6 + least(60, length(regexp_replace(split_part(m.content, chr(10), 1), '^\s+|\s+$', '', 'g')))
                   + length(m.content)
              ELSE 15 + length(o.text) END AS n
  FROM msg m JOIN conv c ON c.id = m.conversation_id LEFT JOIN org o ON o.id = m.id
  UNION ALL
  SELECT DISTINCT c.file_path, c.id, -1, false, NULL, 38 + 2 * length(c.topic)
  FROM conv c JOIN msg m ON m.conversation_id = c.id),
spans AS (
  SELECT file, position, off + 13 AS s, off + 13 + body AS e FROM (
    SELECT *, row_number() OVER w - 1 AS position,
           coalesce(sum(n) OVER (PARTITION BY file ORDER BY conv, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
    FROM lines WINDOW w AS (PARTITION BY file ORDER BY conv, j)) WHERE ai),
drawers AS (
  SELECT file, list_reduce(list_prepend(48::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]), lambda h, _:
           CAST(48 + 4 * n + list_sum(list_transform(ends, lambda p: length(CAST(p + h + 1 AS VARCHAR)))) AS BIGINT)) AS h
  FROM (SELECT file, count(*) AS n, list(s) || list(e) AS ends FROM spans GROUP BY file))
SELECT s.file, CAST(position AS BIGINT) AS position, CAST(s + h + 1 AS BIGINT) AS s, CAST(e + h + 1 AS BIGINT) AS e
FROM spans s JOIN drawers USING (file)"""
    return q


MARKED_WITH = "WITH " + MARKED + "\n"
