"""Note-file and CSV ingest, rendering and round trip: hand-made inputs, literal results, properties."""

import datetime
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from chatlake.operators import render
from chatlake.sources import history_csv as H
from chatlake.sources import org_notes as O


def _note(parts, drawer_extra="", old_format=False, eol="\n"):
    """Build a note text from (kind, text) parts; 'resp' parts become bounds.

    Returns text with a file drawer listing the 1-based response bounds.
    """
    # Two passes: the drawer length depends on the bounds digits.
    def build(head_len):
        body, spans = "", []
        for kind, t in parts:
            if kind == "resp":
                spans.append((head_len + len(body) + 1, head_len + len(body) + len(t) + 1))
            body += t
        if old_format:
            b = "(" + " ".join(f"({s} . {e})" for s, e in spans) + ")"
        else:
            b = "((response " + " ".join(f"({s} {e})" for s, e in spans) + "))"
        head = f":PROPERTIES:\n:GPTEL_MODEL: m-1\n:GPTEL_SYSTEM: be brief\n:GPTEL_BOUNDS: {b}\n" \
               f"{drawer_extra}:END:\n"
        return head, body
    head, body = build(0)
    for _ in range(5):
        head, body = build(len(head))
    text = head + body
    return text.replace("\n", eol)


EMOJI = "\U0001F600"

NOTES = {
    # two sections, new format, section topic beats title, emoji before a response
    "2024-01-02.org": _note([
        ("text", "* First title\n:PROPERTIES:\n:GPTEL_TOPIC: Topic one\n:END:\n"),
        ("text", f"** ask {EMOJI} me\nWhat is [[http://x][this]]?\n"),
        ("resp", "It is *a* thing.\n#+begin_src python\nx=1\n#+end_src\nDone."),
        ("text", "\n@user and more\n"),
        ("resp", "Second answer."),
        ("text", "\n* Second title\nplain question\n"),
        ("resp", "Answer in two.\n"),
        ("text", "tail text\n"),
    ]),
    # old format, no headline: whole file is one conversation; CRLF line ends
    "2024-01-01.org": _note([
        ("text", "Question without headline\n"),
        ("resp", "Old format answer"),
        ("text", "\nfollow up\n"),
    ], drawer_extra=":GPTEL_TOPIC: file topic\n", old_format=True, eol="\r\n"),
    # response ending exactly where the next headline starts is dropped (D1);
    # overlapping bounds; empty message after cleaning
    "2024-01-03.org": _note([
        ("text", "* A\nq1\n"),
        ("resp", "r1\n"),
        ("text", "* B\nq2\n"),
        ("resp", "#+begin_src\ncode only\n#+end_src"),
        ("text", "\nq3\n"),
        ("resp", "last answer at the end"),
    ]),
    # undated file name
    "notes.org": _note([("text", "* Only\nq\n"), ("resp", "a\n"), ("text", "more\n")]),
    # impossible date: rejected
    "2024-02-30.org": _note([("text", "q\n"), ("resp", "a")]),
    # no bounds at all
    "2024-01-04.org": "* Nothing\njust notes\n",
}


@pytest.fixture(scope="module")
def note_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("notes")
    for name, text in NOTES.items():
        with open(d / name, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    # not an org file, not read
    (d / "readme.txt").write_text("ignore me")
    return str(d)


# Worked out by hand from the format: (file, date, topic, model, system prompt, messages).
EXPECTED = [
    ("2024-01-01.org", datetime.date(2024, 1, 1), "file topic", [
        ("user", "Question without headline"), ("assistant", "Old format answer"), ("user", "follow up")]),
    ("2024-01-02.org", datetime.date(2024, 1, 2), "Topic one", [
        ("user", f"First title\nask {EMOJI} me\nWhat is this?"), ("assistant", "It is *a* thing.\n\nDone."),
        ("user", "and more"), ("assistant", "Second answer.")]),
    ("2024-01-02.org", datetime.date(2024, 1, 2), "Second title", [
        ("user", "Second title\nplain question"), ("assistant", "Answer in two."), ("user", "tail text")]),
    # "r1" ends on the next headline and "last answer" on the end of the file:
    # both bounds reach past their section and are dropped
    ("2024-01-03.org", datetime.date(2024, 1, 3), "B", [
        ("user", "B\nq2"), ("user", "q3\nlast answer at the end")]),
    ("notes.org", None, "Only", [("user", "Only\nq"), ("assistant", "a"), ("user", "more")]),
]


def test_note_ingest(spark, note_dir):
    convs, msgs, rejected = O.ingest_notes(spark, note_dir)
    got_c = sorted((r.id, os.path.basename(r.file_path), r.date, r.topic, r.model, r.system_prompt)
                   for r in convs.collect())
    assert got_c == [(k, name, day, topic, "m-1", "be brief")
                     for k, (name, day, topic, _) in enumerate(EXPECTED, 1)]
    got_m = [(r.id, r.conversation_id, r.role, r.content, r.token_count)
             for r in msgs.orderBy("id").collect()]
    flat = [(k, role, text) for k, (_, _, _, ms) in enumerate(EXPECTED, 1) for role, text in ms]
    assert got_m == [(n, k, role, text, len(text) // 4) for n, (k, role, text) in enumerate(flat, 1)]
    assert [os.path.basename(r.file_path) for r in rejected.collect()] == ["2024-02-30.org"]


def test_offsets_cover_the_section(spark, note_dir):
    """Message spans of a section are ordered, and assistant spans have the response's length."""
    _, msgs, _ = O.ingest_notes(spark, note_dir)
    by_conv = {}
    for r in msgs.orderBy("id").collect():
        by_conv.setdefault(r.conversation_id, []).append(r)
    for ms in by_conv.values():
        for a, b in zip(ms, ms[1:]):
            assert a.char_start < a.char_end <= b.char_start < b.char_end
    size = {r.content: r.char_end - r.char_start for ms in by_conv.values() for r in ms if r.role == "assistant"}
    assert size["Second answer."] == len("Second answer.")
    assert size["It is *a* thing.\n\nDone."] == len("It is *a* thing.\n#+begin_src python\nx=1\n#+end_src\nDone.")


def test_note_ingest_cases(spark, note_dir):
    convs, msgs, _ = O.ingest_notes(spark, note_dir, first_conversation_id=100,
                                    first_message_id=1000)
    c = {r.topic: r for r in convs.collect()}
    # section drawer topic wins over the title; second section keeps its title;
    # section A's only response ends on the next headline, so A has no bounds
    assert {"Topic one", "Second title", "file topic", "B", "Only"} == set(c)
    assert c["Only"].date is None
    assert min(r.id for r in c.values()) == 100
    m = msgs.collect()
    assert min(r.id for r in m) == 1000
    texts = [r.content for r in m]
    # the response flush with the next headline is dropped, not cut
    assert "r1" not in texts
    # link label kept, src block and @user marker removed
    assert any("What is this?" in t for t in texts)
    assert not any("x=1" in t or "@user" in t for t in texts)


def test_bounds_formats(spark):
    df = spark.createDataFrame([("((response (3 9) (12 20)))",), ("((1807 . 3547) (4 . 5))",),
                                (None,), ("",)], "b string")
    got = [[(x.s, x.e) for x in r.v] for r in df.select(O.parse_bounds(F.col("b")).alias("v")).collect()]
    assert got == [[(3, 9), (12, 20)], [(1807, 3547), (4, 5)], [], []]


# -- CSV ---------------------------------------------------------------------------

NNBSP = "\u202f"
CSV_ROWS = [
    ("1/8/25, 10:16 PM", "Question:\nWhat is * this?\n* star line\nAI Response:\n"
                         "Some **bold** and `code`\n```python\nx = 1  # `not code`\n```\n# Title\n"
                         "see [docs](http://d.e) ![pic](http://i.png)\n"),
    (f"1/8/25, 9:05{NNBSP}AM", "Question:\r\nEarly \"quoted\" question\r\nAI Response:\r\n"
                               "Answer\r\n```\r\nfence left open\r\n"),
    ("bad date", "Question:\nignored\nAI Response:\nnope\n"),
    ("3/4/75, 1:00 pm", "Question:\n" + "x" * 61 + "\nAI Response:"),
    ("3/4/75, 2:00 pm", "no markers at all"),
    ("1/9/25, 8:00 AM", "Question:\n" + "y" * 60 + "\nAI Response:\nok\nQuestion:\nagain?\n"
                        "AI Response:\n## Sub\nfine\n"),
]


@pytest.fixture(scope="module")
def csv_path(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    p = d / "history.csv"
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write("Date,Conversation\r\n")
        for dt, conv in CSV_ROWS:
            f.write('"' + dt + '","' + conv.replace('"', '""') + '"\r\n')
    return str(p)


MARKDOWN = ("Some **bold** and `code`\n```python\nx = 1  # `not code`\n```\n# Title\n"
            "see [docs](http://d.e) ![pic](http://i.png)")
ORG = ("Some *bold* and ~code~\n#+begin_src python\nx = 1  # `not code`\n#+end_src\n**** Title\n"
       "see [[http://d.e][docs]] [[http://i.png]]")
# In time order: (time, topic, messages).
CSV_EXPECTED = [
    (datetime.datetime(1975, 3, 4, 13, 0), "x" * 57 + "...", [("user", "x" * 61 + "\nAI Response:")]),
    (datetime.datetime(2025, 1, 8, 9, 5), 'Early "quoted" question', [
        ("user", 'Early "quoted" question'), ("assistant", "Answer\n```\nfence left open")]),
    (datetime.datetime(2025, 1, 8, 22, 16), "What is * this?", [
        ("user", "What is * this?\n- star line"), ("assistant", MARKDOWN)]),
    (datetime.datetime(2025, 1, 9, 8, 0), "y" * 60, [
        ("user", "y" * 60), ("assistant", "ok"), ("user", "again?"), ("assistant", "## Sub\nfine")]),
]


def test_csv_tables(spark, csv_path):
    convs, msgs = H.history_tables(H.read_history_csv(spark, csv_path))
    got_c = [(r.id, r.created_at, r.date, r.topic) for r in convs.orderBy("id").collect()]
    assert got_c == [(k, ts, ts.date(), topic) for k, (ts, topic, _) in enumerate(CSV_EXPECTED, 1)]
    flat = [(k, role, text) for k, (_, _, ms) in enumerate(CSV_EXPECTED, 1) for role, text in ms]
    got_m = [tuple(r) for r in msgs.select("id", "conversation_id", "role", "content",
                                           "token_count").orderBy("id").collect()]
    assert got_m == [(n, k, role, text, len(text) // 4) for n, (k, role, text) in enumerate(flat, 1)]


def test_csv_dates(spark, csv_path):
    convs, _ = H.history_tables(H.read_history_csv(spark, csv_path))
    years = sorted({r.created_at.year for r in convs.collect()})
    assert years == [1975, 2025]


def _spans(text: str) -> list[str]:
    """The pieces of a rendered file that its bounds drawer names (1-based, end exclusive)."""
    drawer = re.match(r":PROPERTIES:\n:GPTEL_BOUNDS: \(\(response((?: \(\d+ \d+\))*)\)\)\n:END:\n\n", text)
    pairs = re.findall(r"\((\d+) (\d+)\)", drawer[1])
    return [text[int(a) - 1:int(b) - 1] for a, b in pairs]


def _section(topic: str, *messages: str) -> str:
    return f"* {topic}\n:PROPERTIES:\n:GPTEL_TOPIC: {topic}\n:END:\n\n" + "".join(messages)


def test_render_days(spark, csv_path):
    rows = H.history_rows(H.read_history_csv(spark, csv_path))
    texts = {r.file: r.content for r in render.note_texts(H.render_days(rows)).collect()}
    assert sorted(texts) == ["1975-03-04.org", "2025-01-08.org", "2025-01-09.org"]
    day = texts["2025-01-08.org"]
    early, late = 'Early "quoted" question', "What is * this?"
    assert day.partition(":END:\n\n")[2] == (
        _section(early, f"** {early}\n{early}\n\n", "*** Response\nAnswer\n#+begin_src\nfence left open\n\n")
        + _section(late, f"** {late}\n{late}\n- star line\n\n", f"*** Response\n{ORG}\n\n"))
    assert _spans(day) == ["Answer\n#+begin_src\nfence left open", ORG]
    assert _spans(texts["2025-01-09.org"]) == ["ok", "***** Sub\nfine"]


def test_render_many_digits(spark):
    """Bounds whose digit count changes while the drawer grows still slice back to the responses."""
    convs = [(i, [("user", f"q{i} " + "z" * (i * 37 % 400)), ("assistant", "a" * (i * 53 % 700))])
             for i in range(60)]
    rows = [("d.org", i, "t", j, role, text) for i, ms in convs for j, (role, text) in enumerate(ms)]
    df = spark.createDataFrame(rows, "file string, c long, topic string, j long, role string, "
                                     "content string")
    text = render.note_texts(render.render_chunks(df, "file", ["c"], "j")).collect()[0].content
    assert _spans(text) == [ms[1][1] for _, ms in convs]


def test_write_and_parse_back(spark, csv_path, tmp_path):
    rows = H.history_rows(H.read_history_csv(spark, csv_path))
    chunks = H.render_days(rows)
    out = str(tmp_path / "days")
    H.write_day_files(chunks, out)
    names = sorted(n for n in os.listdir(out) if not n.startswith("_"))
    texts = {r.file: r.content for r in render.note_texts(chunks).collect()}
    assert names == sorted(texts)
    for n in names:
        with open(os.path.join(out, n), encoding="utf-8", newline="") as f:
            assert f.read() == texts[n]
    _, msgs, rejected = O.ingest_notes(spark, out)
    assert rejected.count() == 0
    answers = [r.content for r in msgs.where("role = 'assistant'").orderBy("id").collect()]
    # code blocks, headline stars and links without a label go when notes are read; an unclosed block line goes alone
    assert answers == ["Answer\n\nfence left open",
                       "Some *bold* and ~code~\n\nTitle\nsee docs", "ok", "Sub\nfine"]


def test_files_in_folders(spark, tmp_path):
    """A file key with a folder: the folder is made."""
    df = spark.createDataFrame([("notes/0/undated.org", 1, "t", 0, "user", "hello"),
                                ("notes/1/2024-01-01.org", 2, "t", 0, "user", "bye")],
                               "file string, c long, topic string, j long, role string, content string")
    out = str(tmp_path / "out")
    H.write_day_files(render.render_chunks(df, "file", ["c"], "j"), out)
    with open(f"{out}/notes/0/undated.org", encoding="utf-8") as f:
        assert "** hello\nhello\n" in f.read()
    assert os.path.exists(f"{out}/notes/1/2024-01-01.org")
    assert sorted(os.listdir(out)) == ["notes"]


def test_notes_roundtrip_query(spark):
    """Every assistant turn of the table comes back as a message of its own conversation."""
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    rows = E.queries()["notes_roundtrip"](spark, sf).collect()
    back = {}
    for r in rows:
        if r.role == "assistant":
            back.setdefault(int(r.file_path.split("/")[-2]), []).append(r.content)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'assistant'").collect()
    # plain prose passes through both conversions unchanged but for outer white space
    plain = [t for t in turns if not re.search(r"[*`#\[\]@:]|\n\n\n", t.text)]
    assert len(plain) > 10
    for t in plain:
        assert t.text.strip() in back[t.conv_id]
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("inner", ["x" + " " * 80_000 + "y", "a\n" * 3000])
def test_trim_is_linear(spark, inner):
    df = spark.createDataFrame([(f" \t{inner}\u00a0\x1c",)], "t string")
    from chatlake.functions.text import strip_ws
    t0 = time.time()
    assert df.select(strip_ws(F.col("t"))).first()[0] == inner.strip()
    assert time.time() - t0 < 10


MARKDOWN_CASES = [
    ("", ""), ("\n", "\n"), ("# A", "**** A"), ("###### B  c", "********* B  c"), ("#no", "#no"), ("####### x", "####### x"),
    ("# ", "**** "), ("a\n## T\nb", "a\n***** T\nb"), ("```", "#+begin_src"), ("```py\n# x\n```\n# y", "#+begin_src py\n# x\n#+end_src\n**** y"),
    ("  ```  js \n`a`\n\t```end\n`b`", "#+begin_src js\n`a`\n#+end_src\n~b~"), ("`a\nb`", "`a\nb`"),
    ("**x** **y\nz**", "*x* **y\nz**"), ("![p](u) [l](v)", "[[u]] [[v][l]]"), ("# **h** `c`", "**** **h** `c`"),
    ("```\n```\n```\n**in**", "#+begin_src\n#+end_src\n#+begin_src\n**in**"), ("a\u2028# b", "a\u2028# b"),
    ("x\n", "x\n"), ("\n\n# e\n\n", "\n\n**** e\n\n"),
]


def test_markdown(spark):
    df = spark.createDataFrame(list(enumerate(c[0] for c in MARKDOWN_CASES)), "i int, t string")
    got = df.select("i", render.markdown_to_org(F.col("t")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [c[1] for c in MARKDOWN_CASES]


def test_markdown_is_linear(spark):
    text = "line `a` **b**\n" * 80_000 + "```\nx\n```\n" * 2_000
    df = spark.createDataFrame([(text,)], "t string")
    df.select(F.length(render.markdown_to_org(F.col("t")))).first()
    t0 = time.time()
    out = df.select(render.markdown_to_org(F.col("t"))).first()[0]
    assert out == "line ~a~ *b*\n" * 80_000 + "#+begin_src\nx\n#+end_src\n" * 2_000
    assert time.time() - t0 < 10


def _export(path, rows, eol="\n"):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(f"Date,Conversation{eol}")
        for day, text in rows:
            f.write('"' + day + '","' + text.replace('"', '""') + '"' + eol)


def test_csv_in_many_tasks(spark, tmp_path):
    """Quoted newlines, quotes and commas over tiny splits: the same rows in the same order as one task reads."""
    import csv
    rows = [(f"1/{i % 28 + 1}/25, 10:{i % 60:02} PM",
             f"Question:\nnumber {i}, \"{'x' * (i * 7 % 90)}\"\n\n\nAI Response:\n" + "line, with \"\" and é\n" * (i % 9) + "end")
            for i in range(300)]
    rows += [("", ""), ("2/1/25, 1:00 AM", '"'), ("2/1/25, 2:00 AM", "\n\n\"\n"), ("x", "y" * 5000)]
    path = str(tmp_path / "history.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for eol in ("\n", "\r\n"):
        _export(path, rows, eol)
        with open(path, encoding="utf-8-sig") as f:
            want = [(r["Date"], r["Conversation"]) for r in csv.DictReader(f)]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            df = H.read_history_csv(spark, path)
            assert spark.read.text(path).rdd.getNumPartitions() > 20
            got = df.orderBy("row_no").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [(r.Date or "", r.Conversation or "") for r in got] == want
        one = H.read_history_csv(spark, path, split=False).collect()
        norm = lambda v: (v or "").replace("\r\n", "\n")
        assert [(norm(r.Date), norm(r.Conversation)) for r in one] == want
        assert df.columns == ["row_no", "Date", "Conversation"]


def test_csv_folder(spark, tmp_path):
    """Several exports: every header goes, rows are numbered over all files, equal times keep file order."""
    for name, n in (("a.csv", 3), ("b.csv", 4)):
        _export(str(tmp_path / name), [("1/8/25, 10:16 PM", f"Question:\n{name} {i}\nand\nAI Response:\nok")
                                       for i in range(n)])
    convs, msgs = H.history_tables(H.read_history_csv(spark, str(tmp_path)))
    assert [r.topic for r in convs.orderBy("id").collect()] == [f"a.csv {i}" for i in range(3)] + [f"b.csv {i}" for i in range(4)]
    rows = msgs.orderBy("id").collect()
    assert [(r.id, r.conversation_id) for r in rows] == [(2 * i + j + 1, i + 1) for i in range(7) for j in range(2)]


# -- files that cannot be ingested ---------------------------------------------------------

def test_rejected_files(spark, tmp_path):
    """Invalid UTF-8, an impossible date, a file that fails while it is read: rejected with a reason, the rest ingested."""
    good = _note([("text", "* T\nq\n"), ("resp", "a\n"), ("text", "more\n")])
    for name in ("2024-01-05.org", "2024-13-01.org", "2024-01-06.org", "bom.org"):
        (tmp_path / name).write_text(good, encoding="utf-8")
    (tmp_path / "latin.org").write_bytes("* T\nqué\n".encode("latin-1"))
    # A checksum that doesn't fit makes the file system fail while the file is read.
    (tmp_path / ".2024-01-06.org.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x01\x02\x03\x04")
    convs, msgs, rejected = O.ingest_notes(spark, str(tmp_path))
    assert {os.path.basename(r.file_path): r.reason for r in rejected.collect()} == {
        "latin.org": O.NOT_UTF8, "2024-13-01.org": O.BAD_DATE, "2024-01-06.org": O.NOT_READ}
    assert [os.path.basename(r.file_path) for r in convs.orderBy("id").collect()] == ["2024-01-05.org", "bom.org"]
    assert msgs.count() == 6


def test_bounds_of_odd_shape(spark):
    """Empty, reversed, crossing, far and repeated bounds against a plain filter per section."""
    import random
    rng = random.Random(5)
    files, want = [], []
    for f in range(40):
        cuts = sorted(rng.sample(range(1, 100), rng.randrange(0, 6)))
        spans = list(zip([0] + cuts, cuts + [100]))[1:] if cuts else []
        bounds = [(rng.randrange(110), rng.randrange(110)) for _ in range(rng.randrange(8))]
        bounds += [(c, c) for c in cuts[:2]] + [(s, e) for s, e in spans[:2]] * 2
        path = f"f{f:02}"
        files.append((path, spans or [(0, 100)], bounds, bool(spans)))
        for k, (s0, e0) in enumerate(spans, 1):
            want += [(path, k, i, s, e) for i, (s, e) in enumerate(bounds) if s >= s0 and e <= e0]
        if not spans:
            want += [(path, 0, i, s, e) for i, (s, e) in enumerate(bounds)]
    spans = spark.createDataFrame([(p, k + h, s, e) for p, ss, _, h in files for k, (s, e) in enumerate(ss)],
                                  "file_path string, k int, start long, end long")
    bounds = spark.createDataFrame([(p, i, s, e, 100) for p, _, bs, _ in files for i, (s, e) in enumerate(bs)],
                                   "file_path string, i int, s long, e long, length long")
    got = O.assign_bounds(bounds, spans).select("file_path", "k", "i", "s", "e").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_many_sections_are_linear(spark):
    parts = []
    for i in range(20_000):
        parts += [("text", f"* Title {i}\nquestion {i}\n"), ("resp", f"answer {i}"), ("text", "\n")]
    head, body = 0, []
    for _ in range(6):
        at, spans = head, []
        for kind, t in parts:
            if kind == "resp":
                spans.append(f"({at + 1} {at + len(t) + 1})")
            at += len(t)
        drawer = f":PROPERTIES:\n:GPTEL_BOUNDS: ((response {' '.join(spans)}))\n:END:\n"
        head = len(drawer)
    df = spark.createDataFrame([("2024-01-01.org", drawer + "".join(t for _, t in parts))], "file_path string, content string")
    t0 = time.time()
    convs, msgs, _ = O.ingest_texts(df)
    assert msgs.where("role = 'assistant'").count() == 20_000 and convs.count() == 20_000
    assert time.time() - t0 < 30


def _long_note(n):
    """A note without headlines, so of one section: its text, the questions and the answers."""
    asks = [f"question {i} {EMOJI}\n{'x' * 30}\n" for i in range(n)]
    said = [f"answer {i} {'y' * 30}" for i in range(n)]
    head = 0
    for _ in range(6):
        at, spans = head, []
        for a, b in zip(asks, said):
            at += len(a)
            spans.append(f"({at + 1} {at + len(b) + 1})")
            at += len(b)
        drawer = f":PROPERTIES:\n:GPTEL_BOUNDS: ((response {' '.join(spans)}))\n:END:\n"
        head = len(drawer)
    return drawer + "".join(a + b for a, b in zip(asks, said)), asks, said


def test_one_section_with_many_responses_is_linear(spark):
    """A file without headlines is one section, cut at all its responses in one pass."""
    text, asks, said = _long_note(60_000)
    t0 = time.time()
    convs, msgs, _ = O.ingest_texts(spark.createDataFrame([("a.org", text)], "file_path string, content string"))
    rows = msgs.orderBy("id").collect()
    assert time.time() - t0 < 40
    assert convs.count() == 1 and [r.id for r in rows] == list(range(1, 120_001))
    assert [r.content for r in rows[1::2]] == said
    assert [r.content for r in rows[2::2]] == [a.strip() for a in asks[1:]]
    assert all(text[r.char_start:r.char_end].strip() == r.content for r in rows[1:])


def test_rejects_beside_a_long_section(spark):
    """A file with an impossible date is rejected in a time linear in the others."""
    text = _long_note(60_000)[0]
    files = spark.createDataFrame([("undated.org", text), ("2024-02-30.org", text)], "file_path string, content string")
    t0 = time.time()
    _, _, rejected = O.ingest_texts(files)
    assert [tuple(r) for r in rejected.collect()] == [("2024-02-30.org", O.BAD_DATE)]
    assert time.time() - t0 < 40


def test_long_section_on_disk(spark, tmp_path):
    """The messages of a long file without headlines are those of its text, from a folder as well."""
    text, _, said = _long_note(60_000)
    (tmp_path / "undated.org").write_text(text, encoding="utf-8")
    t0 = time.time()
    convs, msgs, rejected = O.ingest_notes(spark, str(tmp_path))
    rows = msgs.where("role = 'assistant'").orderBy("id").collect()
    assert time.time() - t0 < 40
    assert [r.content for r in rows] == said and convs.count() == 1 and rejected.count() == 0


def test_archive_of_a_long_section(spark, tmp_path):
    """A second call that finds nothing new leaves the daily figures of a long section as they are."""
    from chatlake.dataset import read_table
    from chatlake.operators.ingest import ingest_archive
    notes, root = tmp_path / "notes", str(tmp_path / "archive")
    notes.mkdir()
    (notes / "2024-01-05.org").write_text(_long_note(60_000)[0], encoding="utf-8")
    t0 = time.time()
    first, second = (ingest_archive(spark, str(notes), root) for _ in range(2))
    assert time.time() - t0 < 60
    assert (first.files, first.messages, second.files, second.skipped) == (1, 120_000, 0, 1)
    day, = read_table(spark, root, "daily_stats").collect()
    assert (day.total_messages, day.user_messages, day.conversation_count) == (120_000, 60_000, 1)


def test_ingest_writes_message_texts_once(spark, tmp_path):
    """Texts go to the archive from the table that the clean-up has staged, without a copy between them."""
    from chatlake.dataset import read_table
    from chatlake.operators.ingest import ingest_archive
    from chatlake.plans.staging import staging_root
    notes, root = tmp_path / "notes", str(tmp_path / "archive")
    notes.mkdir()
    (notes / "2024-01-05.org").write_text(_long_note(3)[0], encoding="utf-8")
    folder = staging_root(spark).removeprefix("file:")

    def copies():
        return sum(n.startswith("messages-") for n in os.listdir(folder)) if os.path.isdir(folder) else 0
    before = copies()
    done = ingest_archive(spark, str(notes), root)
    assert (done.files, done.conversations, done.messages) == (1, 1, 6) and copies() == before + 1
    assert [r.id for r in read_table(spark, root, "messages").orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]


def test_file_known_twice_is_skipped_once(spark, tmp_path):
    """A file that was added twice on request is one skipped file; one that cannot be read is tried again."""
    from chatlake.operators.ingest import ingest_archive
    notes, root = tmp_path / "notes", str(tmp_path / "archive")
    notes.mkdir()
    (notes / "2024-01-05.org").write_text(_long_note(3)[0], encoding="utf-8")
    (notes / "2024-01-06.org").write_bytes(b"\xff\xfe")
    for _ in range(2):
        assert ingest_archive(spark, str(notes), root, dedupe=None).files == 1
    (notes / "2024-01-07.org").write_text(_long_note(2)[0], encoding="utf-8")
    last = ingest_archive(spark, str(notes), root)
    assert (last.files, last.skipped, last.replaced, last.messages) == (1, 1, 0, 4)
    assert [r.reason for r in last.rejected.collect()] == [O.NOT_UTF8]


def test_cuts_across_blocks(spark):
    """Every cut of a text of several blocks is Python's slice, wherever it starts and ends."""
    import random
    n, rng = 3 * O.BLOCK + 17, random.Random(3)
    text = "".join(rng.choice(("a", "\n", "\r", "é", EMOJI)) for _ in range(n))
    edges = [0, 1, O.BLOCK - 1, O.BLOCK, O.BLOCK + 1, 2 * O.BLOCK, 3 * O.BLOCK, n - 1, n, n + 5, -1, -n, -n - 3]
    cuts = [(t, a, b) for t in ("", "b", text[:O.BLOCK], text) for a in edges for b in edges]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cuts)], "i int, t string, a long, b long")
    got = df.select("i", O.py_slice(O.text_blocks(F.col("t")), F.col("a"), F.col("b"), F.length("t").cast("long"))).collect()
    assert dict(map(tuple, got)) == {i: t[a:b] for i, (t, a, b) in enumerate(cuts)}


def test_drawer_lengths(spark):
    """The histogram against the ten rounds of the format, on files whose bounds cross powers of ten."""
    import random
    rng, rows, want = random.Random(8), [], {}
    for f in range(60):
        at, spans = rng.randrange(30), []
        for _ in range(rng.randrange(1, 40)):
            n = rng.choice((0, 3, 40, 300, 9000))
            spans.append((at, at + n))
            at += n + 13 + rng.randrange(80)
        text = "((response))"
        for _ in range(10):
            h = len(f":PROPERTIES:\n:GPTEL_BOUNDS: {text}\n:END:\n\n")
            text = "((response " + " ".join(f"({s + h + 1} {e + h + 1})" for s, e in spans) + "))"
        rows += [(f"f{f}", s, e) for s, e in spans]
        want[f"f{f}"] = h
    got = render.drawer_lengths(spark.createDataFrame(rows, "file string, s long, e long")).collect()
    assert {r.file: r.h for r in got} == want


def test_offsets_that_are_not_strict(spark, note_dir):
    """Responses flush with the next headline or the end of the file are kept; nothing else changes."""
    _, strict, _ = O.ingest_notes(spark, note_dir)
    _, loose, _ = O.ingest_notes(spark, note_dir, strict_offsets=False)
    said = lambda m: [r.content for r in m.where("role = 'assistant'").orderBy("id").collect()]
    assert [t for t in said(loose) if t in ("r1", "last answer at the end")] == ["r1", "last answer at the end"]
    assert [t for t in said(loose) if t not in ("r1", "last answer at the end")] == said(strict)
    again = [r.content for r in loose.where("role = 'user'").collect()]
    assert "q3" in again and "q3\nlast answer at the end" not in again


def _all_steps(c):
    """The clean-up step by step, whatever the text has."""
    from chatlake.functions import text as X
    for pattern, repl in X._ORG_STEPS:
        c = F.regexp_replace(c, pattern, repl)
    return X.strip_ws(c)


def test_clean_up_of_any_text(spark):
    """Steps that can find nothing are left out; the result is that of all steps."""
    import random

    from chatlake.functions.text import strip_org_formatting
    rng = random.Random(5)
    bits = ["*", "**", " ", "\n", "\n\n", "\t", " ", "\u0085", "\r", "#", "+", "#+begin_src", "#+END_SRC", "#+RESULTS:", "[", "[[", "]", "]]",
            ":PROPERTIES:", ":END:", ":PROP", "ERTIES:", "@", "@user", "user", "@assistant", "x", "é", EMOJI]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    rows = df.select("text", strip_org_formatting(F.col("text")).alias("a"), _all_steps(F.col("text")).alias("b"))
    assert rows.where("not a <=> b").collect() == []


def test_clean_up_of_plain_text_is_cheap(spark):
    """A text without markup is searched for plain marks only; it takes a fraction of the time of one with markup."""
    from chatlake.functions.text import strip_org_formatting
    line = F.repeat(F.lit("some plain words of a message. "), 300)
    took = {}
    for mark in ("", "@user "):
        df = spark.range(0, 4000, 1, 4).select(F.concat(F.lit(mark), F.col("id").cast("string"), line).alias("raw")).cache()
        df.count()
        for _ in range(3):
            t0 = time.time()
            df.select(strip_org_formatting(F.col("raw"))).write.format("noop").mode("overwrite").save()
            took[mark] = min(took.get(mark, 1e9), time.time() - t0)
        df.unpersist()
    assert took[""] * 2 < took["@user "]


def test_note_queries_need_conversations_only(spark, tmp_path):
    """Queries that parse note files read the conversations; no archive of all tables is written for them."""
    import __spark_entry__ as E
    spark.createDataFrame([(59, 0, "user", "q"), (59, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "a")],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = E.queries()["note_rejects"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("notes/2024-02-30.org", O.BAD_DATE)]
