"""Conversation structure repair by iterative-deepening A*.

A conversation is mended by edits of its turns, taken from first to last, so
that the role initials of what is left read ``(s?(ua)+)?``:

    D  delete a turn              2   (required for blank and duplicate turns)
    I  insert an empty turn       5   (user or assistant)
    K  keep a turn                0   (+5 if its text is truncated)
    R  give it another role       1   (+5 if its text is truncated)

The audit is the cheapest sequence of edits, of equal ones the least in ASCII.
What may follow depends only on the last role, so a search state is (turn,
last role), and the letters alone determine the roles.

Search: depth first in ASCII order of the edits under a bound on the cost; the
bound rises to the least cost that a failed branch would have needed.  The
transposition table keeps for every state that failed what it needs at least,
so it fails at once until the bound leaves it that much.  The first accepting
path under the final bound is the answer.

Long conversations are searched in blocks of ``BLOCK`` turns.  What each last
role costs from the end of a block to the end of the conversation comes from a
pass over the blocks' cost tables, from the last to the first; with it each
block is searched on its own, once from every role it may start with, and a
pass from the first block to the last links the answers.  Inserted turns belong
to the turn they precede (at the end: to the last block), so no block's path
is the beginning of another one and the least path of the whole is made of the
least paths of the blocks.

Scale: turns are numbered by a range-partitioned sort, in which a conversation
spans several partitions; faults and counts are partial aggregates and equijoins
on narrow keys; blocks are bounded groups, searched in parallel.  The two passes
over blocks and the digest stream sorted rows and hold a constant number of
values a conversation (the digest: its audit, which is a result column); a
SHA-256 over one conversation is sequential by definition.

Defined results: null roles and texts are one blank, null ids and turns a blank
in the damage key; null turns come first, turns with equal numbers stand in
order of role, text; repeated rows are duplicates; a turn whose role starts with
none of s, u, a can't be kept, only given another role or deleted; null ids are
one conversation; a conversation without turns has zeros, an empty audit and
the digest of the empty text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import WS_CHARS, stored
from chatlake.plans.numbering import with_row_index

BLOCK = 64

#: Last role: none yet, system, user, assistant.  What a kept turn leads to, and the role that may always follow.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: Cost at the end of the conversation: the inserted turns that complete the last pair.
END = (0, 2 * INSERT, INSERT, 0)
#: Code of a turn that must go; other turns are the initial of their role (o: another), upper case if truncated.
GONE, OTHER = "x", "o"


def edits(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, turns done, next state) of the edits at a turn, in ASCII order."""
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
    if code != GONE:
        more, kept = CUT if code.isupper() else 0, KEEP[state].get(code.lower())
        if kept is not None:
            out.append(("K", more, 1, kept))
        out.append(("R", REROLE + more, 1, NEXT[state]))
    return out


@lru_cache(maxsize=20_000)
def search(codes: str, start: int, after: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest, then least, edits of a block.

    ``after``: what every last state costs from the end of the block on.
    """
    n = len(codes)
    # What a state needs at least: the cheapest edit of every turn left, until a failure shows more.
    least, need = min(after), [[0] * 4 for _ in range(n)] + [list(after)]
    for p in range(n - 1, -1, -1):
        c = codes[p]
        least += DELETE if c == GONE or c.isupper() else REROLE if c == OTHER else 0
        need[p] = [least] * 4
    path: list[str] = []

    def visit(p: int, state: int, left: int) -> int | None:
        """Last state of the first accepting path that costs at most ``left``."""
        if need[p][state] > left:
            return None
        if p == n:
            return state
        short = None
        for letter, cost, step, to in edits(codes[p], state):
            path.append(letter)
            if cost <= left:
                last = visit(p + step, to, left - cost)
                if last is not None:
                    return last
            path.pop()
            wants = cost + need[p + step][to]
            short = wants if short is None else min(short, wants)
        need[p][state] = max(need[p][state], short)
        return None

    while True:
        bound = need[0][start]
        last = visit(0, start, bound)
        if last is not None:
            return bound - after[last], "".join(path), last


@lru_cache(maxsize=20_000)
def cost_table(codes: str) -> tuple[tuple[float, ...], ...]:
    """Least cost of a block from every first state to every last one."""
    rows = []
    for start in range(4):
        now = [0 if s == start else float("inf") for s in range(4)]
        for c in codes:
            for _ in range(3):  # inserted turns before this one
                for s in range(4):
                    now[NEXT[s]] = min(now[NEXT[s]], now[s] + INSERT)
            then = [float("inf")] * 4
            for s in range(4):
                for letter, cost, _, to in edits(c, s):
                    if letter != "I":
                        then[to] = min(then[to], now[s] + cost)
            now = then
        rows.append(tuple(now))
    return tuple(rows)


# --- damage and faults ------------------------------------------------------------

def _as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _key() -> Column:
    """A conversation id as text that isn't null: joins and groups need no null-safe forms."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy of every row after the contract's damage."""
    kind = F.pmod(F.crc32(F.concat(_as_text("conv_id"), F.lit(":"), _as_text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(_key(), F.col("turn").cast("long").alias("turn"), _as_text("role").alias("role"),
                                _as_text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, pos: turns (conv, turn, role, text) with their place in the conversation."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return stored(with_row_index(rows, order, name="pos", partition_by=["conv"]).select(
        "conv", "turn", "role", "text", "pos"), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv, pos, fault (blank, duplicate, truncated or null) and code of every numbered turn."""
    body = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    narrow = turns.select("conv", "pos", F.xxhash64("role", "text").alias("k1"),
                          F.xxhash64("text", F.lit(1), "role").alias("k2"), F.left("role", F.lit(1)).alias("initial"),
                          (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = (narrow.groupBy("conv", "k1", "k2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    fault = (F.when(F.col("blank"), F.lit("blank")).when(F.col("pos") > F.col("first"), F.lit("duplicate"))
             .when(F.col("cut"), F.lit("truncated")))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit(OTHER))
    code = (F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE))
            .when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial))
    return stored(narrow.join(first, ["conv", "k1", "k2"], "left").withColumn("fault", fault)
                  .select("conv", "pos", "fault", code.alias("code")), "faults")


# --- the search over blocks ---------------------------------------------------------

def _streamed(df: DataFrame, order: list, step, schema: str) -> DataFrame:
    """Rows of ``step(conv, row, memory)`` over the rows of each conversation in order.

    ``step`` is called with the values of every row and a dictionary that is
    new for each conversation; it yields tuples of ``schema``.
    """
    names = df.columns
    out = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, memory = None, {}
        for b in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                if row["conv"] != conv:
                    conv, memory = row["conv"], {}
                rows.extend(step(row, memory))
            yield pa.RecordBatch.from_pylist([dict(zip(out, r)) for r in rows], schema=_arrow(schema))

    return df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])


_SOLVED = "conv string, block long, codes string, audit string, cost long, start int"


def _ending(row: dict, memory: dict) -> Iterator[tuple]:
    """From the last block to the first: what every state costs from a block's end on."""
    last = "after" not in memory
    after = memory.setdefault("after", END)
    memory["after"] = tuple(min(c + a for c, a in zip(costs, after)) for costs in cost_table(row["codes"]))
    yield row["conv"], row["block"], row["codes"], list(after), int(last)


def _linking(row: dict, memory: dict) -> Iterator[tuple]:
    """From the first block to the last: the answer that starts where the block before ended."""
    start = memory.get("state", NONE)
    memory["state"] = row["lasts"][start]
    yield row["conv"], row["block"], row["codes"], row["audits"][start], row["costs"][start], start


def _answer(codes: str, start: int, after: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """The search's answer, at the end of a conversation with the turns inserted there."""
    cost, audit, state = search(codes, start, after)
    tail = END[state] if last else 0
    return cost + tail, audit + "I" * (tail // INSERT), state


def solve(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv, block, codes, audit, cost and first state of every block (conv, block, codes) of ``size`` turns."""
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_answer(c, NONE, END, True) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[0] for f in found], pa.int64()), pa.array([NONE] * len(found), pa.int32())],
                schema=_arrow(_SOLVED))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[_answer(codes, s, tuple(after), bool(last)) for s in range(4)]
                     for codes, after, last in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.array([[a[1] for a in f] for f in found], pa.list_(pa.string())),
                 pa.array([[a[0] for a in f] for f in found], pa.list_(pa.int32())),
                 pa.array([[a[2] for a in f] for f in found], pa.list_(pa.int32()))],
                names=["conv", "block", "codes", "audits", "costs", "lasts"])

    # A conversation that leaves its first block open has no other one.
    alone = (F.col("block") == 0) & (F.length("codes") < size)
    found = blocks.where(alone).mapInArrow(short, _SOLVED)
    if blocks.where(~alone).isEmpty():
        return found
    ends = _streamed(blocks.where(~alone), [F.col("block").desc()], _ending,
                     "conv string, block long, codes string, after array<int>, last int")
    answers = stored(ends.mapInArrow(each, "conv string, block long, codes string, audits array<string>, "
                                           "costs array<int>, lasts array<int>"), "answers")
    return found.unionByName(_streamed(answers, ["block"], _linking, _SOLVED))


_EDITS = "conv string, pos long, sub int, edit string, new_role string"


def edit_rows(solved: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv, pos, sub, edit, new_role: the audits as rows, in order of (pos, sub).

    Inserted turns have the place of the turn they precede.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, block, codes, audit, state in zip(*(c.to_pylist() for c in b.columns)):
                at = sub = 0
                for letter in audit:
                    if letter in "IR":
                        state = NEXT[state]
                    elif letter == "K":
                        state = KEEP[state][codes[at].lower()]
                    rows.append({"conv": conv, "pos": block * size + at, "sub": sub, "edit": letter,
                                 "new_role": ROLE[state] if letter in "IR" else None})
                    at, sub = (at, sub + 1) if letter == "I" else (at + 1, 0)
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_EDITS))

    return solved.select("conv", "block", "codes", "audit", "start").mapInArrow(run, _EDITS)


def repair(turns: DataFrame, coded: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of numbered turns with their faults: (edits, blocks).

    Edits: conv, pos, sub, edit, role and text after the edit (null if
    deleted), and the turn's initial before it.  In order of (pos, sub) the
    letters are the audit, the rows with a role the mended conversation.
    Blocks have the cost.
    """
    block = F.floor(F.col("pos") / size).cast("long")
    blocks = stored(coded.groupBy("conv", block.alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
        .alias("codes")), "blocks")
    solved = stored(solve(blocks, size), "solved")
    steps = edit_rows(solved, size)
    mine = turns.select("conv", "pos", "role", "text", F.left("role", F.lit(1)).alias("initial"))
    on_turn = steps.where("edit <> 'I'").join(mine, ["conv", "pos"])
    kept = F.col("edit") != "D"
    on_turn = on_turn.select("conv", "pos", "sub", "edit", F.when(kept, F.coalesce("new_role", "role")).alias("role"),
                             F.when(kept, F.col("text")).alias("text"), "initial")
    new = steps.where("edit = 'I'").select("conv", "pos", "sub", "edit", F.col("new_role").alias("role"),
                                           F.lit("").alias("text"), F.lit(None).cast("string").alias("initial"))
    return on_turn.unionByName(new), solved


# --- the report ------------------------------------------------------------------------

_DIGEST = "conv string, audit string, repaired_sha256 string, illegal long"


def digests(steps: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256 and illegal of every conversation with turns, streamed in order."""
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, letters, sha, begun, before, illegal, out = None, [], None, False, None, 0, []

        def close():
            out.append({"conv": conv, "audit": "".join(letters), "repaired_sha256": sha.hexdigest(), "illegal": illegal})

        for b in batches:
            for c, edit, role, text, initial in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv:
                    if conv is not None:
                        close()
                    conv, letters, sha, begun, before, illegal = c, [], hashlib.sha256(), False, None, 0
                letters.append(edit)
                if role is not None:
                    sha.update((b"\n" if begun else b"") + role.encode() + b":" + text.encode())
                    begun = True
                if edit != "I":
                    illegal += before is not None and before + initial not in legal
                    before = initial
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(_DIGEST))
                out = []
        if conv is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(_DIGEST))

    return (steps.repartition("conv").sortWithinPartitions("conv", "pos", "sub")
            .select("conv", "edit", "role", "text", "initial").mapInArrow(run, _DIGEST))


def repair_report(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per original conversation: the counts of faults, the cheapest repair and its digest."""
    turns = numbered(damaged(conversations))
    coded = faults(turns)
    steps, solved = repair(turns, coded, size)
    gaps = turns.groupBy("conv").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    counts = coded.groupBy("conv").agg(*[F.count_if(F.col("fault") == k).alias(k)
                                         for k in ("blank", "duplicate", "truncated")])
    cost = solved.groupBy("conv").agg(F.sum("cost").alias("cost"))
    out = conversations.select("conv_id", _key()).distinct()
    for part in (gaps, counts, cost, digests(steps)):
        out = out.join(part, "conv", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
