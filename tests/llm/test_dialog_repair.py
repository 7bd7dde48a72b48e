"""Conversation repair against a plain recursion over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from chatlake.llm import dialog_repair as dr
from chatlake.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")
NULL = " "


def damage(rows):
    """{conv_id: turns (turn, role, text) after damage, in order}"""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        c = zlib.crc32(f"{NULL if conv is None else conv}:{NULL if turn is None else turn}".encode()) % 20
        role, text = (NULL if v is None else v for v in (role, text))
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out[conv] += [(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def fault_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen
                   else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """(cost, audit, repaired turns) by trying every edit at every (turn, initials' state)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    n = len(turns)

    @lru_cache(maxsize=None)
    def best(p, last, inserted):
        found = []
        if p == n and last in ("", "a"):
            found.append((0, "", ()))

        def take(letter, cost, step, role, text, ins):
            rest = best(p + step, role[:1] if role else last, ins)
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((role, text),) * bool(role) + rest[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in follow[last]:
                    take("I", 5, 0, role, "", inserted + 1)
        if p < n:
            _, role, text = turns[p]
            take("D", 2, 1, None, None, 0)
            if faults[p] not in ("blank", "duplicate"):
                more = 5 * (faults[p] == "truncated")
                if role[:1] and role[:1] in follow[last]:
                    take("K", more, 1, role, text, 0)
                for to in ("user", "assistant"):
                    if to[0] in follow[last]:
                        take("R", 1 + more, 1, to, text, 0)
        return min(found, default=None)

    return best(0, "", 0)


def brute(rows):
    out = []
    for conv, turns in damage(rows).items():
        faults = fault_of(turns)
        at = [t for t, _, _ in turns if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, kept = cheapest(tuple(turns), tuple(faults)) if turns else (0, "", ())
        assert GOOD.match("".join(r[0] for r, _ in kept))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def conversations(seed, n=60, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Ünbekannt", None, "sys", "useful"]
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\n", "", None, "é. \n", "same.", "same.", "a b\x1f", "ends with "]
    rows = []
    for conv in range(n):
        last = rng.randrange(longest)
        rows += [(conv, t + rng.randrange(2) * 3 if rng.random() < .9 else None, rng.choice(roles[: 2 + conv % 10]),
                  rng.choice(texts) if rng.random() < .5 else f"turn {t} of {conv}.") for t in range(last + 1)]
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", None), (None, None, None, None)]
    return rows + rows[:7]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn int, role string, text string, conv string, pos int")


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, tmp_path, seed):
    rows = conversations(seed)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [1, 3, 4])
def test_conversations_of_many_blocks(spark, size):
    rows = conversations(7, 25, 40) + [(1000, t, "user", f"{t}.") for t in range(50)]
    got = dr.repair_report(table(spark, rows), size)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries.op12_repair(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=str) == brute(list(map(tuple, rows)))


def test_no_turns_are_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = dr.repair_report(table(spark, [(gone, 1, "user", "a.")])).collect()
    assert list(map(tuple, got)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty(spark):
    assert dr.repair_report(table(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_search_is_the_cheapest_then_least_path(seed):
    rng = random.Random(seed)
    for _ in range(100):
        codes = "".join(rng.choice("suaoSUAOx"[: 2 + seed % 8]) for _ in range(rng.randrange(12)))
        names = {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}
        turns = tuple((k, names[c.lower()], "") for k, c in enumerate(codes))
        faults = tuple("blank" if c == "x" else "truncated" if c.isupper() else None for c in codes)
        assert dr._answer(codes, dr.NONE, dr.END, True)[:2] == cheapest(turns, faults)[:2], codes


def test_longest_search_of_a_block():
    for c in "ausoUx":
        cost, audit, _ = dr._answer(c * dr.BLOCK, dr.NONE, dr.END, True)
        assert len(audit) >= dr.BLOCK and cost <= 2 * dr.BLOCK


def test_cost_tables_agree_with_searches():
    rng = random.Random(3)
    for _ in range(50):
        codes = "".join(rng.choice("suaoSUx") for _ in range(rng.randrange(1, 9)))
        for start, costs in enumerate(dr.cost_table(codes)):
            for last, cost in enumerate(costs):
                if cost < 99:
                    after = tuple(0 if s == last else 10_000 for s in range(4))
                    assert dr.search(codes, start, after)[0] == cost
