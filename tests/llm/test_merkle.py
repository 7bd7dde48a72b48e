"""Merkle manifests against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chatlake.llm import merkle, queries


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    out = ""
    for v in row:
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def climb(nodes, arity):
    """(root, proof of every node as lists of (left, right))."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k in range(len(nodes)):
            run = level[at[k] // arity * arity:][:arity]
            s = at[k] % arity
            proofs[k].append(("".join(run[:s]), "".join(run[s + 1:])))
        at = [a // arity for a in at]
        level = [H("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
    return level[0], proofs


def brute(rows, arity=3):
    """Sorted rows of the query, from (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r[0]), leaf(r))):
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([leaf(r) for r in groups[k]], arity) for k in keys]
    root, upper = climb([t[0] for t in trees], arity)
    out = []
    for k, (sub, proofs), up in zip(keys, trees, upper):
        for r, p in zip(groups[k], proofs):
            bad = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                bad = (*r[:4], r[4].replace("\n", ""))
            h = leaf(bad)
            for x, y in p + up:
                h = H(x + h + y)
            out.append((r[0], leaf(r), sub, root, H("".join(x + y for x, y in p + up)), h, h == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(
        [(*r[:4], r[4], "x", 1, "y") for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string, h string, idx int, tree string")


def query(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op13_merkle(spark, str(tmp_path))


CASES = {
    "groups": [(i, f"s{i % 4}", "en", i * 3, f"line {i}\nnext é") for i in range(60)]
    + [(100 + i, None, None, None, None if i % 2 else "") for i in range(5)]
    + [(200, "alone", "de", 4, "a\nb"), (None, "s1", "fr", 1, "no id\n"), (None, None, "fr", 1, "x\n"),
       (300, "", "en", 0, "the empty source"), (301, "é", "en", 1, "\n\n\n"), (302, "-", "en", 1, "a" * 70_000 + "\n")]
    + [(7, "s3", "en", 21, "line 7\nnext é")] * 3 + [(8, "s0", "de", 1, "same id, other row\n")],
    "one row": [(2, "a", "en", 3, "a\nb")],
    "one group": [(i, "a", "en", 3, "a\nb") for i in range(10)],
    "groups of one": [(i, f"g{i:02}", "en", 3, "a\nb") for i in range(11)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_rows(spark, tmp_path, case):
    got = query(spark, tmp_path, CASES[case])
    assert got.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert sorted(map(tuple, got.collect()), key=str) == brute(CASES[case])


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_arity(spark, arity):
    rows = CASES["groups"]
    got = merkle.verify(merkle.document_manifest(table(spark, rows), arity), "tampered").select(
        "doc_id", *[merkle.hexed(c) for c in ("leaf", "subroot", "root")], F.sha2(merkle.proof_text("proof"), 256),
        merkle.hexed("folded_root"), "verified")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, arity)


def test_untampered_rows_verify(spark):
    rows = merkle.verify(merkle.document_manifest(table(spark, CASES["groups"])))
    assert rows.where("verified").count() == len(CASES["groups"])


def test_empty(spark, tmp_path):
    assert query(spark, tmp_path, []).collect() == []
