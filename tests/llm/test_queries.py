"""The registered queries: oracles at sf0.01, columns, and independence of the subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from chatlake.llm import queries

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_langid": "doc_id held_out lang_pred score",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_url_filters": "page_id host path rule verdict",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_topk": "query_id rank vec_id score",
    "op10_mixing": "doc_id size source_size target taken",
    "op11_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_columns(spark, key):
    assert queries.QUERIES[key](spark, SF).columns[: len(COLUMNS[key].split())] == COLUMNS[key].split()


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(queries.ORACLES[key])
    names = [d[0] for d in res.description]
    want = sorted((tuple(repr(x) for x in r) for r in res.fetchall()))
    got = queries.QUERIES[key](spark, SF).select(*names).collect()
    assert len(got) > 0 and sorted(tuple(repr(x) for x in r) for r in got) == want


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLES) <= set(E.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(E.__file__))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "for m in ('chatlake.dataset', 'chatlake.operators.derive', 'chatlake.operators.vectors',\n"
            "          'chatlake.operators.store', 'chatlake.sources.history_csv', 'chatlake.fixtures'):\n"
            "    __import__(m)\n"
            "assert not any(m.startswith('chatlake.llm') for m in sys.modules)\n" % root)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
