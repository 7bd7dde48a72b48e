"""The registered queries of the subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import (bpe, dialog_repair, kneser_ney, langid, merkle, mixing, packing, quality, sharding, simhash,
                          suffix_dedup, topk, urlfilter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16).drop("group_key")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_corpus(_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "rejected_by")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, query_step=20, scale=64)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verify(merkle.document_manifest(_table(spark, sf_dir, "documents")), "tampered")
    return found.select("doc_id", *[merkle.hexed(c).alias(c) for c in ("leaf", "subroot", "root")],
                        F.sha2(merkle.proof_text("proof"), 256).alias("proof_sha256"),
                        merkle.hexed("folded_root").alias("folded_root"), "verified")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_langid": op4_langid,
    "op5_packing": op5_packing,
    "op6_url_filters": op6_url_filters,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_topk": op9_topk,
    "op10_mixing": op10_mixing,
    "op11_bpe": op11_bpe,
    "op12_repair": op12_repair,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op9_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op10_mixing": r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM base GROUP BY source),
weighed AS (
  SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 3e0 * source_size AS most
  FROM by_source),
levels AS (
  SELECT *, most / weight AS full_at,
         (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
         / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
src AS (
  SELECT source, no, source_size, least(most, coalesce(
           (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, no LIMIT 1) * weight, most)) AS target
  FROM levels),
rows AS (
  SELECT b.doc_id, b.source, b.size, s.no, s.source_size, s.target,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0e0 END AS ratio,
         (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(b.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
          + 5e-1) / 4503599627370496e0 AS u
  FROM base b JOIN src s ON b.source IS NOT DISTINCT FROM s.source),
sized AS (
  SELECT no, size, count(*) AS n, any_value(target - floor(ratio) * source_size) AS rest
  FROM rows WHERE size > 0 AND ratio > floor(ratio) AND size <= 2 * (target - floor(ratio) * source_size)
  GROUP BY no, size),
rates AS (
  SELECT no, arg_max(rate, size) AS rate FROM (
    SELECT no, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY no ORDER BY size DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / CAST(sum(n * size * size) OVER (PARTITION BY no ORDER BY size) AS DOUBLE) AS rate FROM sized)
  WHERE rate * size <= 1 GROUP BY no),
scored AS (
  SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS share,
         CASE WHEN size > 2 * (target - floor(ratio) * source_size) THEN CAST('infinity' AS DOUBLE)
              WHEN rate * size >= 1 THEN 0e0
              WHEN rate * size > 0 THEN (u / (1 - u)) / ((rate * size) / (1 - rate * size))
              ELSE CAST('infinity' AS DOUBLE) END AS score
  FROM rows LEFT JOIN rates USING (no)),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY no ORDER BY score, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
  FROM scored),
taken AS (
  SELECT *, CAST(whole AS BIGINT) + CASE WHEN share > 0 AND words_before + size / 2e0 <= target - whole * source_size
                                         THEN 1 ELSE 0 END AS copies
  FROM ranked)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies
FROM taken""",
    "op13_merkle": r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, text,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
                coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         CASE WHEN (4294967295 - crc) % 2 = 0
              THEN sha256(concat(head, coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')))
              ELSE sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) END AS bad
  FROM base),
numbered AS (
  SELECT *, coalesce('=' || source, '-') AS tree, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
low(tree, lvl, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM numbered
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1
  GROUP BY tree, lvl, idx // 3, n),
subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, idx, n, h) AS (
  SELECT 0, idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1
  GROUP BY lvl, idx // 3, n),
depth AS (SELECT tree, max(lvl) AS top FROM low GROUP BY tree),
sides AS (
  SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM low a LEFT JOIN low b ON b.tree = a.tree AND b.lvl = a.lvl AND b.idx // 3 = a.idx // 3 AND b.idx <> a.idx
  WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.idx),
high_sides AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM high a LEFT JOIN high b ON b.lvl = a.lvl AND b.idx // 3 = a.idx // 3 AND b.idx <> a.idx
  WHERE a.n > 1 GROUP BY a.lvl, a.idx),
all_sides AS (
  SELECT tree, lvl, idx, l, r FROM sides
  UNION ALL
  SELECT s.tree, d.top + h.lvl, h.idx, h.l, h.r
  FROM subroots s JOIN depth d USING (tree) JOIN high_sides h ON h.idx = s.idx // CAST(pow(3, h.lvl) AS BIGINT)),
folded(tree, idx, lvl, h, proof) AS (
  SELECT n.tree, n.idx, 0, n.bad, '' FROM numbered n
  UNION ALL
  SELECT f.tree, f.idx, f.lvl + 1, sha256(concat(s.l, f.h, s.r)), concat(f.proof, s.l, s.r)
  FROM folded f JOIN depth d ON d.tree = f.tree JOIN subroots r ON r.tree = f.tree
  JOIN all_sides s ON s.tree = f.tree AND s.lvl = f.lvl
    AND s.idx = CASE WHEN f.lvl < d.top THEN f.idx // CAST(pow(3, f.lvl) AS BIGINT)
                     ELSE r.idx // CAST(pow(3, f.lvl - d.top) AS BIGINT) END),
done AS (SELECT tree, idx, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM folded GROUP BY tree, idx)
SELECT n.doc_id, n.leaf, s.h AS subroot, top.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root,
       f.h = top.h AS verified
FROM numbered n JOIN subroots s ON s.tree = n.tree JOIN done f ON f.tree = n.tree AND f.idx = n.idx,
     (SELECT h FROM high WHERE n = 1) top""",
}
