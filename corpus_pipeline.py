"""Corpus pipeline: documents to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame of one
operator; ``run`` applies them to ``documents`` and writes every stage's rows
to the shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import langid, mixing, packing, simhash, suffix_dedup
from chatlake.llm.common import crc32_of_id, scratch

#: A document is in no known language when fewer of its n-grams than this are known to it.
LEAST_SCORE = 0.2
#: Bytes of the shortest passage that counts as repeated: 51 words of three letters have 203.
PASSAGE = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` stays the given label."""
    fold = F.pmod(crc32_of_id("doc_id"), F.lit(3))
    model = langid.fit(docs.where(F.coalesce(fold != 1, F.lit(False))))
    # The result columns must not clash with columns the documents have already.
    named = docs.select(*[F.col(c).alias(f"in_{c}") if c != "doc_id" else F.col(c) for c in docs.columns])
    found = langid.identify(named, model, keep=tuple(f"in_{c}" for c in docs.columns if c != "doc_id"), text="in_text")
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"in_{c}").alias(c) if c != "doc_id" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return simhash.one_of_each(docs, words=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings of ``PASSAGE`` bytes that occur more than once."""
    return suffix_dedup.without_repeats(docs, PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.repeat_copies(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, capacity=1024, end_id=2)


STAGES = [
    ("language identification", language),
    ("SimHash near-duplicates", near_duplicates),
    ("suffix-array deduplication", repeated_passages),
    ("mixing sources", mixture),
    ("best-fit packing", sequences),
]

#: No stage but the mix can be put in SQL; the tests hold ``run`` against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
