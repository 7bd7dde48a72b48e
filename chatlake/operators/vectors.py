"""Vector search and embedding.

``semantic_search`` compares one query vector with every stored vector.
The query is one vector of a fixed width (the reference embeds the query
text on the driver too), so tasks get it with their code: the stored
vectors are scanned once, each task scores its own slice and keeps
a top-k heap (TakeOrderedAndProject), and only k rows per task reach the
final merge.  Rows with a zero-length vector get a NULL score; they sort
after every real score, so dropping them after the cut gives the same
rows as dropping them before it.  Metadata is joined after the cut, as the
reference does (an id without a conversation is dropped there).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.operators import browse, derive

EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
BATCH_SIZE = 128
EMBED_CHUNK = 2000


def query_vector(embeddings: DataFrame, conversation_id) -> list[float] | None:
    """A stored vector, fetched once (one row of a fixed width) to use as the query."""
    row = (embeddings.where(F.col("conversation_id") == conversation_id)
           .select("embedding").limit(1).first())
    return None if row is None or row[0] is None else [float(x) for x in row[0]]


def similarity(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """(conversation_id, similarity) for every stored vector.

    Arrow batches are scored as a matrix-vector product in double.  Zero
    vectors, and vectors of another width than the query, give NULL.
    """
    q = np.asarray(query, dtype=np.float64)
    q_norm = float(np.sqrt(q @ q))

    @F.pandas_udf(T.DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype="Float64", index=vectors.index)
        fits = vectors.map(lambda v: v is not None and len(v) == len(q)).astype(bool)
        if q_norm > 0 and fits.any():
            m = np.stack(vectors[fits].to_numpy()).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", m, m)) * q_norm
            real = norms > 0
            out.loc[vectors.index[fits][real]] = (m[real] @ q) / norms[real]
        return out

    return embeddings.select("conversation_id", score("embedding").alias("similarity"))


def semantic_search(embeddings: DataFrame, conversations: DataFrame,
                    summaries: DataFrame | None, query: list[float], limit: int = 20,
                    digits: int | None = 6) -> DataFrame:
    """Top-``limit`` conversations by cosine similarity."""
    top = (similarity(embeddings, query)
           .orderBy(F.desc_nulls_last("similarity"), F.asc("conversation_id")).limit(limit)
           .where(F.col("similarity").isNotNull())
           .checkpoint(eager=True))
    # ``top`` holds at most ``limit`` rows, written once (so the vectors are
    # scanned once although it is used twice): broadcasting it is bounded by
    # the limit, and the big tables are only filtered by its ids.
    ids = F.broadcast(top.select("conversation_id"))
    conv = conversations.select(F.col("id").alias("conversation_id"), "topic", "date", "model")
    out = F.broadcast(top).join(conv, "conversation_id")
    if summaries is not None:
        hits = summaries.select("conversation_id", "summary", "key_topics", "sentiment",
                                "outcome").join(ids, "conversation_id", "left_semi")
        out = out.join(hits, "conversation_id", "left")
    else:
        for c, t in (("summary", "string"), ("key_topics", "array<string>"),
                     ("sentiment", "string"), ("outcome", "string")):
            out = out.withColumn(c, F.lit(None).cast(t))
    sim = F.round("similarity", digits) if digits is not None else F.col("similarity")
    return (out.select(F.col("conversation_id").alias("id"), "topic", "date", "model", "summary",
                       "key_topics", "sentiment", "outcome", sim.alias("similarity"))
            .orderBy(F.desc("similarity"), F.asc("id")))


def search_text(embeddings: DataFrame, conversations: DataFrame, summaries: DataFrame | None,
                query: str, factory: EncoderFactory, limit: int = 20,
                digits: int | None = 6) -> DataFrame:
    """V1: search by text; the encoder embeds the retrieval prefix and the query."""
    vector = [float(x) for x in factory()([QUERY_PREFIX + query])[0]]
    return semantic_search(embeddings, conversations, summaries, vector, limit, digits)


# -- embedding (U2: pluggable encoder) -------------------------------------------------

def hashed_token_encoder(dim: int = 64) -> EncoderFactory:
    """Deterministic stand-in encoder: hashed word counts.

    Not a language model: it exists so the embedding pipeline can run and be
    tested without model weights.  Plug a real encoder factory in its place.
    """
    def factory():
        import hashlib

        place: dict[str, int] = {}

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for tok in t.lower().split():
                    at = place.get(tok)
                    if at is None:
                        at = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
                        if len(place) < derive.WORDS:
                            place[tok] = at
                    out[i, at] += 1.0
            return out
        return encode
    return factory


def encoder_udf(factory: EncoderFactory, batch_size: int = BATCH_SIZE):
    """Batch prediction: the encoder is built once per worker and sees ``batch_size`` texts at a time."""
    def make_predict():
        encode = factory()
        return lambda texts: np.asarray(encode([t or "" for t in texts.tolist()]), dtype=np.float32)
    return predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def pooled(vectors: DataFrame) -> DataFrame:
    """(conversation_id, embedding): the mean of (conversation_id, v, weight) vectors, of unit length.

    A partial aggregate of running means: a conversation with any number of
    pieces is one vector per task.
    """
    mean = Summarizer.mean(array_to_vector(F.col("v")), F.col("weight"))
    m = vectors.groupBy("conversation_id").agg(vector_to_array(mean).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda total, x: total + x * x))
    m = m.withColumn("norm", norm)
    return m.select("conversation_id", F.transform("m", lambda x: F.when(F.col("norm") > 0, x / F.col("norm"))
                                                   .otherwise(x).cast("float")).alias("embedding"))


def embed_conversations(conversations: DataFrame, messages: DataFrame | None,
                        summaries: DataFrame | None, embeddings: DataFrame | None,
                        factory: EncoderFactory, model_name: str = "hashed-64",
                        batch_size: int = BATCH_SIZE, chunk: int = EMBED_CHUNK) -> tuple[DataFrame, DataFrame]:
    """V2: vectors for conversations not yet embedded; (new rows, counters).

    A text is embedded in pieces of ``chunk`` characters (a message begins a
    piece), whose vectors are averaged by length: encoders see bounded texts,
    and no conversation is put together anywhere.  Blank texts are skipped and
    counted.
    """
    todo = browse.unembedded_conversations(conversations, embeddings)
    conv = conversations.join(todo.select("id"), "id", "left_semi")
    pieces = derive.embedding_chunks(conv, summaries, messages, chunk)
    blank = derive.is_blank(F.col("text"))
    vectors = pieces.where(~blank).select("conversation_id", encoder_udf(factory, batch_size)(F.col("text")).alias("v"),
                                          F.length("text").cast("double").alias("weight"))
    rows = pooled(vectors).select("conversation_id", "embedding", F.lit(model_name).alias("model"),
                                  F.current_timestamp().alias("created_at"))
    each = pieces.groupBy("conversation_id").agg(F.bool_and(blank).alias("blank"))
    counters = each.agg(F.count_if(~F.col("blank")).alias("embedded"), F.count_if("blank").alias("skipped"))
    return rows, counters


def encode_float32(vector_col: F.Column) -> F.Column:
    """array<float> -> raw little-endian float32 bytes."""
    @F.pandas_udf(T.BinaryType())
    def enc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
    return enc(vector_col)


def decode_float32(blob_col: F.Column) -> F.Column:
    """Raw little-endian float32 bytes (BLOB) -> array<float>."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dec(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").copy())
    return dec(blob_col)
