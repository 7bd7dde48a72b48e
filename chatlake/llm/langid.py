"""Language identification with language-bitmask n-gram filters.

Model: a Bloom filter whose slots hold a bit for each language instead of one
bit.  An n-gram's slots are ANDed, which gives all languages containing it in
one look-up.  A text's n-grams are counted for each language (popcounts over
the masks), every count is corrected for the filter's false positives of that
language, and the language with the largest corrected count is the prediction;
its share of all n-grams is the score.

An n-gram is four code points of the lower-cased text, other characters than
letters read as blanks, whose inner two are letters.  A language contains it
when it occurs in its sample at ``least_share`` of the rate of the language
that uses it most.

Scale: fitted on a bounded sample (``sample_docs`` documents a language in the
mean, drawn by a hash of the id; whole texts), so the filter has a fixed size
(``2 ** slot_bits`` slots) and is sent to the workers.  Prediction is one pass
over the documents without a shuffle, in pieces of ``_CHUNK`` characters, so
a very long text costs no more memory than a short one.

Defined results: a null text or one without a letter is ``und`` with score 0;
a text with letters but no known n-gram gets the language with most sampled
documents and score 0; documents without a label or text don't train; with
nothing to train on every text is ``und``; ties go to the language first in
code point order; repeated rows are predicted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import crc32_of_id

UND = "und"
_CHUNK = 1 << 20
#: Texts a task holds as Python objects at once.
_TEXTS = 500
_HASHES = 2
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters, built once by each worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _chunks(texts: list) -> Iterator[tuple[np.ndarray, str]]:
    """(rows, joined text): slices of texts of about _CHUNK characters.

    ``rows`` has the row of every character.  Each text stands between a blank
    and two blanks of its own row, so no n-gram reaches into a neighbour.
    Slices of one text overlap by three characters, so no n-gram is lost and
    none is counted twice; a slice that doesn't end its text ends its chunk.
    """
    rows, parts, size = [], [], 0
    for k, t in enumerate(texts):
        t = f" {(t or '').lower()}  "
        for at in range(0, len(t) - 3 if len(t) > 3 else 1, _CHUNK):
            part = t[at:at + _CHUNK + 3]
            rows.append((k, len(part)))
            parts.append(part)
            size += len(part)
            if size >= _CHUNK:
                yield np.repeat([r for r, _ in rows], [n for _, n in rows]), "".join(parts)
                rows, parts, size = [], [], 0
    if parts:
        yield np.repeat([r for r, _ in rows], [n for _, n in rows]), "".join(parts)


def ngrams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash) of every n-gram, and the rows that have a letter."""
    table = _letters()
    for row, text in _chunks(texts):
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[cp]
        inner = np.flatnonzero(letter[1:-2] & letter[2:-1])
        c = np.where(letter, cp, np.uint32(32)).astype(np.uint64)
        # Four 16-bit fields, mixed; code points above 16 bits wrap into each other.
        h = (c[inner] << np.uint64(48)) ^ (c[inner + 1] << np.uint64(32)) ^ (c[inner + 2] << np.uint64(16)) ^ c[inner + 3]
        yield row[inner], h, np.unique(row[letter])


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = h * _MIX[0]
    x ^= x >> np.uint64(29)
    return [(x * m) >> np.uint64(64 - bits) for m in _MIX[1:1 + _HASHES]]


class LanguageFilter:
    """Slots of language bits, and what the correction needs."""

    def __init__(self, langs: list[str], most_common: str, slot_bits: int):
        self.langs, self.most_common, self.bits = langs, most_common, slot_bits
        self.words = -(-len(langs) // 64)
        kind = next((t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(langs) <= n), np.uint64)
        self.slots = np.zeros((self.words, 1 << slot_bits), kind)

    def add(self, lang: np.ndarray, h: np.ndarray) -> None:
        bit = self.slots.dtype.type(1) << (lang % 64).astype(self.slots.dtype)
        for s in _slots(h, self.bits):
            np.bitwise_or.at(self.slots, (lang // 64, s), bit)

    def close(self) -> "LanguageFilter":
        """False-positive rate of each language: its slot fill to the power of the hashes."""
        one = self.slots.dtype.type(1)
        self.wrong = np.array([(self.slots[k // 64] >> self.slots.dtype.type(k % 64) & one).mean() ** _HASHES
                               for k in range(len(self.langs))])
        return self

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of each language, n-grams, and has-a-letter, by text."""
        hits = np.zeros((len(texts), len(self.langs)), np.int64)
        grams, letter = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        one = self.slots.dtype.type(1)
        for row, h, lettered in ngrams(texts):
            letter[lettered] = True
            grams += np.bincount(row, minlength=len(texts))
            where = _slots(h, self.bits)
            for w in range(self.words):
                mask = self.slots[w][where[0]]
                for s in where[1:]:
                    mask &= self.slots[w][s]
                for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                    has = (mask >> self.slots.dtype.type(k % 64)) & one
                    hits[:, k] += np.bincount(row[has.astype(bool)], minlength=len(texts))
        return hits, grams, letter

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        hits, grams, letter = self.counts(texts)
        true = np.clip((hits - grams[:, None] * self.wrong) / (1 - np.minimum(self.wrong, 0.99)), 0, grams[:, None])
        best = true.argmax(axis=1)
        score = true[np.arange(len(texts)), best] / np.maximum(grams, 1)
        none = score <= 0
        names = [UND if not has else self.most_common if no else self.langs[k]
                 for has, no, k in zip(letter, none, best)]
        return names, np.where(letter, score, 0.0)


def fit(docs: DataFrame, sample_docs: int = 1000, slot_bits: int = 22, least_share: float = 0.05,
        least_count: int = 2) -> LanguageFilter:
    """Fit on labelled rows (text, lang, doc_id): a bounded sample of each language."""
    rows = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageFilter([], UND, 1).close()
    at = {lang: k for k, lang in enumerate(langs)}
    # The share of each language's documents that are drawn, as a bound on a hash of the id.
    pairs = [x for lang in langs for x in (F.lit(lang), F.struct(
        F.lit(at[lang]).alias("k"), F.lit(int(min(1.0, sample_docs / sizes[lang]) * 1e9)).alias("most")))]
    rows = rows.withColumn("l", F.create_map(*pairs)[F.col("lang")]).where(
        F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000_000)) < F.col("l.most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for row, h, _ in ngrams(texts):
                for k in np.unique(lang):
                    g, n = np.unique(h[lang[row] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n)],
                        names=["k", "gram", "n"])

    grams = (rows.select(F.col("l.k").cast("int").alias("k"), "text")
             .mapInArrow(count, "k int, gram long, n long")
             .groupBy("k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    found = grams.toPandas()  # bounded by the sample
    total = found.groupby("k")["n"].transform("sum")
    found["rate"] = found["n"] / total
    found = found[found["rate"] >= least_share * found.groupby("gram")["rate"].transform("max")]
    f = LanguageFilter(langs, max(langs, key=lambda x: (sizes[x], x)), slot_bits)
    f.add(found["k"].to_numpy(), found["gram"].to_numpy(np.int64).view(np.uint64))
    return f.close()


def identify(docs: DataFrame, model: LanguageFilter, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``keep`` columns, doc_id, lang_pred and score of every document, whose text is the column ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    cols = list(dict.fromkeys(["doc_id", *keep]))
    src = list(dict.fromkeys([*cols, text]))  # a text that is kept is not sent twice
    at = src.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _TEXTS):
                part = b.slice(k, _TEXTS)
                names, score = sent.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(cols)], pa.array(names, pa.string()), pa.array(score)],
                                                 names=[*cols, "lang_pred", "score"])

    from pyspark.sql import types as T
    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return docs.select(*src).mapInArrow(run, schema)


def predict_languages(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents not held out."""
    fold = F.pmod(crc32_of_id("doc_id"), F.lit(3))
    model = fit(docs.where(F.coalesce(fold != 1, F.lit(False))), **params)
    return identify(docs, model).withColumn("held_out", F.coalesce(fold == 1, F.lit(False))).select(
        "doc_id", "held_out", "lang_pred", "score")
