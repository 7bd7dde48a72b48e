"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark over all training documents and the finished model is
a folder of sorted arrays in the shared folder, which workers memory-map:

``vocab``   sorted 64-bit word hashes and counts, in ranges of the hash; a
            word's id is its position;
``bigrams`` sorted keys ``context id << 32 | word id`` and counts, in ranges;
``words``   continuation probability, back-off weight and context count of
            every word id.

p(w | v) = (c(vw) - D(c(vw))) / c(v.) + g(v) p(w), where p(w) is the
discounted share of distinct words seen before w, interpolated with the
uniform probability of the vocabulary and one unknown word.  The three
discounts of either order come from the counts of counts.

Scale: tasks count in numpy what they read and pass on sorted, compressed
blocks for each key range; ranges are cut from a sample of keys so that a
frequent context spans several, and hold about ``RANGE`` entries at any size
of the corpus.  Each range is merged, written to a temporary name and renamed
by one task, so a repeated task leaves the same files.  Looking up sorted
unique keys touches the mapped files in order.  The shared folder has to be
mounted as a file system by all workers, which mapping needs.

Defined results: null and empty texts are the end token alone; texts are
tokenised whole; repeated rows count as often as they occur; a null doc_id is
neither held out nor trained on; without training rows every token has
probability 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LOWER, crc32_of_id, n_groups, scratch, stored

#: Entries of a range of words or bigrams, bytes of text counted at a time.
RANGE, CHUNK = 2_000_000, 8_000_000
#: Word ids, the start's included, take 32 bits of a bigram key.
MOST_WORDS = (1 << 32) - 1
_BLOCK = 1 << 20
_BASE, _SALT, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Hash of the end token; no word has it but by chance.
END = np.uint64(0x5851F42D4C957F2D)

_LOWER = np.frombuffer(LOWER, np.uint8)
_IS_WS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        both = np.ones((2, max(n, _BLOCK + 4096)), np.uint64)
        both[0, 1:], both[1, 1:] = _BASE, _INVERSE
        _POWERS = tuple(np.cumprod(both, axis=1, dtype=np.uint64))
    return _POWERS


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text, and tokens a text."""
    a = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)]
    blank = _IS_WS[a]
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = np.empty(len(first), np.uint64)
    done = 0
    while done < len(first):  # blocks of whole words
        upto = max(done + 1, int(np.searchsorted(last, first[done] + _BLOCK)))
        s, e = first[done:upto] - first[done], last[done:upto] - first[done]
        power, inverse = _powers(int(e[-1]) + 1)
        part = a[first[done]: last[upto - 1]].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        x = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _SALT
        x ^= x >> np.uint64(32)
        h[done:upto] = x * _STIR
        done = upto
    size = np.array([len(t or b"") for t in texts], np.int64)
    n = np.diff(np.searchsorted(first, np.cumsum(size + 1) - 1), prepend=0)
    out = np.empty(len(h) + len(texts), np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)] = h
    out[np.cumsum(n + 1) - 1] = END
    return out, n + 1


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= CHUNK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


# --- files ---------------------------------------------------------------------

def _folder(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers can't memory-map files of {path}: the shared folder must be a mounted file system")
    return unquote(url.path)


def _save(path: str, **arrays: np.ndarray) -> None:
    """Write arrays beside their names and rename them, one file an array."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for name, x in arrays.items():
        temp = f"{path}.{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(temp, "wb") as f:
            np.save(f, x)
        os.replace(temp, f"{path}.{name}.npy")


class Ranges:
    """Sorted keys in ranges, each range memory-mapped when first touched."""

    def __init__(self, folder: str, cuts: np.ndarray, names: tuple[str, ...]):
        self.folder, self.cuts, self.names, self.open = folder, cuts, names, {}

    def part(self, r: int) -> tuple[np.ndarray, ...]:
        if r not in self.open:
            at = f"{self.folder}/{r}"
            missing = [n for n in self.names if not os.path.exists(f"{at}.{n}.npy")]
            if missing:
                # Every range is written, empty ones as well: a worker that doesn't see one doesn't share the folder.
                raise FileNotFoundError(f"model range {at} has no {missing} here: is the shared folder mounted?")
            self.open[r] = tuple(np.load(f"{at}.{n}.npy", mmap_mode="r") for n in self.names)
        return self.open[r]

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The ranges that sorted keys fall in."""
        edge = np.concatenate([[0], np.searchsorted(keys, self.cuts), [len(keys)]])
        for r in np.flatnonzero(np.diff(edge)):
            yield int(r), slice(int(edge[r]), int(edge[r + 1]))


def _pack(x: np.ndarray) -> bytes:
    """Compressed bytes of numbers, byte planes first."""
    import zstandard

    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(t).max)
    x = x.astype(kind)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    planes = planes.reshape(b[0], len(planes) // b[0])
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").reshape(-1).astype(np.uint64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


# --- model -----------------------------------------------------------------------

class Vocabulary:
    """Word hash -> id and count."""

    def __init__(self, folder: str, bits: int, offsets: np.ndarray, total: int):
        #: offsets[r]: id of the first word of range r; its last entry is the vocabulary size.
        self.folder, self.bits, self.offsets, self.total = folder, bits, offsets, total

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def ranges(self) -> Ranges:
        cuts = np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits else \
            np.zeros(0, np.uint64)
        return Ranges(f"{self.folder}/vocab", cuts, ("hash", "count"))

    def find(self, ranges: Ranges, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted hashes; -1 and 0 for unknown words."""
        ids, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for r, s in ranges.split(h):
            known, n = ranges.part(r)
            at = np.searchsorted(known, h[s])
            hit = at < len(known)
            hit[hit] = known[at[hit]] == h[s][hit]
            ids[s] = np.where(hit, at + self.offsets[r], -1)
            count[s][hit] = n[at[hit]]
        return ids, count


def count_words(train: DataFrame, folder: str) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.large_binary()).to_pylist()
            for i, j in _chunks(texts):
                h, n = np.unique(tokens(texts[i:j])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    words = stored(train.select("text").mapInArrow(count, "h long, n long")
                   .groupBy("h").agg(F.sum("n").alias("n")), "words")
    bits = (n_groups(words.count(), RANGE) - 1).bit_length()
    top = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        r, pdf = int(pdf["r"].iloc[0]), pdf[pdf["n"] > 0]
        h = pdf["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        n = pdf["n"].to_numpy(np.int64)[order]
        _save(f"{folder}/vocab/{r}", hash=h[order], count=n)
        return pd.DataFrame({"r": [r], "words": [len(h)], "total": [int(n.sum())]})

    # A row of no word (n = 0; a null hash would turn the others into doubles) for every range, so that ranges
    # without words are written as well.
    marks = train.sparkSession.range(1 << bits).select(
        F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("n"), F.col("id").cast("int").alias("r"))
    done = (words.select("h", "n", top.alias("r")).unionByName(marks).groupBy("r")
            .applyInPandas(write, "r int, words long, total long").collect())  # one row a range
    sizes = np.zeros(1 << bits, np.int64)
    for d in done:
        sizes[d["r"]] = d["words"]
    if sizes.sum() >= MOST_WORDS:
        raise ValueError(f"{sizes.sum()} different words: the keys hold ids of 32 bits")
    return Vocabulary(folder, bits, np.concatenate([[0], np.cumsum(sizes)]), sum(d["total"] for d in done))


def _bigram_keys(texts: list, vocab: Vocabulary, ranges: Ranges) -> np.ndarray:
    """Keys of all bigrams of the texts; the start's id is the vocabulary size."""
    h, n = tokens(texts)
    known, where = np.unique(h, return_inverse=True)
    ids = vocab.find(ranges, known)[0][where].astype(np.uint64)
    before = np.concatenate([ids[:1], ids[:-1]])
    before[np.cumsum(n) - n] = vocab.size
    return (before << np.uint64(32)) | ids


def count_bigrams(train: DataFrame, vocab: Vocabulary, sample_docs: int = 2000) -> tuple[np.ndarray, DataFrame]:
    """Write the bigram ranges; the cuts, and sums for each word id.

    Sums of a word as context: its count, and how many words follow it once,
    twice, more often; as a word: how many contexts it has (``cont``).  The row
    of id -1 has how many bigrams occur 1, 2, 3 and 4 times.
    """
    parts = n_groups(vocab.total, RANGE)
    docs = train.count()
    share = F.lit(max(1, -(-docs // sample_docs)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = vocab.ranges()
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()).to_pylist():
                keys = _bigram_keys([t], vocab, ranges)
                keys = keys[:: max(1, len(keys) // 500)]  # only to place the cuts
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["k"])

    seen = (train.where(F.pmod(F.xxhash64(F.lit("cuts"), "doc_id"), share) == 0).select("text")
            .mapInArrow(sample, "k long").toPandas()["k"].to_numpy(np.int64).view(np.uint64))
    cuts = np.unique(np.sort(seen)[np.arange(1, parts) * len(seen) // parts]) if len(seen) else np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = vocab.ranges()
        for b in batches:
            texts = b.column(0).cast(pa.large_binary()).to_pylist()
            for i, j in _chunks(texts):
                k, n = np.unique(_bigram_keys(texts[i:j], vocab, ranges), return_counts=True)
                out = []
                for r, s in Ranges("", cuts, ()).split(k):
                    part = k[s]
                    out.append((r, _pack(np.diff(part, prepend=np.uint64(0))), _pack(n[s])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                     pa.array([o[2] for o in out], pa.binary())], names=["r", "k", "n"])

    folder = f"{vocab.folder}/bigrams"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _merged([np.cumsum(_unpack(x), dtype=np.uint64) for x in pdf["k"]], [_unpack(x) for x in pdf["n"]])
        big = np.flatnonzero(c >= 255)
        _save(f"{folder}/{int(pdf['r'].iloc[0])}", key=k, count=np.minimum(c, 255).astype(np.uint8),
              big=big, bigcount=c[big])
        if not len(k):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "total", "n1", "n2", "n3", "cont")})
        v, w = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        ctx = pd.DataFrame({"id": v[first], "total": np.add.reduceat(c, first)})
        for name, x in (("n1", c == 1), ("n2", c == 2), ("n3", c > 2)):
            ctx[name] = np.add.reduceat(x.astype(np.int64), first)
        word, cont = np.unique(w, return_counts=True)
        words = pd.DataFrame({"id": word, "total": 0, "n1": 0, "n2": 0, "n3": 0, "cont": cont})
        kinds = pd.DataFrame({"id": [-1], **{n: [int((c == x).sum())] for x, n in enumerate(
            ("total", "n1", "n2", "n3"), 1)}})
        out = pd.concat([ctx.assign(cont=0), words, kinds.assign(cont=0)])
        return out[["id", "total", "n1", "n2", "n3", "cont"]]

    cols = ("total", "n1", "n2", "n3", "cont")
    none = _pack(np.zeros(0, np.uint64))
    marks = train.sparkSession.range(len(cuts) + 1).select(
        F.col("id").cast("int").alias("r"), F.lit(none).alias("k"), F.lit(none).alias("n"))
    sums = (train.select("text").mapInArrow(count, "r int, k binary, n binary").unionByName(marks).groupBy("r")
            .applyInPandas(merge, "id long, " + ", ".join(f"{c} long" for c in cols))
            .groupBy("id").agg(*[F.sum(c).alias(c) for c in cols]))
    return cuts, stored(sums, "wordsums")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the counts of counts; 0 <= D <= count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * b / a if a else float(k) * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


class Model:
    """What a worker needs to score: the folder and a few numbers."""

    def __init__(self, vocab: Vocabulary, cuts: np.ndarray, d_bigram, unknown: float):
        self.vocab, self.cuts, self.d, self.unknown = vocab, cuts, np.array([0.0, *d_bigram]), unknown

    def maps(self) -> tuple[Ranges, Ranges, Ranges]:
        ids = self.vocab.offsets[1:-1].astype(np.uint64)
        return (self.vocab.ranges(), Ranges(f"{self.vocab.folder}/words", ids, ("p", "g", "c")),
                Ranges(f"{self.vocab.folder}/bigrams", self.cuts, ("key", "count", "big", "bigcount")))

    def score(self, texts: list, maps) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base and model log10 probability of every text."""
        vocab, words, bigrams = maps
        h, n = tokens(texts)
        known, where = np.unique(h, return_inverse=True)
        ids, count = self.vocab.find(vocab, known)
        p, g, c = np.full((3, len(known) + 1), 0.0)
        p[:-1] = self.unknown
        order = np.argsort(ids)
        order = order[ids[order] >= 0]
        start = self.vocab.size  # the start is the last context
        look = np.append(ids[order], start).astype(np.uint64)
        to = np.append(order, len(known))
        for r, s in words.split(look) if self.vocab.size else ():
            pp, gg, cc = words.part(r)
            if len(pp):
                at = (look[s] - np.uint64(self.vocab.offsets[r])).astype(np.int64)
                p[to[s]], g[to[s]], c[to[s]] = pp[at], gg[at], cc[at]
        firsts = np.cumsum(n) - n
        before = np.concatenate([where[:1], where[:-1]])
        before[firsts] = len(known)
        # Distinct (context, word) pairs of the chunk, looked up in key order.
        pair, back = np.unique(before.astype(np.int64) * (len(known) + 1) + where, return_inverse=True)
        v, w = pair // (len(known) + 1), pair % (len(known) + 1)
        vid, wid = np.append(ids, start)[v], ids[w]
        seen = np.zeros(len(pair), np.int64)
        both = np.flatnonzero((vid >= 0) & (wid >= 0))
        key = (vid[both].astype(np.uint64) << np.uint64(32)) | wid[both].astype(np.uint64)
        sort = np.argsort(key)
        both, key = both[sort], key[sort]
        for r, s in bigrams.split(key):
            k, few, big, many = bigrams.part(r)
            at = np.searchsorted(k, key[s])
            hit = at < len(k)
            hit[hit] = k[at[hit]] == key[s][hit]
            at = at[hit]
            found = few[at].astype(np.int64)
            over = found == 255
            if over.any():
                found[over] = many[np.searchsorted(big, at[over])]
            seen[both[s][hit]] = found
        use = c[v] > 0
        prob = p[w].copy()
        prob[use] = (np.maximum(seen[use] - self.d[np.minimum(seen[use], 3)], 0) / c[v[use]] + g[v[use]] * p[w[use]])
        base = np.log10((count + 0.1) / (self.vocab.total + 0.1 * (self.vocab.size + 1)))
        return (n, np.add.reduceat((count > 0)[where].astype(np.int64), firsts),
                np.add.reduceat(base[where], firsts), np.add.reduceat(np.log10(prob)[back], firsts))


def fit(train: DataFrame, folder: str) -> Model:
    vocab = count_words(train, folder)
    if not vocab.size:
        return Model(vocab, np.zeros(0, np.uint64), (0, 0, 0), 1.0)
    cuts, sums = count_bigrams(train, vocab)
    kinds = sums.where("id = -1").first()
    d2 = discounts(kinds["total"], kinds["n1"], kinds["n2"], kinds["n3"])
    u = sums.where("id >= 0").agg(F.sum("cont").alias("all"), *[
        F.sum((F.col("cont") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)],
        F.sum((F.col("cont") > 2).cast("long")).alias("more")).first()
    d1 = discounts(u["n1"], u["n2"], u["n3"], u["n4"])
    rest = (d1[0] * u["n1"] + d1[1] * u["n2"] + d1[2] * u["more"]) / u["all"] / (vocab.size + 1)
    everything, offsets = u["all"], vocab.offsets

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["r"].iloc[0])
        n = int(offsets[r + 1] - offsets[r]) + (r == len(offsets) - 2)  # the start comes last
        p, g, c = np.full(n, rest), np.zeros(n), np.zeros(n, np.int64)
        at = pdf["id"].to_numpy() - offsets[r]
        cont, total = pdf["cont"].to_numpy(), pdf["total"].to_numpy()
        p[at] += np.maximum(cont - np.array([0.0, *d1])[np.minimum(cont, 3)], 0) / everything
        g[at] = (d2[0] * pdf["n1"] + d2[1] * pdf["n2"] + d2[2] * pdf["n3"]).to_numpy() / np.maximum(total, 1)
        c[at] = total
        _save(f"{folder}/words/{r}", p=p, g=g, c=c)
        return pd.DataFrame({"r": [r]})

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # The last range holds the start, whose id is the vocabulary size.
        return pd.Series(np.searchsorted(offsets[1:-1], ids.to_numpy(), side="right").astype(np.int32))

    sums.where("id >= 0").withColumn("r", range_of("id")).groupBy("r").applyInPandas(write, "r int").collect()
    return Model(vocab, cuts, d2, rest)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = model.maps()
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            for i, j in _chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *map(pa.array, model.score(texts[i:j], maps))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {ids}, n_tokens long, n_known long, base_score double, score double")


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    fold = F.pmod(crc32_of_id("doc_id"), F.lit(10))
    folder = _folder(scratch(docs.sparkSession, "lm"))
    model = fit(docs.where(fold != 0).select("doc_id", "text"), folder)
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(10)) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
