"""Best-fit packing into fixed-length sequences by a grouping genetic algorithm.

A document is its token ids and an end id.  Documents of more than
``capacity`` ids are cut so that all pieces but the first are full; full
pieces are sequences of their own.  All other pieces are packed.

Grouping genetic algorithm: an individual is a list of bins.  Crossover
injects whole well-filled bins of one parent into the other, removes the bins
that now hold duplicates, and puts the documents displaced with them back by
best fit.  Each cell of about ``CELL`` sequences has several islands, which are
rows of a table; each round evolves all islands in parallel and hands every
island the elite of its neighbour.

Cells exchange what they pack badly: the least filled sequences of every cell
(a fiftieth, two at least) are opened, and their pieces are dealt to new cells,
a fiftieth in number, until one cell holds the rest.  That last cell is searched
with more generations than the others, as only there a sequence can still be
saved for the whole corpus.

Scale: texts are tokenised where they are read and never shuffled.  Pieces are
dealt to cells in order of length, round robin, so every cell has the length
distribution of the whole corpus.  A cell is bounded by its tokens, so is
everything a task holds; the number of passes grows with the logarithm of the
corpus, and each pass moves a fiftieth of the pieces of the one before.

Defined results: null text is the empty document, one piece with the end id
alone; texts are tokenised whole; repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import n_groups, stored
from chatlake.plans.numbering import with_row_index

#: Sequences of a cell, and one in so many of them that goes on to the next pass.
CELL, AGAIN = 500, 50
ISLANDS, ROUNDS = 3, 2
#: (population, generations) of cells, and of the last one.
SEARCH, LAST_SEARCH = (4, 6), (8, 80)

#: Words remembered with their ids by one worker.
_WORDS = 800_000
#: A blank that may not start a word of its own.
_ODD_BLANK = re.compile(r" (?:\s|\Z)")


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level tokenizer never joins a word with what stands before the
    blank in front of it, so a text is split at blanks followed by a word and
    the ids of ``" word"`` are looked up; new words are encoded once.  Texts
    with other blank runs or special tokens are encoded as they are.  Short
    words of the common scripts go through the same vocabulary in its rank
    form, which gives the same ids at a quarter of the time.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.plain, self.spaced, self.quick = {}, {}, None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table,
                                           special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # Latin, Greek and Cyrillic: every library agrees on their classes.
        if self.quick and len(word) < 100 and max(word, default=" ") < "԰":
            return np.array(self.quick(word), "<u4").tobytes()
        return self.encode(word)

    def __call__(self, text: str) -> bytes:
        if _ODD_BLANK.search(text) or any(s in text for s in self.special):
            return self.encode(text)
        words, out = text.split(" "), []
        known, put = self.spaced, out.append
        first = self.plain.get(words[0])
        if first is None:
            first = self._word(words[0])
            if len(self.plain) < _WORDS // 4 and len(words[0]) < 60:
                self.plain[words[0]] = first
        put(first)
        get = known.get
        for w in words[1:]:
            ids = get(w)
            if ids is None:
                ids = self._word(" " + w)
                if len(known) < _WORDS and len(w) < 60:
                    known[w] = ids
            put(ids)
        return b"".join(out)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def default_tokenizer() -> tuple[str, str, str]:
    """(file, rank file, pattern) of the production tokenizer."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def _tokenizer(files: tuple) -> WordTokenizer:
    if files not in _TOKENIZERS:
        _TOKENIZERS[files] = WordTokenizer(*files)
    return _TOKENIZERS[files]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, files: tuple | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row a piece."""
    files = files or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(files)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                ids = tok(text.as_py() or "") + end
                n = len(ids) // 4
                at, p, first = 0, 0, n if n <= capacity else n % capacity or capacity
                while at < n:
                    size = capacity if at else first
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at, p = at + size, p + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {ids}, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm on one cell: lens is sorted, longest first ---------

Bins = list[list[int]]


def best_fit(bins: Bins, items: list[int], lens: list[int], capacity: int) -> Bins:
    """Put the items, longest first, each into the fullest bin that has room."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(lens[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items):
        k = bisect_left(room, (lens[i], -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left > lens[i]:
            insort(room, (left - lens[i], b))
    return bins


def fitness(bins: Bins, lens: list[int]) -> tuple[int, int]:
    """Fewer bins first, then more unequal filling (room gathered in few bins)."""
    return len(bins), -sum(sum(lens[i] for i in b) ** 2 for b in bins)


def crossover(giver: Bins, taker: Bins, lens: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Well-filled bins of ``giver`` replace what they duplicate in ``taker``."""
    fill = np.array([sum(lens[i] for i in b) for b in giver])
    good = np.flatnonzero(fill >= max(0.98 * capacity, np.quantile(fill, 0.5)))
    if not len(good):
        good = np.array([int(fill.argmax())])
    picked = rng.choice(good, max(1, len(good) // 2), replace=False)
    injected = [giver[k] for k in picked]
    held = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in taker:
        if held.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in held]
    return best_fit(injected + kept, displaced, lens, capacity)


def mutate(bins: Bins, lens: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Empty the least filled bin and a few others, and best-fit what they held."""
    fill = [sum(lens[i] for i in b) for b in bins]
    gone = {int(np.argmin(fill)), *rng.integers(0, len(bins), 3).tolist()}
    items = [i for k in gone for i in bins[k]]
    return best_fit([b for k, b in enumerate(bins) if k not in gone], items, lens, capacity)


def evolve(lens: list[int], elites: list[Bins], capacity: int, seed: int, population: int = SEARCH[0],
           generations: int = SEARCH[1]) -> Bins:
    """The best individual of one island; ends early when no better one can exist."""
    rng = np.random.default_rng(seed)
    least = max(-(-sum(lens) // capacity), sum(2 * x > capacity for x in lens))
    people = list(elites) or [best_fit([], list(range(len(lens))), lens, capacity)]
    if min(map(len, people)) > least:
        while len(people) < population:  # random halves packed first, then the rest
            half = rng.permutation(len(lens))[: len(lens) // 2].tolist()
            rest = sorted(set(range(len(lens))) - set(half))
            people.append(best_fit(best_fit([], half, lens, capacity), rest, lens, capacity))
        for _ in range(generations):
            people.sort(key=lambda b: fitness(b, lens))
            if len(people[0]) <= least:
                break
            a, b = rng.choice(len(people), 2, replace=False)
            child = crossover(people[min(a, b)], people[max(a, b)], lens, capacity, rng)
            people[-1] = mutate(child, lens, capacity, rng)
    return min(people, key=lambda b: fitness(b, lens))


def _assignment(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assignment) -> Bins:
    out: Bins = [[] for _ in range(int(max(assignment)) + 1)]
    for i, k in enumerate(assignment):
        out[k].append(i)
    return out


def _evolve_rows(capacity: int, round_no: int, search: tuple[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                lens = list(map(int, r.lens))
                elites = [_bins(e) for e in (r.own, r.guest) if e is not None]
                best = evolve(lens, elites, capacity, (r.cell * ISLANDS + r.island) * ROUNDS + round_no, *search)
                out.append((r.cell, r.island, r.lens, _assignment(best, len(lens)), len(best)))
            yield pd.DataFrame(out, columns=["cell", "island", "lens", "own", "bins"])
    return run


_ISLAND = "cell long, island int, lens array<int>, own array<int>, bins int"


def pack_cells(cells: DataFrame, capacity: int, search: tuple[int, int] = SEARCH) -> DataFrame:
    """(cell, lens) -> (cell, own): the bin of each piece, by rank in its cell."""
    spark = cells.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)
    rows = (cells.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
            .withColumn("own", F.lit(None).cast("array<int>")).withColumn("guest", F.col("own")))
    for k in range(ROUNDS):
        rows = rows.select("cell", "island", "lens", "own", "guest").repartition(parts, "cell", "island")
        rows = stored(rows.mapInPandas(_evolve_rows(capacity, k, search), _ISLAND), "islands")
        if k + 1 < ROUNDS:  # elites move one island on
            guests = rows.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                                 F.col("own").alias("guest"))
            rows = rows.join(guests, ["cell", "island"])
    return rows.groupBy("cell").agg(F.min_by("own", F.struct("bins", "island")).alias("own"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, files: tuple | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences of one full piece have ids from 0 on, packed ones below 0.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = stored(token_pieces(docs, capacity, end_id, files), "pieces")
    full = (pieces.where(F.col("length") == capacity)
            .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    todo, done, passes = pieces.where(F.col("length") < capacity), [], 0
    while True:
        cells = n_groups(todo.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], CELL * capacity)
        placed = _pack_pass(todo.select(*cols), capacity, cells)
        # Pass, cell and sequence: a cell has at most CELL * capacity pieces.
        placed = placed.withColumn("sequence_id", -(F.lit(passes << 58) + F.shiftleft("cell", 24) + F.col("bin") + 1))
        if cells == 1:
            done.append(placed)
            break
        done.append(placed.where(~F.col("again")))
        todo, passes = placed.where("again"), passes + 1
    out = full.select(*cols, "sequence_id", "offset")
    for placed in done:
        out = out.unionByName(placed.select(*cols, "sequence_id", "offset"))
    return out


def _pack_pass(part: DataFrame, capacity: int, cells: int) -> DataFrame:
    """Part-filled pieces with their cell, bin, offset, and ``again``: the bin is among the least filled of its cell."""
    cols = part.columns
    dealt = with_row_index(part, [F.col("length").desc(), "doc_id", "piece", "ids_crc32"], name="no")
    dealt = stored(dealt.select(*cols, F.pmod("no", F.lit(cells)).alias("cell"),
                                F.floor(F.col("no") / F.lit(cells)).cast("int").alias("rank")), "dealt")
    # Ranks follow length, so lens is sorted.
    lens = (dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("rank", "length"))).alias("x"))
            .select("cell", F.transform("x", lambda s: s["length"].cast("int")).alias("lens")))
    best = stored(pack_cells(lens, capacity, LAST_SEARCH if cells == 1 else SEARCH), "best")
    placed = dealt.join(best, "cell").withColumn("bin", F.get("own", F.col("rank"))).drop("own")
    before = Window.partitionBy("cell", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    filled = placed.groupBy("cell", "bin").agg(F.sum("length").alias("fill"))
    by_fill = Window.partitionBy("cell").orderBy("fill", "bin")
    every = Window.partitionBy("cell")
    filled = filled.select("cell", "bin", (F.row_number().over(by_fill) <= F.greatest(
        F.lit(2), F.count(F.lit(1)).over(every) / AGAIN)).alias("again"))
    return stored(placed.join(filled, ["cell", "bin"]), "placed")
