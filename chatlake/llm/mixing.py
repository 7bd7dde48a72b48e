"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words: weights share out 100 % of all
words, no source gives more than ``cap`` times its own words, and what a
capped source cannot take is shared again by weight.  A document of a source
whose target is ``r`` times its size is taken ``floor(r)`` times for certain;
the remaining words of the target are a sample of the source.  A document's
inclusion probability is in proportion to its words, ``min(1, c * size)`` with
``c`` such that the expected words are those that remain: the largest documents
are certain, and the share of the others is raised until that holds.  Documents
are ranked by their random odds divided by their inclusion odds (Pareto order
sampling; certain ones come first), and the first of them whose words fill the
rest of the target are taken once more.  A document of more than twice the rest
takes no part: with it the target would be missed by more than without.  The
sample size is fixed in words, so a source misses its target by at most half a
document.

Scale: the text is read once for the word count.  Targets are computed on one
row a source, inclusion probabilities on one row a source and size.  The ranks
are running sums over a range sort of narrow rows (source, score), so a source
with a third of all rows spans many tasks.

Defined results: null text counts 0 words and is taken 0 words; a null source
is a source of its own, last in order; documents of no words are never in the
way of others; repeated rows are ranked one by one (their order among
themselves has no effect on the multiset of results); an empty table gives an
empty result; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import stored, word_count
from chatlake.plans.numbering import with_row_index

#: 2**52, the number of different random values.
_STEPS = 4503599627370496


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, size) rows -> one row a source with its rank, weight and target.

    The water level solves ``sum(least(cap * size, level * weight)) = total``:
    with sources ordered by the level at which they are full, it is the first
    level that fills no further source.  That is the fixed point of sharing
    the excess again until no source is above its cap.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("source_no", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = (src.withColumn("weight", w)
           .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
           .withColumn("full_at", F.col("most") / F.col("weight")))
    order = Window.orderBy("full_at", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything)
                                   - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                         / F.sum("weight").over(after))
    level = F.min_by("level", F.when(F.col("level") <= F.col("full_at"),
                                     F.struct("full_at", "source_no"))).over(everything)
    return (src.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), "most")))
            .select("source", "source_no", "source_size", "target"))


def inclusion_rates(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_no, rate): a document of a source with ``share`` > 0 is included with probability min(1, rate * size).

    ``sources``: __s, source_no, source_size, target, whole, share.  With the
    documents above a size certain, the rate of the others is what remains over
    the sum of their squared sizes; the largest size that is not certain at its
    own rate gives the rate.
    """
    kinds = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = sources.where("share > 0").select(
        "__s", "source_no", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    kinds = kinds.join(wanted, F.col("source").eqNullSafe(F.col("__s"))).where(F.col("size") <= 2 * F.col("rest"))
    larger = Window.partitionBy("source_no").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = ((F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0)))
            / F.sum(F.col("n") * F.col("size") * F.col("size")).over(others))
    kinds = kinds.select("source_no", "size", rate.alias("rate"))
    return (kinds.where(F.col("rate") * F.col("size") <= 1).groupBy("source_no")
            .agg(F.max_by("rate", "size").alias("rate")))


def uniform(*cols, seed: int) -> F.Column:
    """A reproducible number strictly between 0 and 1 from column values."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (draw + F.lit(0.5)) / F.lit(float(_STEPS))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, seed: int = 17,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: size, source_size, target, copies, taken (+ ``keep``)."""
    base = stored(docs.select("doc_id", "source", word_count("text").alias("size"), *keep), "mix")
    src = stored(source_targets(base, weights, cap), "mixsrc")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # One row a source, joined by the measured size of that table; rows of a
    # null source meet through null-safe equality.
    s = src.select(F.col("source").alias("__s"), "source_no", "source_size", "target",
                   F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("share"))
    s = s.join(inclusion_rates(base, s), "source_no", "left")
    rows = base.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    u = uniform("doc_id", seed=seed)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    chance = F.when(F.col("size") <= 2 * rest, F.col("rate") * F.col("size"))
    odds = (F.when(chance >= 1, F.lit(0.0)).when(chance > 0, (u / (1 - u)) / (chance / (1 - chance)))
            .otherwise(F.lit(float("inf"))))
    ranked = with_row_index(rows.withColumn("score", odds), ["score", "doc_id", "size"], name="rank",
                            sums={"words_before": "size"}, partition_by=["source_no"])
    extra = F.when((F.col("share") > 0) & (F.col("words_before") + F.col("size") / 2 <= rest), 1).otherwise(0)
    return (ranked.withColumn("copies", (F.col("whole") + extra).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"), "score", *keep))


def repeat_copies(docs: DataFrame, **params) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken.

    Rows of no words carry nothing the targets count; they are kept once.
    Repeated input rows are numbered by their content, so the copies meet
    their own row again.
    """
    cols = docs.columns
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    mixed = mix_sources(docs.withColumn("__content", content), keep=("__content",), **params)
    # Identical rows are interchangeable: their copies are added up.
    copies = (mixed.groupBy("doc_id", "__content")
              .agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias("__copies")))
    # One of the identical rows carries all copies of its kind.
    kinds = docs.withColumn("__content", content).dropDuplicates(["doc_id", "__content"])
    joined = kinds.join(copies.select(F.col("doc_id").alias("__d"), F.col("__content").alias("__c"), "__copies"),
                        F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__content") == F.col("__c")))
    return (joined.where("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .select(*cols))
