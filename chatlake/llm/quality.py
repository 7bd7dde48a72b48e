"""Quality rules with risk-controlled thresholds.

Base rules use fixed limits.  Every further rule rejects a text when a measure
exceeds a cutoff, and its cutoff is chosen on labelled documents so that the
false rejection rate is limited: for each stratum and rule the cutoffs of a
fixed grid are tested from the loosest on.  A cutoff is certified when the
exact binomial tail P(X <= k | n, alpha) of the ``k`` of ``n`` good documents
it rejects is at most ``delta`` divided by the number of strata and rules
(Bonferroni).  Testing stops at the first cutoff that fails (fixed sequence,
which needs no further correction along the grid), and the last certified one
is used.  With probability ``1 - delta`` every stratum loses at most ``alpha``
of its good documents to every rule, ``alpha_total = alpha * rules`` in all.

A stratum with so few labels that not even a cutoff without rejected good
documents could be certified, ``(1 - alpha) ** n`` above the limit, makes no
test of its own.  All such strata are judged by the cutoffs of one pool: their
labelled documents together, and if those are too few as well, those of the
next larger strata until there are enough.  The pool is chosen by numbers of
labels alone and takes the place of at least one test, so the limit holds.
Its guarantee is for the pool as a whole: every rule's pooled cutoff exceeds
at most ``alpha`` of the pool's good documents, in the pool's mix; a single
small stratum may lose a larger share.  A pool that is too small gives no
cutoff, and its strata lose nothing.

Scale: one pass over the texts with built-in functions makes a narrow table;
everything else works on that.  The counts for all cutoffs are one partial
aggregate a stratum.

Defined results: null text has no words; labels without a quality, and
documents without a label, don't count for cutoffs; a null stratum is a
stratum of its own; repeated labels of a document count once, good only if all
are; repeated rows get the same verdict; without labels only the base rules
act, and so in a stratum without any good label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import WS, WS_CHARS, stored

SYMBOLS = "#*$%&|<>"

#: Rule -> (measure of the narrow table, cutoffs from the loosest to the strictest).
RULES = {
    "symbols": ("n_symbols / n_words", [1.0 * 0.8 ** j for j in range(24)]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9 * 0.85 ** j for j in range(20)]),
    "repeats": ("n_repeat_words / n_words", [0.5 * 0.85 ** j for j in range(20)]),
    "long_words": ("word_chars / n_words", [30.0 * 0.93 ** j for j in range(24)]),
    "short_words": ("n_words / word_chars", [1.0 * 0.95 ** j for j in range(24)]),
}


def text_measures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (+ ``keep``)."""
    cols = list(dict.fromkeys(["doc_id", *keep]))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*cols, text.alias("__t"))
    d = d.select(*cols, "__t", F.filter(F.split("__t", f"[{WS}]+"), lambda w: w != "").alias("__w"),
                 F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("__l"))
    d = d.select(
        *cols, F.size("__w").cast("long").alias("n_words"), "__w",
        F.length(F.translate("__t", WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    done = [*cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    # Hashes of the three-word windows; a text whose windows all differ is done.
    windows = F.when(F.size("__w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("__w") - 3),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    d = d.select(*done, windows.alias("__h"))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    d = d.select(*done, F.when(again, F.sort_array(F.transform(
        F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    same = F.filter("__s", lambda s, k: F.get("__s", k + 1)["h"].eqNullSafe(s["h"])
                    | F.get("__s", k - 1)["h"].eqNullSafe(s["h"]))
    d = d.select(*done, F.sort_array(F.transform(same, lambda s: s["i"])).alias("__p"))
    # A repeated window covers three words, less what the next one covers too.
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(
        F.coalesce(F.get("__p", k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return d.select(*done, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(least_words: int = 50, most_repeats: int = 50) -> F.Column:
    return ((F.col("n_words") < least_words)
            | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words")))


def _measure(expr: str) -> F.Column:
    top, below = expr.split(" / ")
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(0.0)


def binomial_tail(k: F.Column, n: F.Column, p: float) -> F.Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from logarithms."""
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("lp"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def step(acc, i):
        lp = acc["lp"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(lp.alias("lp"), (acc["sum"] + F.exp(lp)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, zero, step, lambda acc: acc["sum"])


def certified_cutoffs(good: DataFrame, rules=None, alpha: float = 0.004, delta: float = 0.05) -> DataFrame:
    """(stratum, measures) rows of good documents -> (stratum, rule, cutoff, k, n).

    Strata judged by the pool have its cutoffs, ``k`` and ``n``.
    """
    rules = rules or RULES
    counts = [F.sum((_measure(m) > t).cast("long")).alias(f"{r}__{j}")
              for r, (m, grid) in rules.items() for j, t in enumerate(grid)]
    by = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    # One row a stratum from here on.
    every = Window.partitionBy()
    smaller = Window.orderBy("n", "stratum").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("strata", F.count(F.lit(1)).over(every))
    limit = F.lit(delta / len(rules)) / F.col("strata")

    def too_few(n):
        return binomial_tail(F.lit(0).cast("long"), n, alpha) > limit

    by = by.withColumn("small", too_few(F.col("n")))
    pooled = F.max("small").over(every) & (F.col("small") | too_few(F.coalesce(F.sum("n").over(smaller), F.lit(0))))
    own = F.struct(F.lit(False).alias("pool"), "stratum")
    pool = F.struct(F.lit(True).alias("pool"), F.lit(None).cast(by.schema["stratum"].dataType).alias("stratum"))
    by = by.withColumn("pooled", pooled)
    by = by.withColumn("team", F.explode(F.concat(F.when(F.col("small"), F.array()).otherwise(F.array(own)),
                                                  F.when(F.col("pooled"), F.array(pool)).otherwise(F.array()))))
    judged = F.when(~F.col("team.pool") | F.col("small"), F.struct("stratum"))
    by = by.groupBy("team", "strata").agg(
        F.collect_list(judged).alias("judged"), F.sum("n").alias("n"),
        *[F.sum(f"{r}__{j}").alias(f"{r}__{j}") for r, (_, grid) in rules.items() for j in range(len(grid))])
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(j).alias("j"), F.lit(t).alias("cutoff"),
                               F.col(f"{r}__{j}").alias("k"))
                      for r, (_, grid) in rules.items() for j, t in enumerate(grid)])
    t = (by.select("team", "judged", "n", "strata", F.explode(tests).alias("t"))
         .select("team", "judged", "n", "strata", "t.*"))
    # Above the mean the tail is far above any limit in use; its sum isn't needed.
    ok = F.when(F.col("k") > F.col("n") * alpha, False).otherwise(
        binomial_tail(F.col("k"), F.col("n"), alpha) <= limit)
    so_far = Window.partitionBy("team", "rule").orderBy("j")
    t = t.withColumn("ok", F.min(ok.cast("int")).over(so_far)).where("ok = 1")
    return (t.groupBy("team", "rule").agg(F.max(F.struct("j", "cutoff", "k", "n")).alias("b"),
                                          F.first("judged").alias("judged"))
            .select(F.explode("judged").alias("s"), "rule", "b").select("s.stratum", "rule", "b.cutoff", "b.k", "b.n"))


def independent(good: DataFrame) -> DataFrame:
    """Good rows as trials of the bound: every text of a stratum and every document counts once.

    Copies of a text fall together, so they say no more than one of them.
    """
    figures = [c for c in good.columns if c not in ("doc_id", "stratum", "__k1", "__k2")]
    texts = good.groupBy("stratum", "__k1", "__k2").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in figures])
    row = F.min(F.struct("stratum", "__k1", "__k2", *figures)).alias("x")
    return texts.groupBy("doc_id").agg(row).select("doc_id", "x.*").drop("__k1", "__k2")


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules=None, alpha: float = 0.004,
                  delta: float = 0.05) -> DataFrame:
    """Measures, base_failed, rejected_by (first rule, else null) and kept of every document."""
    rules = rules or RULES
    key = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    own = {"__stratum": key, "__k1": F.xxhash64("text"), "__k2": F.xxhash64("text", F.lit(1))}
    rows = stored(text_measures(docs.withColumns(own), tuple(own))
                  .withColumnRenamed("__stratum", "stratum").withColumn("base_failed", base_failed()), "quality")
    fine = (labels.where("doc_id is not null and quality is not null")
            .groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    good = independent(rows.where(~F.col("base_failed")).join(fine, "doc_id", "left_semi"))
    cut = stored(certified_cutoffs(good, rules, alpha, delta), "cutoffs")
    wide = cut.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}")
                                        for r in rules])
    out = rows.drop("__k1", "__k2").join(wide, "stratum", "left")
    hit = F.coalesce(*[F.when(_measure(m) > F.col(f"cut_{r}"), F.lit(r)) for r, (m, _) in rules.items()])
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(hit))
    return out.withColumn("kept", F.col("rejected_by").isNull())
