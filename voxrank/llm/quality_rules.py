"""Quality rules whose cutoffs are chosen on labelled rows under a bound on false rejection.

Each rule rejects a text whose score lies above the rule's cutoff in the text's
stratum (its language). For every stratum, rule and cutoff of a fixed grid, the
labelled texts of good quality give a count k of n that the cutoff would reject.
A cutoff is admitted if the exact binomial tail P(Bin(n, risk) <= k) is at most
delta / (strata x rules): then its true rate of false rejection is under ``risk``
with confidence 1 - delta, for all strata and rules together. Inside a stratum and
rule the cutoffs are tested from the mildest to the strictest and the tests stop at
the first failure (a fixed sequence needs no further correction), so any admitted
cutoff may be used; taken is the one that rejects most bad and fewest good labelled
texts. Rules without an admitted cutoff that helps reject nothing. The risks of the
rules add up, so a stratum loses at most ``risk`` of its good texts in all.

Words are runs of characters other than space and U+0009-000D. Repeated three-word
windows are compared by their 64-bit hashes.

Defined cases: a null or empty text has no words and fails the base rule; a null
language is a stratum; several labels of one document count as one, good only if
all are; repeated rows are judged each for itself; further columns are ignored; an
empty table gives an empty result, and without labels only the base rule holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of good texts that all rules together may reject in a stratum, and
#: the chance that any bound of the whole table fails.
RISK, DELTA = 0.02, 0.05
#: Cutoffs from strict to mild; every score is a share from 0 to 1.
GRID = [i / 50 for i in range(50)]
RULES = ("symbols", "capitals", "exclamations", "repeated_words", "repeated_lines")
_SPACE = " \t\n\v\f\r"


def _removed(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, stratum, the base measures and the score of each rule, without the text; or with the row as one column."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if whole_rows else []
    carried = ["_row"] if whole_rows else []
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.filter(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    first = docs.select(
        *row, "doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), words.alias("words"), lines.alias("lines"),
        _removed(text, "#*$%&|<>").alias("n_symbols"), _removed(text, "!").alias("n_exclamations"),
        _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÀÂÎÔÛÑÁÍÓÚ").alias("n_capitals"),
    )
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(
            F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    )
    second = first.select(
        *carried, "doc_id", "stratum", "n_symbols", "n_exclamations", "n_capitals", windows.alias("windows"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_different"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
    third = second.withColumn("placed", F.when(repeats, placed)).drop("windows")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("placed", i)["hash"] == x["hash"], F.lit(False))

    twice = F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    fourth = third.select(
        *carried, "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_exclamations", "n_capitals", "n_lines",
        (F.col("n_lines") - F.col("n_different")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # a numbered row: the filter that reads the number stays above these projections, and
    # the optimizer does not write their expressions into it again and again
    number = [F.monotonically_increasing_id().alias("_number")] if whole_rows else []
    chars, count = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return fourth.select(
        *carried, *number, "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbols"), (F.col("n_capitals") / chars).alias("capitals"),
        (F.col("n_exclamations") / chars).alias("exclamations"),
        (F.col("n_repeat_words") / count).alias("repeated_words"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("repeated_lines"),
    )


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda a: a["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the admitted cutoffs in use."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = measured.where(~F.col("base_failed")).join(good, "doc_id")
    scores = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES])
    grid = F.array(*[F.lit(float(c)) for c in GRID])
    counted = (
        held.select("stratum", "good", F.explode(scores).alias("s"))
        .select("stratum", "good", "s.rule", F.size(F.filter(grid, lambda c: F.col("s.score") > c)).alias("above"))
        .groupBy("stratum", "rule", "above").agg(
            F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    each = Window.partitionBy("stratum", "rule")
    totals = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    # the score lies above cutoff i if it lies above more than i cutoffs
    tried = (
        counted.join(totals, ["stratum", "rule"])
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))))
        .groupBy("stratum", "rule", "n", "n_bad", "at")
        .agg(F.sum(F.when(F.col("above") > F.col("at"), F.col("good")).otherwise(0)).alias("k"),
             F.sum(F.when(F.col("above") > F.col("at"), F.col("bad")).otherwise(0)).alias("caught"))
    )
    tests = counted.select("stratum").distinct().count() * len(RULES)
    share = risk / len(RULES)
    # beyond its mean the tail is over 1/2, so it need not be summed
    small = F.col("k") <= F.col("n") * share
    admitted = small & (F.col("n") > 0) & (
        F.when(small, log_binomial_tail(F.col("k"), F.col("n").cast("double"), share)) <= F.log(F.lit(delta / max(1, tests))))
    mildest_first = each.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    tried = tried.withColumn("valid", F.min(F.coalesce(admitted, F.lit(False)).cast("int")).over(mildest_first) == 1)
    gain = F.col("caught") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    return (
        tried.where("valid").withColumn("gain", F.round(gain, 12)).where("gain > 0")
        .groupBy("stratum", "rule").agg(F.max(F.struct("gain", "at")).alias("best"))
        .select("stratum", "rule", F.get(grid, F.col("best.at")).alias("cutoff"))
    )


def _cutoff_rows(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum and a map from rule to cutoff, small enough to send to every task if the strata are few."""
    chosen = cutoffs(measured, labels, risk, delta).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    return counted_broadcast(materialise(chosen, "quality-cutoffs"), 10_000)


def _judged(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.col(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES]))
    judged = measured.join(chosen, "stratum", "left").withColumn("rejected_by", F.array_join(hits, ","))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The measures of every row with base_failed, the rules that reject it and kept."""
    measured = materialise(measures(docs), "quality-measures")
    return _judged(measured, _cutoff_rows(measured, labels, risk, delta)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "rejected_by", "stratum",
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. The measures are taken twice, so no text is shuffled."""
    chosen = _cutoff_rows(materialise(measures(docs), "quality-measures"), labels, risk, delta)
    return _judged(measures(docs, whole_rows=True), chosen).where("kept and _number >= 0").select("_row.*")
