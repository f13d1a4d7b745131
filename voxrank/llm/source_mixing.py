"""Mixing sources to target token weights by entropy balancing, in DataFrame functions only.

Each source gets a target of words: the budget by weight, at most ``most`` times what it
has, the excess shared again by weight. Among all document rates between 0 and ``most``
that meet the targets, entropy balancing takes those nearest to one copy each (least
Kullback-Leibler divergence over documents). Its dual has one multiplier a source, and a
document of ``size`` words gets the exponentially tilted rate ``min(most, exp(m * size / mean))``.
Newton's method finds all multipliers at once, each kept inside a bracket of its root.

Documents of one source and size share their rate, so the texts are read once and counted
into classes (source, size, n); a Newton pass is one aggregate over the classes, in whole
thousandths of a word, so neither the order of rows nor reruns change it. Rates become
copies by systematic rounding along the sizes of a source, which leaves less than one
document's words of error; that is then made up by single copies of documents that fit into it. A class deals its copies by hash, in buckets of bounded size, so neither a hot
source nor a text that fills a third of the table stands in one task. One row a source,
and the different sizes of one source (at most its longest text's words), stand in one task.

Defined cases: a null or empty text has no words and a tilt of 1; a null source is a source
of its own, the last one; repeated rows are dealt one by one; a null doc_id is an id like
any other; further columns are ignored; a source without words has target 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank.operators.skew import HEAVY_KEYS, join_by_frequency
from voxrank.session import materialise

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
#: Newton passes at most, the relative error that ends them, and the passes that even out what rounding left at most.
PASSES, CLOSE, MOVES = 60, 1e-7, 8
_WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 20  # rates are rounded in these parts of a copy
_BUCKET = 10_000  # rows of a class in one bucket, about


def _key() -> Column:
    """The source as a string that is never null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: the budget dealt by weight, no target above its ceiling.

    With sources in order of ceiling over weight, the level at which the rest of the budget would
    be dealt rises up to the last source that stops at its ceiling and falls after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ceiling = F.col("source_size") * F.lit(float(most))
    rows = sources.withColumns({"weight": weight, "ceiling": ceiling})
    fill = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("ceiling").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    level = F.max((total - full) / left).over(Window.partitionBy())
    return rows.withColumn("level", level).select(
        *sources.columns, F.least("ceiling", F.col("weight") * F.col("level")).alias("target"))


def _rate(most: int) -> Column:
    tilt = F.least(F.exp(F.col("multiplier") * F.col("size") / F.col("mean")), F.lit(float(most)))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.coalesce(tilt, F.lit(1.0)))


def _beside(sources: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks tables with at most a row a source for broadcast if ``sources`` has few enough rows; counted once."""
    few = sources.limit(HEAVY_KEYS + 1).count() <= HEAVY_KEYS
    return F.broadcast if few else lambda df: df


def solve(classes: DataFrame, sources: DataFrame, most: int = MOST, passes: int = PASSES, close: float = CLOSE) -> DataFrame:
    """``sources`` (key, source_size, n_docs, target) with each one's ``multiplier``, ``mean`` and ``full``.

    ``classes``: (key, size, n). The gradient of the dual is the words at the present rates less the
    target, its second derivative sums over documents below the ceiling. A step that leaves the
    bracket known so far halves it, or doubles the reach where one side is still open.
    """
    none = F.lit(None).cast("double")
    state = materialise(sources.withColumns({
        "mean": F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")),
        "full": F.col("target") >= F.col("source_size") * F.lit(float(most)),
        "multiplier": F.lit(0.0), "low": none, "high": none, "done": F.col("source_size") == 0,
    }).withColumn("done", F.col("done") | F.col("full")), "mix-state")
    beside = _beside(sources)
    words = F.col("n") * F.col("size") * F.col("rate")
    below = F.col("rate") < float(most)
    for _ in range(passes):
        if state.where(~F.col("done")).isEmpty():
            break
        at = classes.join(beside(state.where(~F.col("done"))), "key").withColumn("rate", _rate(most))
        sums = at.groupBy("key").agg(
            F.sum(F.round(words * 1000).cast("long")).alias("words"),
            F.sum(F.when(below, F.round(words * F.col("size") / F.col("mean") * 1000).cast("long"))).alias("slope"))
        now = F.col("multiplier")
        error = F.col("words") / 1000 - F.col("target")
        low, high = F.when(error < 0, now).otherwise(F.col("low")), F.when(error >= 0, now).otherwise(F.col("high"))
        newton = now - error / (F.col("slope") / 1000)
        reach = F.greatest(F.abs(now) * 2, F.lit(1.0))
        step = F.when((newton > F.coalesce("low_", now - reach)) & (newton < F.coalesce("high_", now + reach)), newton).otherwise(
            (F.coalesce("low_", now - reach) + F.coalesce("high_", now + reach)) / 2)
        near = F.abs(error) <= F.col("target") * close
        moved = state.join(beside(sums), "key", "left").withColumns({
            "low_": F.when(F.col("done"), F.col("low")).otherwise(low), "high_": F.when(F.col("done"), F.col("high")).otherwise(high)})
        moved = moved.withColumn("next", F.when(F.col("done") | near, now).otherwise(step))
        state = materialise(moved.select(
            *sources.columns, "mean", "full", F.col("next").alias("multiplier"), F.col("low_").alias("low"),
            F.col("high_").alias("high"), (F.col("done") | near).alias("done")), "mix-state")
    return state.select(*sources.columns, "multiplier", "mean", "full")


def _copies(classes: DataFrame, solved: DataFrame, most: int, moves: int) -> DataFrame:
    """``classes`` with ``copies``, the copies that all their documents take together, ``rate``, ``source_size`` and ``target``."""
    beside = _beside(solved)
    rated = classes.join(beside(solved), "key").withColumn("rate", _rate(most))
    parts = rated.withColumn("parts", F.round(F.col("n") * F.col("rate") * _UNIT).cast("long"))
    upto = F.sum("parts").over(Window.partitionBy("key").orderBy("size")) + _UNIT // 2
    whole = lambda x: F.shiftright(x, 20)  # noqa: E731  the copies in a number of parts
    dealt = parts.withColumn("upto", upto).withColumn("copies", whole(F.col("upto")) - whole(F.col("upto") - F.col("parts")))
    now = materialise(dealt.select(*classes.columns, "rate", "source_size", "target", "copies"), "mix-copies")
    # what a source lacks, or has too much, is made up from its longest documents that fit into it, then from shorter ones
    falling = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(moves):
        missing = now.groupBy("key").agg(
            (F.round(F.max("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
        at = now.join(beside(missing), "key")
        gap = F.abs("missing")
        fits = (F.col("size") > 0) & (F.col("size") <= gap)
        room = F.when(fits, F.when(F.col("missing") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))).otherwise(0)
        at = at.withColumn("room", room).withColumn("before", F.coalesce(F.sum(F.col("room") * F.col("size")).over(falling), F.lit(0)))
        count = F.when(F.col("room") > 0, F.greatest(F.lit(0), F.least("room", F.expr("(abs(missing) - before) div size")))).otherwise(0)
        more = F.signum("missing").cast("long") * count
        moved = at.withColumn("moved", F.coalesce(more, F.lit(0)))
        now = materialise(moved.withColumn("copies", F.col("copies") + F.col("moved")).select(*now.columns[:7], "moved"), "mix-copies")
        if now.where("moved <> 0").isEmpty():
            break
    return now.drop("moved")


def balance(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST, moves: int = MOVES
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies and rate of each row of ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = materialise(docs.select("doc_id", _key().alias("key"), size.alias("size")), "mix-rows")
    classes = materialise(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    named = classes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    named = named.withColumn("source", F.when(F.col("key") != "n", F.substring("key", 2, 2**31 - 1)))
    sources = materialise(targets(named, weights, budget, most).select("key", "source_size", "n_docs", "target"), "mix-targets")
    given = _copies(classes, solve(classes, sources, most), most, moves)

    # equal rows are one unit; the units of a class stand in buckets of a hash, in order of the hash
    units = rows.groupBy("doc_id", "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = join_by_frequency(units, given, ["key", "size"], "n").withColumn("hash", F.xxhash64(F.lit("mix"), "doc_id"))
    units = units.withColumn("bucket", F.pmod(F.col("hash"), F.expr(f"n div {_BUCKET} + 1")))
    group = ["key", "size", "bucket"]
    counts = units.groupBy(*group).agg(F.sum("rows").alias("held"))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = F.sum("rows").over(Window.partitionBy(*group).orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.col("copies") % F.col("n") - F.col("start") - (F.col("inside") - F.col("rows"))
    units = units.withColumn("inside", inside).join(starts, group).withColumn(
        "extra", F.greatest(F.lit(0), F.least(extra, F.col("rows"))))
    each = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.expr("copies div n") + (F.col("row") <= F.col("extra")).cast("long")
    return each.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"), "rate")


def take(docs: DataFrame, balanced: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it has copies. doc_id must be unique."""
    copies = balanced.where("copies > 0").select("doc_id", F.col("copies").alias("_copies"))
    rows = docs.join(copies, "doc_id")
    return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
