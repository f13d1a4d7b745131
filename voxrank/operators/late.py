"""Narrow answers brought back to wide rows, without moving the rows.

A table is stored once with each row's place. Filters and values are worked out on narrow
columns and come back as one small row for each 64 places, broadcast in rounds of bounded
size; each round reads its own range of places, so every row is read once more and never
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrank.session import materialise

PLACE = "_place"
#: Words (of 64 places) that one broadcast holds: a few tens of bytes each for bits, some 600 for values.
MOST_BIT_WORDS, MOST_VALUE_WORDS = 1_000_000, 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, with a place for each row."""
    return materialise(df.withColumn(PLACE, F.monotonically_increasing_id()), name)


def _word() -> Column:
    return F.expr(f"{PLACE} div 64")


def _bit() -> Column:
    return F.expr(f"shiftleft(1L, cast({PLACE} & 63 as int))")


def _in_rounds(rows: DataFrame, words: DataFrame, most: int, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of ``rows`` beside their ``words`` (or nulls), which are broadcast at most ``most`` at a time."""
    count = words.count()
    rounds = max(1, -(-count // most))
    if rounds == 1:
        return use(rows.join(F.broadcast(words), _word() == F.col("_word"), "left"))
    # cuts between blocks of word numbers, by the count of each block
    first, last = words.agg(F.min("_word"), F.max("_word")).first()
    width = max(1, (last - first + 1) // (rounds * 64))
    blocks = words.groupBy(F.expr(f"_word div {width}").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    cuts, held = [], 0
    for block in blocks:
        if held and held + block.n > most:
            cuts.append(block.b * width)
            held = 0
        held += block.n
    edges = [None, *cuts, None]
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        mine, theirs = words, rows
        if low is not None:
            mine, theirs = mine.where(F.col("_word") >= low), theirs.where(F.col(PLACE) >= low * 64)
        if high is not None:
            mine, theirs = mine.where(F.col("_word") < high), theirs.where(F.col(PLACE) < high * 64)
        parts.append(use(theirs.join(F.broadcast(mine), _word() == F.col("_word"), "left")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def keep(rows: DataFrame, kept: DataFrame, most: int = MOST_BIT_WORDS) -> DataFrame:
    """The ``rows`` of a stored table whose places are in ``kept`` (one column, each place once)."""
    present = rows.groupBy(_word().alias("_word")).agg(F.bit_or(_bit()).alias("present"))
    wanted = kept.groupBy(_word().alias("_word")).agg(F.bit_or(_bit()).alias("wanted"))
    dropped = present.join(wanted, "_word", "left").select(
        "_word", F.col("present").bitwiseAND(F.bitwise_not(F.coalesce("wanted", F.lit(0).cast("long")))).alias("_bits"))
    dropped = materialise(dropped.where("_bits <> 0"), "dropped")
    stays = F.col("_bits").isNull() | (F.col("_bits").bitwiseAND(_bit()) == 0)
    return _in_rounds(rows, dropped, most, lambda df: df.where(stays).select(*rows.columns))


def with_value(rows: DataFrame, values: DataFrame, name: str, most: int = MOST_VALUE_WORDS) -> DataFrame:
    """``rows`` of a stored table with the value ``name`` of their place in ``values`` (place, name), or null."""
    entry = F.struct(F.col(PLACE).bitwiseAND(F.lit(63)).cast("int").alias("at"), F.col(name).alias("value"))
    words = values.groupBy(_word().alias("_word")).agg(F.map_from_entries(F.collect_list(entry)).alias("_values"))  # at most 64
    words = materialise(words, "values")
    found = F.try_element_at("_values", F.col(PLACE).bitwiseAND(F.lit(63)).cast("int"))
    return _in_rounds(rows, words, most, lambda df: df.withColumn(name, found).select(*rows.columns, name))
