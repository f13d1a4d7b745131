"""Joins on keys of very uneven frequency, and joins that must be one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrank.operators import late
from voxrank.session import materialise

HEAVY_KEYS = 20_000


def counted_broadcast(df: DataFrame, most_rows: int = HEAVY_KEYS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is.

    Counts, so ``df`` should be a small written table or derive from one. The
    hint matters because size estimates of aggregated tables are far too high:
    without it the large side of the join would be shuffled.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_by_frequency(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], frequency: str, heavy_keys: int = HEAVY_KEYS
) -> DataFrame:
    """Inner join of many ``rows`` to a ``lookup`` that knows each key's frequency.

    ``lookup`` is a written table. Up to ``heavy_keys`` rows of it are simply
    broadcast. Beyond that, ``frequency`` (the number of ``rows`` per key) splits
    it: keys holding more than 1/heavy_keys of all rows number fewer than
    ``heavy_keys``, a proven bound for a broadcast, and every other key is too
    small to skew a shuffled join. All rows are kept.
    """
    if lookup.limit(heavy_keys + 1).count() <= heavy_keys:
        return rows.join(F.broadcast(lookup), list(keys))
    total = lookup.agg(F.sum(frequency).alias("n")).scalar()
    is_heavy = F.col(frequency) * heavy_keys > total
    heavy = F.broadcast(lookup.where(is_heavy))
    light = lookup.where(~is_heavy)
    frequent = rows.join(heavy, list(keys))
    rare = rows.join(heavy.select(*keys), list(keys), "left_anti").join(light, list(keys))
    return frequent.unionByName(rare)


def _digest(keys: Sequence[str]) -> Column:
    """32 bytes for the keys' values, null if one is null (as such rows match nothing)."""
    joined = F.concat(*[F.concat(F.octet_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in keys])
    return F.unhex(F.sha2(joined, 256))


def _refuse_repeats(digests: DataFrame, keys: Sequence[str], what: str) -> Column:
    """True, or a failure of the job that names a repeated key: one narrow count over digests."""
    shown = F.concat_ws(",", *[F.left(F.col(k).cast("string"), F.lit(80)) for k in keys])
    counted = digests.where("_digest is not null").groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.min(shown).alias("shown"))
    again = counted.where("n > 1").agg(F.min("shown")).scalar()
    message = F.concat(F.lit(f"{what} must be unique: "), again)
    return F.when(again.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right`` of equal keys; a key that repeats on a side fails the job.

    Keys are compared by digest. Both sides are stored; repeats are counted on digests alone,
    pairs of places are found by a narrow join, and the matching rows of ``right``, a few columns,
    come back to the rows of ``left`` by place, so neither side is sorted by its keys and
    the rows of ``left`` are never moved. ``how`` is "left" or "inner".
    """
    mine, theirs = late.stored(left, "one-left"), materialise(right, "one-right")
    more = [c for c in right.columns if c not in keys]
    own, other = mine.select(late.PLACE, *keys, _digest(keys).alias("_digest")), theirs.withColumn("_digest", _digest(keys))
    sound = _refuse_repeats(own, keys, "Left keys") & _refuse_repeats(other, keys, "Right keys")
    wanted = own.select(late.PLACE, "_digest").where("_digest is not null")
    # the fewer digests there are on the left, the less of the right side has to move
    few = counted_broadcast(materialise(wanted, "one-digests"))
    values = few.join(other.select("_digest", F.struct(F.lit(True).alias("_found"), *more).alias("_right")), "_digest").select(late.PLACE, "_right")
    values = values.where(sound)  # before a place could get two values
    joined = late.with_value(mine, values, "_right").where(sound)
    if how == "inner":
        joined = joined.where("_right is not null")
    return joined.select(*left.columns, *[F.col(f"_right.{c}").alias(c) for c in more])
