"""Sharding by a k-d tree over document metadata, with shards of nearly equal bytes.

A node that must yield k shards is cut where its bytes stand at floor(k/2) : ceil(k/2)
along the dimension in which its rows spread widest, until k is 1. The cut is a
weighted quantile found by counting: each pass sums bytes into ``_BINS`` equal parts
of the interval that still holds the cut, for all nodes of a level at once, so the
driver sees at most ``_BINS`` sums a node however many rows there are.

What is placed is a unit: a group of equal texts, however many rows it has, as long as
it alone holds at most ``group_share`` of a shard's target bytes; a larger group would make
shards uneven by itself, so each of its rows is a unit, and ``split_group`` says so. A coordinate is a metadata value with a hash of the unit below
it, hence no unit is ever cut and ties have one order.

Defined cases: a null text has no bytes (size 8); null metadata are the smallest
value; repeated rows are placed one by one or as one group; columns beyond the
four read are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank.operators.skew import join_by_frequency
from voxrank.session import materialise

ROW_BYTES = 8
#: A group of copies stays whole unless it alone exceeds this share of a shard's target bytes.
GROUP_SHARE = 0.5
_BINS = 1024
_HASH_BITS = 30
_BLOCK_ROWS = 50_000


def _coordinates(dims: dict[str, Column]) -> dict[str, Column]:
    """Metadata values (32 bits) over the unit's hash, as longs."""
    unit = F.shiftrightunsigned(F.xxhash64("unit"), 64 - _HASH_BITS)
    return {f"_d{i}": F.shiftleft(value.cast("long"), _HASH_BITS) + unit for i, value in enumerate(dims.values())}


def _sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("copy"),
        F.crc32(F.coalesce("lang", F.lit("")).cast("binary")).alias("lang"),
        F.crc32(F.coalesce("source", F.lit("")).cast("binary")).alias("source"),
    )


def _cut(points: DataFrame, node_of: Column, goals: dict[int, tuple[int, float]], spans: dict) -> dict[int, int]:
    """For each node its cut: the largest coordinate of the left side.

    ``goals``: node -> (dimension, bytes wanted left); ``spans``: node -> (low, high) along it.
    """
    live = {n: (lo, hi, 0) for n, (lo, hi) in spans.items()}  # interval, bytes below it
    cuts: dict[int, int] = {}
    while live:
        value, low, width = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
        widths = {n: max(1, -(-(hi - lo + 1) // _BINS)) for n, (lo, hi, _) in live.items()}
        for n, (lo, hi, _) in live.items():
            at = F.col(f"_d{goals[n][0]}")
            here = (node_of == n) & at.between(lo, hi)
            value = F.when(here, at).otherwise(value)
            low = F.when(here, F.lit(lo)).otherwise(low)
            width = F.when(here, F.lit(widths[n])).otherwise(width)
        part = F.floor((value - low) / width)
        sums = (
            points.select(node_of.alias("node"), "size", part.alias("part"))
            .where("part is not null").groupBy("node", "part").agg(F.sum("size").alias("bytes")).collect()
        )
        for n in list(live):
            lo, hi, below = live.pop(n)
            goal = goals[n][1]
            end = lo - 1
            for row in sorted((r for r in sums if r.node == n), key=lambda r: r.part):
                first = lo + row.part * widths[n]
                last = min(hi, first + widths[n] - 1)
                if below + row.bytes >= goal:
                    if first == last:  # one unit: it goes to the nearer side
                        cuts[n] = last if below + row.bytes - goal <= goal - below else first - 1
                    else:
                        live[n] = (first, last, below)
                    break
                below += row.bytes
                end = last
            else:
                cuts[n] = end
    return cuts


def assign_shards(docs: DataFrame, shards: int = 24, group_share: float = GROUP_SHARE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and split_group of each row of ``docs``."""
    rows = materialise(_sizes(docs), "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    most = total * group_share / shards
    key = ["copy", "size", "text_crc32"]
    groups = materialise(rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source")), "shard-groups")
    placed = join_by_frequency(rows, groups, key, "copies")  # one text may fill most rows
    large = F.col("copies") * F.col("size") > most
    own = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("copy").cast("string"))
    units = placed.select(
        "doc_id", "size", "text_crc32", F.when(large, own).otherwise(F.col("copy").cast("string")).alias("unit"),
        F.when(large, F.col("lang")).otherwise(F.col("g_lang")).alias("lang"),
        F.when(large, F.col("source")).otherwise(F.col("g_source")).alias("source"),
        (large & (F.col("copies") > 1)).alias("split_group"),
    )
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": F.least(F.col("size"), F.lit(2**32 - 1))}
    points = materialise(units.withColumns(_coordinates(dims)).drop("unit", "lang", "source"), "shard-points")

    names = [f"_d{i}" for i in range(len(dims))]
    splits: dict[tuple[int, int], tuple[int, int]] = {}  # (first shard, shards) -> (dimension, last value left)

    def place(first: int = 0, k: int = shards) -> Column:
        """The first shard of the node that a row has reached."""
        if (first, k) not in splits:
            return F.lit(first)
        dim, cut = splits[first, k]
        return F.when(F.col(names[dim]) > cut, place(first + k // 2, k - k // 2)).otherwise(place(first, k // 2))

    ranges = [f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]
    overall = points.agg(*ranges).first()
    level = {0: shards}
    while any(k > 1 for k in level.values()):
        goals, spans = {}, {}
        for row in points.groupBy(place().alias("node")).agg(F.sum("size").alias("bytes"), *ranges).collect():
            k = level[row.node]
            if k > 1:
                spread = [(row[f"hi{c}"] - row[f"lo{c}"]) / max(1, overall[f"hi{c}"] - overall[f"lo{c}"]) for c in names]
                widest = max(range(len(names)), key=spread.__getitem__)
                goals[row.node] = (widest, row.bytes * (k // 2) / k)
                spans[row.node] = (row[f"lo{names[widest]}"], row[f"hi{names[widest]}"])
        cuts = _cut(points, place(), goals, spans)
        below = {}
        for first, k in level.items():
            if first in cuts:
                splits[first, k] = (goals[first][0], cuts[first])
            below |= {first: k // 2, first + k // 2: k - k // 2} if first in cuts and k > 1 else {first: 1}
        level = below
    at = place()
    # slots: number inside blocks of bounded size, plus the rows of earlier blocks
    blocks = max(1, count // (shards * _BLOCK_ROWS) + 1)
    block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks))
    shard = points.select("doc_id", "size", "text_crc32", "split_group", at.alias("shard"), block.alias("block"))
    sums = shard.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return (
        shard.withColumn("inside", inside).join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).alias("slot"), "split_group")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """The rows of ``docs`` as files under ``path``/shard=N, in slot order. doc_id must be unique."""
    (
        docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
