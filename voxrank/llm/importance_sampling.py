"""Quality selection by importance resampling over hashed n-grams.

Two generative models, both bags of hashed words and word pairs: the target model is
counted on labelled texts of good quality (at most ``sample`` of them, taken by a hash
of doc_id), the raw model on all texts. A text's log weight is the log ratio of its
probability under the two. Texts are drawn without replacement in proportion to their
weight by Gumbel top-k: the k texts with the largest log weight plus Gumbel noise,
where the noise is a hash of the row, so a draw can be repeated.

The k-th largest key is found by counting in ever finer intervals; nothing but the
counts of at most ``_BINS`` intervals reaches the driver.

Defined cases: a null or empty text has log weight 0; repeated rows (same id and text)
have the same key, and all rows tied at the cut are drawn; k is the rounded share of
all rows; without good labels every weight is 0 and the draw is uniform; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrank.llm import textbytes as tb
from voxrank.session import materialise

BUCKETS = 1 << 14
SAMPLE = 20_000
SHARE = 0.85
SEED = 7
_BINS = 4096
_SCALE = 1_000_000  # keys are compared at this many steps a unit


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the row of each."""
    starts, ends, bounds = tb.tokens(data, offsets)
    words = tb.token_hashes(data, starts, ends)
    pairs, pair_bounds = tb.window_hashes(words, bounds, 2)
    rows = np.arange(len(offsets) - 1)
    bucket = np.concatenate([words, pairs]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([np.repeat(rows, np.diff(bounds)), np.repeat(rows, np.diff(pair_bounds))])


def good_ids(labels: DataFrame, sample: int) -> set:
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return {r.doc_id for r in chosen.collect()}


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """ln(p_target / p_raw) of each bucket, both with add-one smoothing."""
    good = docs.sparkSession.sparkContext.broadcast(good_ids(labels, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for rows, data, offsets in tb.chunks(batches):
            bucket, row = _features(data, offsets)
            marked = np.array([i in good.value for i in rows.column("doc_id").to_pylist()], bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[marked[row]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "raw": raw[seen], "target": target[seen]})

    sums = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    table = np.zeros((2, BUCKETS))
    for r in sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        table[:, r.bucket] = r.raw, r.target
    if not table[1].any():
        return np.zeros(BUCKETS)
    raw, target = (table + 1) / (table + 1).sum(axis=1, keepdims=True)
    return np.log(target / raw)


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, text_hash and log_weight of each row."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = rows.drop("text").schema.add("log_weight", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.chunks(batches):
            bucket, row = _features(data, offsets)
            sums = np.bincount(row, table.value[bucket], rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(sums)], names=schema.names)

    return rows.mapInArrow(run, schema)


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of the one long column of ``values``, counting equal ones; None if k < 1."""
    name = values.columns[0]
    low, high = values.agg(F.min(name), F.max(name)).first()
    if k < 1 or low is None:
        return None
    while low < high:
        width = -(-(high - low + 1) // _BINS)
        bins = values.where(F.col(name).between(low, high)).groupBy(F.floor((F.col(name) - low) / width).alias("bin")).count()
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if k <= r["count"]:
                low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
                break
            k -= r["count"]
        else:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key and sampled of each row."""
    scored = weights(docs, log_ratios(docs, labels, sample))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    key = F.round((F.col("log_weight") - F.log(-F.log(uniform))) * _SCALE).cast("long")
    keyed = materialise(scored.withColumn("key", key), "gumbel-keys")
    cut = kth_largest(keyed.select("key"), round(share * keyed.count()))
    drawn = F.lit(False) if cut is None else F.col("key") >= cut
    return keyed.select("doc_id", "log_weight", (F.col("key") / _SCALE).alias("gumbel_key"), drawn.alias("sampled"))
