"""Benchmark decontamination by latent semantic retrieval, with checks for paraphrases.

Texts and benchmark items are sets of hashed, lower-cased words (a word counts once in
a half passage, else repeated words would drown the rest). Word weights are TF-IDF with
document frequencies counted over all texts. A latent space of ``RANK``
dimensions comes from a randomised SVD: the products of the passage matrix with its
transpose and a thin basis are summed over Spark tasks, a few rounds of it give the
leading right singular vectors. They are scaled by the inverse singular values, else
the languages fill the cosine. The space is fitted on all benchmark items and all half
passages of all texts; the search covers
every passage of every text: windows of ``2 * HALF`` words, ``HALF`` apart. Items whose
cosine with a passage reaches ``COSINE`` are its candidates.

Few passages are multiplied with the basis in each round. Beyond ``_DIRECT`` of them the
upper triangle of their Gram matrix, whose size the features alone set, is summed once in
blocks and the rounds read that instead.

A candidate holds if the text around the passage keeps the item's words in order: the
longest common subsequence with some stretch of about the item's length is at least
``SURE`` of the item, or at least ``LIKELY`` of it and the item's answer, its last
sentence, is there too (``SURE`` of it). So reworded copies are found, and chance
overlaps of common words are not.

Defined cases: a null or empty text, and one without a word of an item, is clean;
items without words are ignored; equal items are reported each; repeated rows get the
same result; an empty benchmark leaves every text clean; further columns are ignored.
The benchmark is a query set that must fit a task's memory; ``MOST_ITEMS`` bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrank.llm import textbytes as tb
from voxrank.session import materialise, setting

FEATURES, RANK, HALF = 1 << 14, 192, 32
ROUNDS, SPARE = 3, 16
#: Weight of an item among the passages in the fit of the space.
ITEM_WEIGHT = 3.0
COSINE = 0.45
SURE, LIKELY = 0.8, 0.6
MOST_ITEMS = 100_000
_CHUNK = 1 << 20
_SUMMED = 1024  # features in a block of the partial products
_LINES = 2048  # features in a block of the driver's matrices
_DIRECT, _GROUP = 2_000_000, 5_000_000  # passages without a Gram matrix; passages that one task sums
_BLOCKS = 16  # of the Gram matrix
_LINES_AT_ONCE = 512  # lines gathered at once
_PASSAGES, _PAIRS = 1 << 13, 1 << 18  # passages and pairs of their features at once
_TASKS = 8  # partial products of a round
_BATCH = str(8 << 20)  # bytes that go to Python at once while the space is fitted
U = np.uint64


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the rows' bounds among them."""
    starts, ends, bounds = tb.tokens(data, offsets)
    return tb.token_hashes(tb.lower(data), starts, ends), bounds


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, ascending; several times quicker here than ``np.unique``, which hashes."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys[first]


def _feature(words: np.ndarray) -> np.ndarray:
    return (words >> U(50)).astype(np.int32)


def _half_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every half passage, and the rows' bounds among them."""
    counts = -(-np.diff(bounds) // HALF)
    half_bounds = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(half_bounds[-1]) - np.repeat(half_bounds[:-1], counts)
    return np.repeat(bounds[:-1], counts) + number * HALF, half_bounds


@dataclass
class Items:
    """Benchmark items as word hashes, with the words of their answers."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]


def read_items(benchmark: DataFrame) -> Items:
    rows = benchmark.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    rows = rows.limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"The benchmark has more than {MOST_ITEMS} items; search it in parts.")
    out = Items([], [], [])
    for row in rows:
        hashed = []
        sentences = [s for s in row.text.replace("\n", " ").split(". ") if s.strip()]
        for text in (row.text, sentences[-1] if sentences else ""):
            raw = text.encode()
            hashed.append(_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
        if len(hashed[0]):
            answer = hashed[1] if len(hashed[1]) >= 3 else hashed[0][-5:]
            out.ids.append(row.item_id)
            out.words.append(hashed[0])
            out.answers.append(answer)
    return out


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel in the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        here = places.get(w)
        if here is not None:
            hit = row & here
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


_PACKED = "features binary, sizes binary"  # of each text's passages: their different features, ascending, and how many they are


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of 16-bit values between the bounds."""
    buffers = [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(values.astype("<u2"))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def _values(column: pa.Array) -> np.ndarray:
    """The 16-bit values of all rows, one row after another."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<u2") if data is not None and data.size else np.zeros(0, "<u2")


def _pack(once: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Packed texts from the sorted, different passage * FEATURES + feature, and the texts' bounds among the passages."""
    sizes = np.bincount(once // FEATURES, minlength=bounds[-1])
    return [_binary(once % FEATURES, np.concatenate([[0], np.cumsum(sizes)])[bounds]), _binary(sizes, bounds)]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and sizes of some passages at a time."""
    for batch in batches:
        features, sizes = _values(batch.column("features")), _values(batch.column("sizes")).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, len(sizes), _PASSAGES):
            to = min(at + _PASSAGES, len(sizes))
            yield features[ends[at] : ends[to]], sizes[at:to]


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("words")
        row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        once = _distinct(row * FEATURES + words.flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(_pack(once, np.arange(len(words) + 1)), names=["features", "sizes"])


def _counted(docs: DataFrame) -> tuple[int, np.ndarray, int, DataFrame]:
    """The number of texts, the document frequency of each feature, the number of half passages, and all of them, packed."""
    names = ["at", "counts", "features", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, halves, texts = np.zeros(FEATURES, np.int64), 0, 0
        for _, data, offsets in tb.chunks(batches, _CHUNK):
            texts += len(offsets) - 1
            words, bounds = _words(data, offsets)
            starts, half_bounds = _half_starts(bounds)
            if not len(starts):
                continue
            half = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
            once = _distinct(half * FEATURES + _feature(words))
            halves += len(starts)
            none = [pa.nulls(len(offsets) - 1, kind) for kind in (pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *_pack(once, half_bounds)], names=names)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(half_bounds))
            seen = _distinct(row[once // FEATURES] * FEATURES + once % FEATURES)
            total += np.bincount(seen % FEATURES, minlength=FEATURES)
        places = range(0, FEATURES, _SUMMED)
        counts = [*(total[at : at + _SUMMED].tolist() for at in places), [halves, texts]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*places, FEATURES], pa.int32()), pa.array(counts, pa.list_(pa.int64())),
             *(pa.nulls(len(counts), pa.binary()) for _ in range(2))], names=names)

    counted = materialise(docs.select("text").mapInArrow(run, f"at int, counts array<long>, {_PACKED}"), "word-frequencies")
    frequency = np.zeros(FEATURES + 2)
    each = counted.where("at is not null").select("at", F.posexplode("counts").alias("place", "n"))
    for sums in each.groupBy((F.col("at") + F.col("place")).alias("at")).agg(F.sum("n").alias("n")).collect():
        frequency[sums["at"]] = sums.n
    halves, texts = frequency[-2:].astype(int).tolist()
    return texts, frequency[:-2], halves, counted.where("features is not null").select("features", "sizes")


def _line_sums(lines: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Sums of the ``lines`` at each row of ``places`` to ``out``, in the cache: a product with ones is quicker than a sum."""
    size, wide = places.shape[1], lines.shape[1]
    step = max(1, _LINES_AT_ONCE // size)
    held, ones = np.empty((step, size, wide), lines.dtype), np.ones((1, size), lines.dtype)
    for a in range(0, len(places), step):
        some = places[a : a + step]
        taken = np.take(lines, some, axis=0, out=held[: len(some)], mode="clip")
        np.matmul(ones, taken, out=out[a : a + step].reshape(len(some), 1, wide))


def _sums(lines: np.ndarray, places: np.ndarray, counts: np.ndarray, longest: int = 64) -> np.ndarray:
    """Sums of the ``lines`` at stretches of ``counts`` places.

    Stretches are cut to pieces of equal length: sums along an axis are several times quicker than sums of stretches.
    """
    out, at = np.zeros((len(counts), lines.shape[1]), lines.dtype), np.cumsum(counts) - counts

    def pieces(start: np.ndarray, size: int) -> np.ndarray:
        got = np.empty((len(start), lines.shape[1]), lines.dtype)
        _line_sums(lines, places[start[:, None] + np.arange(size)], got)
        return got

    many = counts // longest
    some = np.flatnonzero(many)
    if len(some):
        first = np.cumsum(many[some]) - many[some]
        number = np.arange(many[some].sum()) - np.repeat(first, many[some])
        out[some] = np.add.reduceat(pieces(np.repeat(at[some], many[some]) + number * longest, longest), first, axis=0)
        at += many * longest
    size = longest // 2
    while size:
        some = np.flatnonzero(counts & size)
        out[some] += pieces(at[some], size)
        at[some] += size
        size //= 2
    return out


def _shares(feature: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One over the squared length of the TF-IDF vector of each passage."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = 1 / np.add.reduceat((idf**2)[feature], (np.cumsum(sizes) - sizes)[some])
    return out


def _rows(feature: np.ndarray, sizes: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """Sums of the lines of ``scaled`` (idf times basis) by passage: the rows of A basis but for the passages' lengths."""
    times = np.bincount(feature, minlength=FEATURES)
    return _sums(scaled[times > 0], (np.cumsum(times > 0) - 1)[feature], sizes)


def _times_gram(feature: np.ndarray, sizes: np.ndarray, idf: np.ndarray, scaled: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A basis), not yet times idf, to ``out`` for the length-normalised TF-IDF matrix A of some passages."""
    times = np.bincount(feature, minlength=FEATURES)
    dense = _rows(feature, sizes, scaled)
    dense *= _shares(feature, sizes, idf).astype(np.float32)[:, None]
    row = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(feature, kind="stable")]
    some = np.flatnonzero(times)
    out[some] += _sums(dense, row, times[some])


def _inner_gram(feature: np.ndarray, sizes: np.ndarray, idf: np.ndarray, scaled: np.ndarray, out: np.ndarray) -> None:
    """Adds (A basis)'(A basis) to ``out``."""
    dense = _rows(feature, sizes, scaled)
    out += (dense * _shares(feature, sizes, idf).astype(np.float32)[:, None]).T @ dense


def _block_bounds() -> np.ndarray:
    """First lines of blocks of the upper triangle, about equal in cells."""
    return np.round(FEATURES * (1 - np.sqrt(1 - np.arange(_BLOCKS + 1) / _BLOCKS))).astype(int)


def _add_pairs(feature: np.ndarray, sizes: np.ndarray, share: np.ndarray, low: int, total: np.ndarray) -> None:
    """Adds the passages' shares to the cells of their pairs of features, the first of them a line of ``total`` (from ``low`` on)."""
    ends = np.cumsum(sizes)
    lines, wide = total.shape
    at = np.flatnonzero((feature >= low) & (feature < low + lines))
    passage = np.searchsorted(ends, at, "right")
    count, weight = ends[passage] - at, share[passage]  # each with itself and those after it
    cell = (feature[at].astype(np.int64) - low) * wide - low
    upto, cells, a = np.cumsum(count), total.reshape(-1), 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + _PAIRS, "right")))
        n = count[a:b]
        second = np.repeat(at[a:b] - (np.cumsum(n) - n), n)
        second += np.arange(len(second))
        np.add.at(cells, feature[second] + np.repeat(cell[a:b], n), np.repeat(weight[a:b], n))
        a = b


_PART = "at int, task int, part binary"


def _part(at: int, task: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int32()), pa.array([task], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["at", "task", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the parts of each place; the parts of a place come one after another."""
    last, total = None, None
    for batch in batches:
        for at, part in zip(batch.column("at").to_pylist(), batch.column("part"), strict=True):
            cells = np.frombuffer(part.as_buffer(), np.float32)
            if at != last and last is not None:
                yield _part(last, 0, total)
            last, total = at, total + cells if at == last else cells
    if last is not None:
        yield _part(last, 0, total)


#: Sums hardly shrink; a reader holds a whole group of rows.
_STORED = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)}


def _gram(packed: DataFrame, idf: np.ndarray, groups: int) -> DataFrame:
    """(at, part): lines of the upper triangle of the passages' Gram matrix, without the factors idf of its lines and columns,
    from the first line of their block on.

    A block of lines stands in one task for each of ``groups`` parts of the passages; each block reads the
    passages anew, which is far less than the pairs of all blocks in a shuffle.
    """
    sent = packed.sparkSession.sparkContext.broadcast(idf)

    def block(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((high - low, FEATURES - low))
            for feature, sizes in _unpacked(batches):
                _add_pairs(feature, sizes, _shares(feature, sizes, sent.value), low, total)
            task = TaskContext.get().partitionId()
            for at in range(low, high):
                yield _part(at, task, total[at - low].astype(np.float32))

        return packed.coalesce(groups).mapInArrow(run, _PART)

    bounds = _block_bounds().tolist()
    # without this empty table Spark would put blocks of one partition each in one task
    parts = packed.sparkSession.range(0).select(
        F.col("id").cast("int").alias("at"), F.col("id").cast("int").alias("task"), F.lit(b"").alias("part"))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        parts = parts.unionByName(block(low, high))
    if groups > 1:
        parts = parts.repartition("at").sortWithinPartitions("at", "task").mapInArrow(_added, _PART)
    return materialise(parts.select("at", "part"), "gram", **_STORED)


def _times_lines(at: int, low: int, lines: np.ndarray, scaled: np.ndarray, out: np.ndarray) -> None:
    """Adds the product of some lines of the triangle (from ``at``, columns from ``low``), and of their mirror, with ``scaled``."""
    own = slice(at, at + len(lines))
    out[own] += lines @ scaled[low:]
    out[low:] += lines.T @ scaled[own]
    out[own] -= np.diag(lines, at - low)[:, None] * scaled[own]  # the diagonal is its own mirror


def _triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """First line, first column and cells of lines that follow each other in one block."""
    bounds = _block_bounds()
    for batch in batches:
        at = batch.column("at").to_numpy()
        low = bounds[np.searchsorted(bounds, at, "right") - 1]
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(low) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if a < b:
                cells = [np.frombuffer(x.as_buffer(), np.float32) for x in batch.column("part")[a:b]]
                yield int(at[a]), int(low[a]), np.stack(cells)


def _orthonormalise(columns: np.ndarray) -> None:
    """Orthonormal columns of the same span, in place.

    QR of blocks of lines, then of their triangles: the driver holds a block in double precision, not copies of the matrix.
    """
    blocks = [columns[at : at + _LINES] for at in range(0, len(columns), _LINES)]
    triangles = [np.linalg.qr(block.astype(np.float64), "r") for block in blocks]
    bounds = np.cumsum([0, *map(len, triangles)])
    turned = np.linalg.qr(np.concatenate(triangles))[0]
    for block, a, b in zip(blocks, bounds[:-1], bounds[1:], strict=True):
        block[:] = np.linalg.qr(block.astype(np.float64))[0] @ turned[a:b]


def latent_space(
    passages: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 3, count: int = 0,
) -> np.ndarray:
    """Features x rank: whitened leading right singular vectors of the TF-IDF matrix of ``passages`` and the items.

    ``passages`` are packed, or ``words``, one a row; more than ``_DIRECT`` by ``count`` go through their Gram matrix.
    """
    spark = passages.sparkSession
    own = [np.unique(_feature(w)) for w in items.words]
    packed = passages.mapInArrow(_pack_words, _PACKED) if "words" in passages.columns else passages
    whole = count > _DIRECT
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", _BATCH):
        held = _gram(packed, idf, -(-count // _GROUP)) if whole else packed
    weight = idf.astype(np.float32)[:, None]

    def times(basis: np.ndarray, inner: bool = False) -> np.ndarray:
        """A'(A basis), or if ``inner`` (A basis)'(A basis), for the matrix A of passages and items."""
        width = basis.shape[1]  # the functions below must not hold the basis itself: they would be sent with it, besides the broadcast
        sent = spark.sparkContext.broadcast((basis, idf))
        lines = width if inner else FEATURES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, idf = sent.value
            weight = idf.astype(np.float32)[:, None]
            scaled, total = basis * weight, np.zeros((FEATURES if whole else lines, width), np.float32)
            if whole:
                for at, low, cells in _triangle(batches):
                    _times_lines(at, low, cells, scaled, total)
            else:
                for feature, sizes in _unpacked(batches):
                    (_inner_gram if inner else _times_gram)(feature, sizes, idf, scaled, total)
            if inner and whole:
                total = scaled.T @ total
            elif not inner:
                total *= weight
            task = TaskContext.get().partitionId()
            for at in range(0, lines, _SUMMED):
                yield _part(at, task, total[at : at + _SUMMED])

        # few partial sums are added by feature, in one order, and one matrix comes back, a quarter at a time
        parts = held.coalesce(_TASKS).mapInArrow(run, _PART)
        parts = parts.repartition("at").sortWithinPartitions("at", "task").mapInArrow(_added, _PART).coalesce(4)
        total = np.zeros((lines, width), np.float32)
        for at in range(0, len(own), 250):
            feature, sizes = np.concatenate(own[at : at + 250]), np.array([len(x) for x in own[at : at + 250]])
            some = np.unique(feature)
            place, scaled = np.searchsorted(some, feature), basis[some] * weight[some]
            dense = _sums(scaled, place, sizes)
            shared = dense * _shares(feature, sizes, idf).astype(np.float32)[:, None]
            if inner:
                total += shared.T @ dense
            else:
                row = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(feature, kind="stable")]
                total[some] += weight[some] * _sums(shared, row, np.bincount(place))
        total *= np.float32(ITEM_WEIGHT**2)
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", _BATCH):
            for part in parts.toLocalIterator():
                total[part["at"] : part["at"] + _SUMMED] += np.frombuffer(part["part"], np.float32).reshape(-1, width)
        sent.destroy()
        return total

    width = min(rank + SPARE, FEATURES)
    basis, random = np.empty((FEATURES, width), np.float32), np.random.default_rng(seed)
    for at in range(0, FEATURES, _LINES):
        basis[at : at + _LINES] = random.standard_normal(basis[at : at + _LINES].shape)
    _orthonormalise(basis)
    for _ in range(ROUNDS - 1):
        basis = times(basis)
        _orthonormalise(basis)
    values, vectors = np.linalg.eigh(times(basis, inner=True))
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-6 * values.max()]
    space = basis @ vectors[:, best]
    space /= np.sqrt(values[best])
    return space


def _overlap(item: np.ndarray, answer: np.ndarray, text: np.ndarray) -> float:
    """Share of the item kept in order in some stretch of the text of about its length, 0 if the checks fail."""
    shared = np.isin(text, item)
    if shared.sum() < LIKELY * len(item):
        return 0.0
    span = len(item) + max(2, len(item) // 4)
    found = np.flatnonzero(shared)
    best = 0.0
    inside = np.searchsorted(found, found + span) - np.arange(len(found))  # shared words from each on
    for k in np.flatnonzero(inside >= max(LIKELY * len(item), best * len(item))):
        if inside[k] <= best * len(item):
            continue
        stretch = text[found[k] : found[k] + span]
        share = lcs(item, stretch) / len(item)
        if share < SURE and (share < LIKELY or lcs(answer, stretch) < SURE * len(answer)):
            continue
        best = max(best, share)
        if best == 1.0:
            break
    return best


class Scanner:
    """The fitted space with the items, and the search for them in chunks of texts."""

    def __init__(self, docs: DataFrame, items: Items, cosine: float):
        texts, frequency, halves, passages = _counted(docs)
        idf = np.log((1 + texts) / (1 + frequency)) + 1
        self.items, self.cosine = items, cosine
        space = latent_space(passages, items, idf, count=halves)
        self.table = np.zeros((FEATURES + 1, space.shape[1]), np.float32)  # the last line stands for no word
        np.multiply(space, idf[:, None], out=self.table[:-1])
        targets = np.array([self.table[np.unique(_feature(w))].sum(axis=0) for w in items.words])
        self.targets = targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)

    def _passages(self, words: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Unit vectors of the passages: each half with the next one of its text."""
        half = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        once = _distinct(half * FEATURES + _feature(words))
        first = np.searchsorted(once, np.arange(len(starts) + 1) * FEATURES)
        # lines of equal length: sums along an axis are several times quicker than sums of stretches
        at = np.full((len(starts), HALF), FEATURES, np.int32)
        at[np.arange(HALF) < np.diff(first)[:, None]] = once % FEATURES
        halves = np.empty((len(starts), self.table.shape[1]), np.float32)
        _line_sums(self.table, at, halves)
        follows = np.flatnonzero(row[1:] == row[:-1])
        whole = halves.copy()
        whole[follows] += halves[follows + 1]
        return whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[dict[int, float]]:
        """For each text the items found in it, by number, and the share of each that it keeps."""
        words, bounds = _words(data, offsets)
        starts, half_bounds = _half_starts(bounds)
        found: list[dict[int, float]] = [{} for _ in range(len(offsets) - 1)]
        if not len(starts):
            return found
        row = np.repeat(np.arange(len(found)), np.diff(half_bounds))
        passages = self._passages(words, starts, row)
        for a in range(0, len(passages), 8192):
            near = passages[a : a + 8192] @ self.targets.T >= self.cosine
            for p, i in zip(*np.nonzero(near), strict=True):
                r = row[a + p]
                if found[r].get(i, 0.0) == 1.0:
                    continue
                item = self.items.words[i]
                low = max(bounds[r], starts[a + p] - HALF)
                high = min(bounds[r + 1], starts[a + p] + 2 * HALF + max(HALF, len(item)))
                share = _overlap(item, self.items.answers[i], words[low:high])
                if share:
                    found[r][i] = max(found[r].get(i, 0.0), share)
        return found


def scan(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, sample: int | None = None) -> DataFrame:
    """doc_id, contaminated, items (ids of the items found, ascending) and overlap (the largest share) of each row.

    ``sample`` has no effect: the space is fitted on all passages.
    """
    items = read_items(benchmark)
    item_type = dict(benchmark.dtypes)["item_id"]
    names = ["doc_id", "contaminated", "items", "overlap"]
    if not items.ids:
        none = F.array().cast(f"array<{item_type}>")
        return docs.select("doc_id", F.lit(False).alias(names[1]), none.alias(names[2]), F.lit(0.0).alias(names[3]))
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(docs, items, cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.chunks(batches, _CHUNK):
            found = sent.value.find(data, offsets)
            ids = [sorted(sent.value.items.ids[i] for i in f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([bool(f) for f in found]),
                 pa.array([[str(i) for i in x] for x in ids], pa.list_(pa.string())),
                 pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, contaminated boolean, items array<string>, overlap double"
    result = docs.select("doc_id", "text").mapInArrow(run, schema)
    return result.withColumn("items", F.col("items").cast(f"array<{item_type}>"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged and unshuffled."""
    items = read_items(benchmark)
    if not items.ids:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(docs, items, cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.chunks(batches, _CHUNK):
            yield rows.filter(pa.array([not f for f in sent.value.find(data, offsets)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
