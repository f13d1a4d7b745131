"""Hard-negative mining over an inverted multi-index.

The components of a vector become whole numbers and its halves are coded by two codebooks,
so a vector stands in the cell (code of the first half, code of the second). For an
anchor, a code's bound is its half score with the codeword plus the code's radius times
the half's length: no member can score more. A heap walks the cells in falling order of the
two bounds' sum (the multi-sequence algorithm) and stops once the next bound is below
what the list still needs, so the lists are certified exact, whatever the codebooks.

Rows are dealt by a hash of vec_id into parts of bounded size, each with its own
index over the common codebooks; anchors, in blocks, visit every part, and the best of all
parts are ranked. One pass finds the positives of each anchor, a second one the windows of
negatives below each positive. Nothing is broadcast but the codebooks; one task holds one
part and one block of anchors. Equal vectors spread over the parts like any others.

The codebooks are fitted on at most ``sample`` rows, taken by a hash of vec_id; every row is indexed.

Defined cases: rows with a null id, label or vector, or with a null, infinite or not-a-number
component take no part; shorter vectors count as ending in zeros, an empty one too; a
repeated vec_id counts once, as its least (label, whole components as bytes); an anchor
without positives or a positive without negatives has no row; other columns are ignored;
an empty table gives an empty result. Components must stay below 2**23 in size, and scores
below 2**62: larger ones stop the job with a message, as they would not fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank.session import materialise

SAMPLE, CODES, FIT_ROUNDS = 8_192, 16, 10
POSITIVES, NEGATIVES = 5, 10
#: Negatives score between these percentages of their positive's score.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Rows of one part, anchors of one block, rows scored at a time.
PART_ROWS, BLOCK_ANCHORS, _BATCH = 65_536, 65_536, 2_048
_SCALE = 256


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vec, norm2) of the rows that take part; ``vec`` holds 32-bit whole components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(sound)
    known = known.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("parts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            values = np.floor(_SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            if len(values) and np.abs(values).max() >= 2**31:
                raise ValueError("A vector component is too large: whole components must fit 32 bits.")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            squares = np.concatenate([[0.0], np.cumsum(values * values)])
            packed = pa.Array.from_buffers(
                pa.large_binary(), len(lists), [None, pa.py_buffer(ends * 4), pa.py_buffer(values.astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), packed.cast(pa.binary()), pa.array(squares[ends[1:]] - squares[ends[:-1]])],
                names=["vec_id", "label", "vec", "norm2"])

    return known.mapInArrow(pack, "vec_id long, label long, vec binary, norm2 double")


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in vectors), "<i4").reshape(len(vectors), width)


def fit_codes(half: np.ndarray, codes: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Codewords of one half by Lloyd's rounds from evenly spread rows."""
    words = half[np.unique(np.linspace(0, len(half) - 1, min(codes, len(half))).astype(int))].astype(float)
    for _ in range(rounds):
        code = nearest(half, words)
        counts = np.bincount(code, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, code, half)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def nearest(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2.0 * (half @ words.T)).argmin(1) if half.shape[1] else np.zeros(len(half), int)


class MultiIndex:
    """The rows of one part by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, words: tuple[np.ndarray, np.ndarray], exact: type):
        cut = words[0].shape[1]
        self.words, self.halves = words, (slice(0, cut), slice(cut, None))
        codes = [nearest(rows[:, h].astype(float), w) for h, w in zip(self.halves, words, strict=True)]
        self.radii = []
        for h, w, code in zip(self.halves, words, codes, strict=True):
            radius = np.full(len(w), -np.inf)  # a code without rows bounds nothing
            np.maximum.at(radius, code, np.sqrt(((rows[:, h] - w[code]) ** 2).sum(1)))
            self.radii.append(radius)
        cell = codes[0] * len(words[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order].astype(exact)
        self.bounds = np.searchsorted(cell[order], np.arange(len(words[0]) * len(words[1]) + 1))

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(most, least) score of a cell and its first and last row, most first; empty cells are passed over."""
        tops, lows, orders = [], [], []
        for h, w, radius in zip(self.halves, self.words, self.radii, strict=True):
            half = anchor[h].astype(float)
            score, length = w @ half, np.sqrt(half @ half)
            reach = np.where(np.isinf(radius), 0, radius) * length
            slack = 1e-9 * (np.abs(score) + reach) + 1e-6
            tops.append(np.where(np.isinf(radius), -np.inf, score + reach + slack))
            lows.append(score - reach - slack)
            orders.append([int(i) for i in np.argsort(-tops[-1], kind="stable") if tops[-1][i] > -np.inf])
        first, second = ([t[i] for i in o] for t, o in zip(tops, orders, strict=True))
        heap = [(-(first[0] + second[0]), 0, 0)] if first and second else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            a, b = orders[0][i], orders[1][j]
            at = a * len(self.words[1]) + b
            if self.bounds[at] < self.bounds[at + 1]:
                yield -bound, lows[0][a] + lows[1][b], int(self.bounds[at]), int(self.bounds[at + 1])

    def walk(self, anchor: np.ndarray, label: int, same: bool, windows: list["Window_"]) -> None:
        """Fill the windows with the best rows of the same, or of another, label."""
        held: list[np.ndarray] = []
        size = 0
        query = anchor.astype(self.rows.dtype)

        def settle() -> None:
            nonlocal size
            rows = np.concatenate(held)
            rows = rows[(self.labels[rows] == label) == same]
            scores = (self.rows[rows] @ query).astype(np.int64)
            for w in windows:
                w.take(scores, self.ids[rows])
            held.clear()
            size = 0

        for most, least, first, last in self.cells(anchor):
            need = min(w.need for w in windows)
            if most < need:  # no later cell can hold a row that a window needs
                break
            if least > max(w.high for w in windows):
                continue
            held.append(np.arange(first, last))
            size += last - first
            if size >= _BATCH:
                settle()
        if held:
            settle()


class Window_:
    """The best ``size`` rows with scores from ``low`` to ``high``: higher scores first, then smaller ids."""

    def __init__(self, low: float, high: float, size: int, without: int | None = None):
        self.low, self.high, self.size, self.without = low, high, size, without
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.need = low

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.need) & (scores <= self.high)
        if self.without is not None:
            fits &= ids != self.without
        if not fits.any():
            return
        scores, ids = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
        order = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.size:
            self.need = int(self.scores[-1])


def score_range(positive: int, least: int = LEAST_PERCENT, most: int = MOST_PERCENT) -> tuple[int, int]:
    """The scores n with least * positive <= 100 * n <= most * positive; none if the first is above the second."""
    return -(-least * positive // 100), most * positive // 100


class Miner:
    """The parts of an indexed table, and the searches of blocks of anchors in them."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, codes: int = CODES,
                 part_rows: int = PART_ROWS, block_anchors: int = BLOCK_ANCHORS):
        self.vectors = materialise(vectors, "whole-vectors")
        facts = self.vectors.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes"), F.max("norm2").alias("norm2")).first()
        self.rows, self.width = facts.n, (facts.bytes or 0) // 4
        norm2 = facts.norm2 or 0.0
        if norm2 >= 2**62:
            raise ValueError("Vectors are too long: their scores would not fit a long.")
        self.exact = np.float32 if norm2 < 2**24 else np.float64 if norm2 < 2**53 else np.int64
        some = self.vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).collect() if self.rows else []
        fitted = _matrix([bytes(r.vec) for r in some], self.width).astype(float)
        cut = self.width // 2
        self.words = fit_codes(fitted[:, :cut], codes), fit_codes(fitted[:, cut:], codes)
        # parts of bounded size; a small table is still cut into some, to use more tasks than one
        self.parts = max(1, -(-self.rows // part_rows), min(8, self.rows // 4_096))
        self.block_anchors = block_anchors

    def anchors(self, every: int) -> DataFrame:
        """(anchor_id, label, vec): the rows whose id is divisible by ``every``."""
        one = self.vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
        return one.select(F.col("vec_id").alias("anchor_id"), "r.label", "r.vec")

    def search(self, anchors: DataFrame, kind: str, schema: str) -> DataFrame:
        """What each block of ``anchors`` finds in each part; ``kind``: "positives" or "negatives"."""
        count = anchors.count()
        blocks = max(1, -(-count // self.block_anchors))
        part = F.pmod(F.xxhash64("vec_id"), F.lit(self.parts)).cast("int")
        rows = self.vectors.select(
            part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "label", "vec")
        block = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")
        asked = anchors.withColumns({
            "block": block, "part": F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))})
        words, width, exact = self.words, self.width, self.exact
        find = _positives if kind == "positives" else _negatives
        names = [c.split()[0] for c in schema.split(", ")]

        def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if held.num_rows and wanted.num_rows:
                index = _index_of(held, width, words, exact)
                vectors = _matrix(wanted.column("vec").to_pylist(), width)
                lists = wanted.column("positives").to_pylist() if "positives" in wanted.column_names else [None] * len(vectors)
                for anchor, label, vector, given in zip(
                    wanted.column("anchor_id").to_pylist(), wanted.column("label").to_pylist(), vectors, lists, strict=True
                ):
                    found += find(index, anchor, label, vector, given)
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

        return rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, schema)

    def positives(self, anchors: DataFrame) -> DataFrame:
        """(anchor_id, positive_id, positive_score): the first rows of each anchor's label."""
        found = self.search(anchors, "positives", "anchor_id long, positive_id long, positive_score long")
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= POSITIVES).drop("_n")

    def mine(self, every: int = 100) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
        anchors = materialise(self.anchors(every), "anchors")
        best = self.positives(anchors).groupBy("anchor_id").agg(
            F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))  # at most POSITIVES
        asked = materialise(anchors.join(best, "anchor_id"), "anchor-positives")
        found = self.search(
            asked, "negatives",
            "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
        return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _index_of(held: pa.Table, width: int, words: tuple[np.ndarray, np.ndarray], exact: type) -> MultiIndex:
    ids, labels = (np.asarray(held.column(c).to_numpy()) for c in ("vec_id", "label"))
    vectors = held.column("vec").to_pylist()
    unique, counts = np.unique(ids, return_counts=True)
    if len(unique) < len(ids):  # the least (label, bytes) of each repeated id
        again = set(unique[counts > 1].tolist())
        best: dict[int, int] = {}
        keep = np.ones(len(ids), bool)
        for i in np.flatnonzero(np.isin(ids, list(again))):
            rival = best.get(int(ids[i]))
            if rival is None or (labels[i], vectors[i]) < (labels[rival], vectors[rival]):
                best[int(ids[i])] = i
            keep[i] = False
        keep[list(best.values())] = True
        ids, labels, vectors = ids[keep], labels[keep], [v for v, k in zip(vectors, keep, strict=True) if k]
    return MultiIndex(ids, labels, _matrix(vectors, width), words, exact)


def _positives(index: MultiIndex, anchor: int, label: int, vector: np.ndarray, _: None) -> list[tuple]:
    best = Window_(-np.inf, np.inf, POSITIVES, without=anchor)
    index.walk(vector, label, True, [best])
    return [(anchor, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]


def _negatives(index: MultiIndex, anchor: int, label: int, vector: np.ndarray, positives: list[dict]) -> list[tuple]:
    windows = [(p, Window_(*score_range(p["positive_score"]), NEGATIVES)) for p in positives]
    windows = [(p, w) for p, w in windows if w.low <= w.high]
    if windows:
        index.walk(vector, label, False, [w for _, w in windows])
    return [
        (anchor, p["positive_id"], p["positive_score"], i, s)
        for p, w in windows for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)
    ]


def relabelled(label: Column, vec_id: Column, every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one for ids divisible by ``every``."""
    return F.when(vec_id % every == 0, (label + 1) % labels).otherwise(label)
