"""SentencePiece encoding with N-best segmentation, and decoding that restores every text.

The lattice has an edge for each vocabulary piece at each byte of the text, and one
single-byte edge per byte (the byte pieces), so any text can be segmented. A piece's
score is ``-ln(1 + rank)``, a Zipf estimate of its log probability: the merge ranks
of a BPE vocabulary are no log probabilities themselves.

No piece holds a space after another character or a line break, so the lattice of a
text falls into independent lattices of units (the spaces before a word, and the
word). The best segmentation of a text joins those of its units; its N best differ
from it only in the N-1 unit occurrences whose second segmentation costs least.
Forward and backward Viterbi scores of all different units of a chunk are computed
together with numpy and give that cost exactly. In the chosen units a backward A*
search lists the segmentations: the forward Viterbi score of a position is the exact
best rest, so paths leave the agenda in order of their score (to six digits).

Defined cases: a null text has null ids and decodes to null, an empty text has no
ids; ties go to the longer last piece; long tokens take memory in proportion; rows
are handled one by one, so repeated rows and other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxrank.llm import textbytes as tb

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: A byte piece scores this much less than the rarest piece.
BYTE_PENALTY = 10.0
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_CELLS = 1 << 20  # lattice cells worked on at once

EDIT = "struct<at:int,drop:int,ids:array<int>>"
ENCODED = f"ids array<int>, score double, nbest array<struct<score:double,edits:array<{EDIT}>>>"


class Pieces:
    """The vocabulary as tables; small, made on the driver and sent with the tasks."""

    def __init__(self, model_path: str = MODEL_PATH):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = []
        self.score = np.full(n, -np.inf)
        self.byte_ids = np.zeros(256, np.int32)
        usable = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                usable.append(i)
                self.bytes.append(piece.replace("▁", " ").encode())
        for rank, i in enumerate(sorted(usable, key=lambda i: (-model.get_score(i), i))):
            self.score[i] = -math.log1p(rank + 1)
        self.byte_score = float(self.score[usable].min()) - BYTE_PENALTY
        self.score[self.byte_ids] = self.byte_score
        self.by_bytes = {self.bytes[i]: i for i in reversed(usable)}
        self.longest = max(map(len, self.by_bytes))
        keys, ids = zip(*sorted((self._key(b), i) for b, i in self.by_bytes.items()), strict=True)
        self.keys, self.ids = np.array(keys, U), np.array(ids, np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U(44)).astype(np.int64)] = True

    @staticmethod
    def _key(piece: bytes) -> int:
        h = np.zeros(1, U)
        for b in piece:
            h = h * _STEP + U(b + 1)
        return int(tb.mix(h + U(len(piece)))[0])

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is no piece."""
        keys = tb.mix(hashes + U(length))
        out = np.full(keys.shape, -1, np.int32)
        where = np.flatnonzero(self.maybe[(keys >> U(44)).astype(np.int64)].ravel())
        if len(where):
            wanted = keys.ravel()[where]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            out.ravel()[where[hit]] = self.ids[at[hit]]
        return out


def best_segments(matrix: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentation of equally long units: ids (padded left with -1), piece counts, scores, cost of the second best."""
    count, n = matrix.shape
    rows = np.arange(count)
    lengths = range(1, min(n, pieces.longest) + 1)
    edge_ids, edge_scores = {}, {}
    hashes = np.zeros((count, n), U)
    for length in lengths:
        hashes = hashes[:, : n - length + 1] * _STEP + (matrix[:, length - 1 :].astype(U) + U(1))
        ids = pieces.find(hashes, length)
        if length == 1:
            ids = np.where(ids < 0, pieces.byte_ids[matrix], ids)
        elif not (ids >= 0).any():
            continue
        edge_ids[length] = ids
        edge_scores[length] = np.where(ids >= 0, pieces.score[ids], -np.inf)
    forward, backward = np.full((count, n + 1), -np.inf), np.full((count, n + 1), -np.inf)
    forward[:, 0] = backward[:, n] = 0
    last = np.zeros((count, n + 1), np.int32)
    longest_first = sorted(edge_ids, reverse=True)
    for end in range(1, n + 1):
        for length in longest_first:
            if length <= end:
                score = forward[:, end - length] + edge_scores[length][:, end - length]
                better = score > forward[:, end]
                forward[better, end] = score[better]
                last[better, end] = length
    for start in range(n - 1, -1, -1):
        for length in longest_first:
            if start + length <= n:
                np.maximum(backward[:, start], edge_scores[length][:, start] + backward[:, start + length], out=backward[:, start])
    out = np.full((count, n), -1, np.int32)
    used = {length: np.zeros((count, n - length + 1), bool) for length in edge_ids}
    end, filled, live = np.full(count, n), np.zeros(count, np.int64), rows
    while len(live):
        step = last[live, end[live]]
        filled[live] += 1
        for length in np.unique(step):
            here = live[step == length]
            start = end[here] - length
            out[here, n - filled[here]] = edge_ids[length][here, start]
            used[length][here, start] = True
        end[live] -= step
        live = live[end[live] > 0]
    second = np.full(count, -np.inf)
    for length, scores in edge_scores.items():
        through = forward[:, : n - length + 1] + scores + backward[:, length:]
        through[used[length]] = -np.inf
        np.maximum(second, through.max(axis=1), out=second)
    return out, filled, forward[:, n], np.maximum(forward[:, n] - second, 0)


def n_best_unit(unit: bytes, pieces: Pieces, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n_best`` segmentations of one unit, best first, by backward A* under forward Viterbi scores."""
    size = len(unit)
    edges: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]  # by end: start, id, score
    forward = [0.0] + [-math.inf] * size
    for end in range(1, size + 1):
        for start in range(end - 1, max(-1, end - pieces.longest - 1), -1):
            i = pieces.by_bytes.get(unit[start:end])
            if i is None and end - start == 1:
                i = int(pieces.byte_ids[unit[start]])
            if i is not None:
                score = float(pieces.score[i])
                edges[end].append((start, i, score))
                forward[end] = max(forward[end], forward[start] + score)
    found: list[tuple[float, tuple[int, ...]]] = []
    # equal totals (to the sixth digit) leave the agenda youngest first, so ties do not fan out;
    # a path is its first piece and the rest of it
    agenda = [(-round(forward[size], 6), 0, size, 0.0, None)]
    pushed = 0
    while agenda and len(found) < n_best:
        _, _, at, done, path = heapq.heappop(agenda)
        if at == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            found.append((done, tuple(ids)))
            continue
        for start, i, score in edges[at]:
            pushed += 1
            heapq.heappush(agenda, (-round(forward[start] + score + done, 6), -pushed, start, score + done, (i, path)))
    return found


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, which cover every byte, and the rows' bounds among them."""
    space, line = data == 0x20, data == 0x0A
    opens = line.copy()
    opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


class _Known:
    """Best segmentations of the units seen so far, by hash; forgotten when there are too many."""

    most = 100_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hash, self.ids = np.zeros(0, U), np.zeros(0, np.int32)
        self.count, self.where = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.cost = np.zeros(0), np.zeros(0)

    def add(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> None:
        count, score, cost = np.zeros(len(hashes), np.int64), np.zeros(len(hashes)), np.zeros(len(hashes))
        where, flat, stored = np.zeros(len(hashes), np.int64), [self.ids], len(self.ids)
        for size in np.unique(sizes):
            members = np.flatnonzero(sizes == size)
            step = max(1, _CELLS // int(size * min(size, pieces.longest)))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                ids, count[part], score[part], cost[part] = best_segments(
                    tb.rows_matrix(data, starts[part], int(size)), pieces)
                flat.append(ids[ids >= 0])
                where[part] = stored + np.concatenate([[0], np.cumsum(count[part])[:-1]])
                stored += len(flat[-1])
        self.ids = np.concatenate(flat)
        merged = np.concatenate([self.hash, hashes])
        order = np.argsort(merged, kind="stable")
        self.hash = merged[order]
        for name, new in (("count", count), ("where", where), ("score", score), ("cost", cost)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])


class _Chunk:
    """Best segmentation of all units of a chunk, flat."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pieces: Pieces, known: _Known):
        self.data = data
        self.starts, self.ends, self.bounds = _units(data, offsets)
        hashes, first, unit = np.unique(tb.token_hashes(data, self.starts, self.ends), return_index=True, return_inverse=True)
        if len(known.hash) > known.most:
            known.clear()
        new = ~np.isin(hashes, known.hash)
        if new.any():
            first = first[new]
            known.add(data, hashes[new], self.starts[first], self.ends[first] - self.starts[first], pieces)
        at = np.searchsorted(known.hash, hashes)[unit]
        self.count, self.score, self.cost = known.count[at], known.score[at], known.cost[at]
        self.id_bounds = np.concatenate([[0], np.cumsum(self.count)])
        gaps = np.repeat(known.where[at] - self.id_bounds[:-1], self.count)
        self.ids = known.ids[gaps + np.arange(self.id_bounds[-1])]

    def unit_bytes(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def _alternatives(chunk: _Chunk, low: int, high: int, pieces: Pieces, n_best: int, listed: dict) -> list[tuple[float, list]]:
    """Score below the best, and edits, of the 2nd to N-th best segmentation of the units low..high."""
    cost = chunk.cost[low:high]
    some = min(n_best - 1, len(cost))
    nearest = np.sort(np.lexsort((np.arange(len(cost)), cost))[:some] if len(cost) <= 64 else _least(cost, some))
    sums: list[tuple[float, list]] = [(0.0, [])]
    for k in nearest:
        unit = chunk.unit_bytes(low + k)
        if unit not in listed:
            if len(listed) > 50_000:
                listed.clear()
            listed[unit] = n_best_unit(unit, pieces, n_best)
        options = listed[unit]
        at = int(chunk.id_bounds[low + k] - chunk.id_bounds[low])
        drop = int(chunk.count[low + k])
        best = options[0][0]
        sums = heapq.nsmallest(n_best, (
            (loss + best - score, edits + [{"at": at, "drop": drop, "ids": list(path)}] * (j > 0))
            for loss, edits in sums for j, (score, path) in enumerate(options)), key=lambda x: x[0])
    return sums[1:]


def _least(cost: np.ndarray, some: int) -> np.ndarray:
    part = np.argpartition(cost, some)
    limit = cost[part[:some]].max() if some else -1.0
    below, ties = np.flatnonzero(cost < limit), np.flatnonzero(cost == limit)
    return np.concatenate([below, ties[: some - len(below)]])


def _encoder(pieces, n_best: int, keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of the ``keep`` columns and the text to batches of the ``keep`` columns, ids, score and nbest."""
    names = [*keep, "ids", "score", "nbest"]
    kinds = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct(
        [("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, listed, known = pieces.value, {}, _Known()
        for rows, data, offsets in tb.chunks(batches, 1 << 20):
            null = np.array(rows.column("text").is_null())
            # the encoder sees a space before each text that is not empty
            sizes = np.diff(offsets)
            grown = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
            spaced = np.full(int(grown[-1]), 0x20, np.uint8)
            fill = np.ones(len(spaced), bool)
            fill[grown[:-1][sizes > 0]] = False
            spaced[fill] = data
            chunk = _Chunk(spaced, grown, table, known)
            bounds = chunk.id_bounds[chunk.bounds]
            unit_scores = np.concatenate([[0.0], np.cumsum(chunk.score)])
            scores = unit_scores[chunk.bounds[1:]] - unit_scores[chunk.bounds[:-1]]
            others = []
            for r, score in enumerate(scores):
                low, high = chunk.bounds[r], chunk.bounds[r + 1]
                others.append(None if null[r] else [
                    {"score": float(score - loss), "edits": edits}
                    for loss, edits in _alternatives(chunk, low, high, table, n_best, listed)])
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(chunk.ids.astype(np.int32)), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), ids, pa.array(scores, mask=null), pa.array(others, kinds)], names=names)

    return run


def encode(docs: DataFrame, n_best: int = N_BEST, model_path: str = MODEL_PATH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ids, score and nbest (the 2nd to N-th best, as edits of ids: replace ``drop`` ids at ``at``)."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(ENCODED).fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_encoder(pieces, n_best, keep), schema)


def _decoder(pieces, keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the ``keep`` columns and ids to batches of the ``keep`` columns and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        lengths = np.array([len(b) for b in table.bytes])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        letters = np.frombuffer(b"".join(table.bytes), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                column = rows.column("ids")
                null = np.array(column.is_null())
                ids = np.asarray(column.flatten())
                counts = np.array(column.value_lengths().fill_null(0))
                size = lengths[ids]
                ends = np.concatenate([[0], np.cumsum(size)])
                data = letters[np.repeat(begin[ids] - ends[:-1], size) + np.arange(ends[-1])]
                bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
                kept = np.ones(len(data), bool)
                kept[bounds[:-1][counts > 0]] = False  # the space before the text
                bounds = bounds - np.concatenate([[0], np.cumsum(counts > 0)])
                buffers = [pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[kept])]
                text = pa.LargeStringArray.from_buffers(len(rows), *buffers).cast(pa.string())
                if null.any():
                    text = pa.array([None if n else t for n, t in zip(null, text.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), text], names=[*keep, "text"])

    return run


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the text that ``ids`` stand for."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces(model_path))
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(_decoder(pieces, keep), schema)


def round_trip(docs: DataFrame, n_best: int = N_BEST, model_path: str = MODEL_PATH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decode`` of ``encode``: the ``keep`` columns with ids, score, nbest and the text that the ids stand for.

    Both run in one Python worker a task and share one vocabulary: as two steps they hold two workers, and the ids and
    edits cross between them through the JVM.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    fields = T._parse_datatype_string(f"{ENCODED}, text string").fields
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    encoding, decoding = _encoder(pieces, n_best, keep), _decoder(pieces, (*keep, "ids", "score", "nbest"))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda batches: decoding(encoding(batches)), schema)


def apply_edits(ids: list[int], edits: list[dict]) -> list[int]:
    """The segmentation that an entry of ``nbest`` describes."""
    out, at = [], 0
    for edit in sorted(edits, key=lambda e: e["at"]):
        out += ids[at : edit["at"]] + list(edit["ids"])
        at = edit["at"] + edit["drop"]
    return out + ids[at:]
