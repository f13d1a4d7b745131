"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

A text is a bag of units: its words, and runs of single letters read as one word
("i d i o t"). Letters are folded and all other characters dropped, so "i-d.i*ot" has no
gap. The kernel of two units sums, over all three-letter subsequences they share,
``decay`` to the power of the span of each occurrence (spans to ``SPAN`` letters),
over length norms: an inserted or changed letter lengthens a few spans and breaks few
subsequences, so the unit stays near. Units are mapped by the Nyström method on
landmark units, ``K(LL)**-1/2 k(L, unit)``, and a squared-hinge SVM is trained on them.
Its decision function is linear in the subsequences, so the landmarks fold into one
table, and scoring a unit is a sum of table entries. A text scores as its most toxic
unit (the multiple-instance rule: one insult makes a sentence toxic, and a clean
sentence has none), through a logistic curve fitted to labelled texts.

Training uses at most ``sample`` labelled texts, taken by a hash of doc_id; labels belong to texts.
Witness units are those whose toxic share is significant, and those that are the strongest
suspect of at least ``WITNESSED`` toxic texts (the multiple-instance rule again: a toxic text has a
witness), so a language of few labelled texts gets its witnesses however many words the others
have. Units of clean texts are negative. Further rounds add the clean units that the last model scores
highest and the toxic units that it scores lowest, as landmarks too, and as witnesses the units of
toxic texts alone that it scores as toxic.

Defined cases: a null or empty text, or one without letters, scores as the emptiest
unit does (near 0); rows without a doc_id take no part in training; a doc_id with
several labels is toxic if any is; without usable labels of both kinds each score is
0. Repeated rows and further columns change nothing. Very long words are read in
overlapping windows of ``WINDOW`` letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrank.llm import textbytes as tb
from voxrank.session import materialise

#: Bound on the labelled texts used in training, on the units taken at a time, on the first landmarks; rounds.
SAMPLE, MOST_UNITS, LANDMARKS, ROUNDS = 20_000, 6_000, 256, 4
#: Toxic texts whose strongest suspect a unit must be to count as a witness without being significant.
WITNESSED = 3
DECAY, SPAN, WINDOW = 0.6, 7, 24
THRESHOLD = 0.7
_LETTERS = 64


def _symbols() -> np.ndarray:
    """Letter classes of bytes: a-z, look-alike digits and signs, trailing bytes of two-byte letters; 0 is dropped."""
    out = np.zeros(256, np.uint8)
    for k, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        out[c] = k + 1
    for sign, letter in zip(b"013457@$", b"oieastas", strict=True):
        out[sign] = out[letter]
    out[0x80:0xC0] = 27 + (np.arange(0x40) & 31)
    return out


_SYMBOL = _symbols()


def _patterns(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a unit of n letters and their weights over the length norm."""
    triples = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(triples or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / math.sqrt(max(float((weight**2).sum()), 1e-12))


_PATTERNS = [_patterns(n) for n in range(WINDOW + 1)]


def _codes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes of equally long units, and the weight of each place."""
    at, weight = _PATTERNS[letters.shape[1]]
    wide = letters.astype(np.int32)
    return (wide[:, at[:, 0]] * _LETTERS + wide[:, at[:, 1]]) * _LETTERS + wide[:, at[:, 2]], weight


@dataclass
class Units:
    """Different units of a chunk, as letters, and which rows have them."""

    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    unit: np.ndarray  # of each place
    row: np.ndarray  # of each place

    def by_size(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for size in np.unique(self.sizes):
            if size:
                members = np.flatnonzero(self.sizes == size)
                for at in range(0, len(members), 50_000):
                    part = members[at : at + 50_000]
                    yield part, tb.rows_matrix(self.letters, self.starts[part], int(size))


def units_of(data: np.ndarray, offsets: np.ndarray) -> Units:
    folded = tb.lower(data)
    symbols = _SYMBOL[folded]
    starts, ends, bounds = tb.tokens(data, offsets)
    before = np.concatenate([[0], np.cumsum(symbols > 0)])
    letters = symbols[symbols > 0]
    first, size = before[starts], before[ends] - before[starts]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    some = size > 0  # words without letters are no gaps: "i - d - i - o - t"
    first, size, row = first[some], size[some], row[some]
    # runs of at least three single letters, as one unit more
    single = size == 1
    same = single[1:] & single[:-1] & (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    opens = np.flatnonzero(single & ~np.concatenate([[False], same])) if len(row) else np.zeros(0, np.int64)
    closes = np.flatnonzero(single & ~np.concatenate([same, [False]])) if len(row) else opens
    run = closes - opens >= 2
    first = np.concatenate([first, first[opens[run]]])
    size = np.concatenate([size, (closes - opens + 1)[run]])
    row = np.concatenate([row, row[opens[run]]])
    # long words as overlapping windows, the last one at the word's end
    long = np.flatnonzero(size > WINDOW)
    if len(long):
        parts = [(np.append(np.arange(0, size[k] - WINDOW, WINDOW // 2), size[k] - WINDOW) + first[k], row[k]) for k in long]
        keep = size <= WINDOW
        first = np.concatenate([first[keep], *[p for p, _ in parts]])
        row = np.concatenate([row[keep], *[np.full(len(p), r) for p, r in parts]])
        size = np.concatenate([size[keep], np.full(sum(len(p) for p, _ in parts), WINDOW)])
    if not len(first):
        return Units(letters, first, size, np.zeros(0, np.int64), row)
    order = np.argsort(first, kind="stable")  # hashing wants rising places
    first, size, row = first[order], size[order], row[order]
    _, at, unit = np.unique(_hashes(letters, first, size), return_index=True, return_inverse=True)
    return Units(letters, first[at], size[at], unit, row)


def _hashes(letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    for n in np.unique(size):
        here = np.flatnonzero(size == n)
        for at in range(0, len(here), 200_000):
            part = here[at : at + 200_000]
            h = np.full(len(part), np.uint64(n))
            for k in range(int(n)):
                h = h * np.uint64(0x9E3779B97F4A7C15) + letters[first[part] + k]
            out[part] = tb.mix(h)
    return out


@dataclass
class Model:
    """Table of subsequence weights, bias, and the logistic curve of text scores."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def unit_scores(self, units: Units) -> np.ndarray:
        out = np.full(len(units.starts), self.bias, np.float32)
        for part, letters in units.by_size():
            codes, weight = _codes(letters)
            if len(weight):
                out[part] += self.table[codes] @ weight.astype(np.float32)
        return out

    def spelled_scores(self, units: list[bytes]) -> np.ndarray:
        out = np.full(len(units), self.bias)
        for here, letters in _words([u[:WINDOW] for u in units]):  # no unit is longer
            codes, weight = _codes(letters)
            out[here] += self.table[codes] @ weight
        return out

    def text_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        units = units_of(data, offsets)
        best = np.full(len(offsets) - 1, self.bias, np.float32)
        if len(units.unit):
            np.maximum.at(best, units.row, self.unit_scores(units)[units.unit])
        return best.astype(float)

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -500, 500)))


def _words(letters: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(x) for x in letters])
    for size in np.unique(sizes):
        here = np.flatnonzero(sizes == size)
        yield here, np.frombuffer(b"".join(letters[i] for i in here), np.uint8).reshape(len(here), -1)


def kernel(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The string kernel between two lists of units, each a byte string of letter classes."""
    vocabulary = np.zeros(_LETTERS**3, np.int32)
    rows = [(here, *_codes(letters)) for here, letters in _words(right)]
    for _, codes, _ in rows:
        vocabulary[codes.ravel()] = 1
    known = np.flatnonzero(vocabulary)
    vocabulary[known] = np.arange(1, len(known) + 1)
    dense = np.zeros((len(known) + 1, len(right)), np.float32)
    for here, codes, weight in rows:
        np.add.at(dense, (vocabulary[codes], here[:, None]), weight.astype(np.float32))
    dense[0] = 0
    out = np.zeros((len(left), len(right)))
    for here, letters in _words(left):
        for at in range(0, len(here), 200):
            codes, weight = _codes(letters[at : at + 200])
            out[here[at : at + 200]] = np.einsum("bml,m->bl", dense[vocabulary[codes]], weight.astype(np.float32), optimize=True)
    return out


def train_svm(units: list[bytes], toxic: np.ndarray, counts: np.ndarray, landmarks: list[bytes], c: float = 10.0) -> Model:
    """Squared-hinge SVM on Nyström features by Newton's method; a unit weighs as the root of its texts."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    sound = values > 1e-6 * values.max()
    project = vectors[:, sound] / np.sqrt(values[sound])
    x = np.column_stack([kernel(units, landmarks) @ project, np.ones(len(units))])
    y = np.where(toxic, 1.0, -1.0)
    weight = c * np.sqrt(counts)
    u = np.zeros(x.shape[1])
    ridge = np.eye(len(u))
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        slack = 1 - y * (x @ u)
        active = slack > 0
        xa, wa = x[active], weight[active]
        gradient = ridge @ u - 2 * xa.T @ (wa * y[active] * slack[active])
        step = np.linalg.solve(ridge + 2 * (xa.T * wa) @ xa, gradient)
        u -= step
        if np.abs(step).max() < 1e-8:
            break
    beta = project @ u[:-1]
    table = np.zeros(_LETTERS**3)
    for here, letters in _words(landmarks):
        codes, weights = _codes(letters)
        np.add.at(table, codes, beta[here][:, None] * weights)
    return Model(table.astype(np.float32), float(u[-1]))


def fit_curve(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from text scores to labels, lightly damped."""
    x = np.column_stack([scores, np.ones(len(scores))])
    u = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -500, 500)))
        gradient = x.T @ (p - toxic) + 0.05 * u
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(2), gradient)
        u -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(u[0]), float(u[1])


def is_held_out(doc_id: Column) -> Column:
    """Rows that training never sees: CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled ``docs`` outside the held-out third; None without both labels."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    answers = {r.doc_id: r.toxic for r in chosen.collect()}
    if len(set(answers.values())) < 2:
        return None
    labelled = spark.sparkContext.broadcast(answers)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            known = [labelled.value.get(i) for i in batch.column("doc_id").to_pylist()]
            rows = np.flatnonzero([k is not None for k in known])
            some = batch.take(pa.array(rows, pa.int64()))
            at = 0
            for part, data, offsets in tb.chunks(iter([some])):
                marks = np.array([known[r] for r in rows[at : at + part.num_rows]]) > 0
                at += part.num_rows
                yield data, offsets, marks

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, marks in picked(batches):
            units = units_of(data, offsets)
            if not len(units.unit):
                continue
            seen = np.unique(units.unit * np.int64(len(marks)) + units.row)  # each unit once a text
            unit, row = seen // len(marks), seen % len(marks)
            bad = np.bincount(unit, marks[row], len(units.starts)).astype(np.int64)
            n = np.bincount(unit, minlength=len(units.starts))
            spelled = [units.letters[a : a + s].tobytes() for a, s in zip(units.starts, units.sizes, strict=True)]
            yield pa.RecordBatch.from_pydict({"unit": pa.array(spelled, pa.binary()), "n": n, "bad": bad})

    narrow = docs.select("doc_id", "text")
    totals = narrow.mapInArrow(counts, "unit binary, n long, bad long").groupBy("unit").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.length("unit") >= 3)
    totals = materialise(totals, "toxic-units")
    share = sum(1 for v in answers.values() if v > 0) / len(answers)
    n, bad = F.col("n"), F.col("bad")
    # log likelihood ratio of the unit's toxic share against that of all texts
    good = n - bad
    ratio = F.when(bad > 0, bad * F.log(bad / (n * share))).otherwise(0.0) + F.when(
        good > 0, good * F.log(good / (n * (1 - share)))).otherwise(0.0)
    scored = totals.withColumn("ratio", ratio)
    need = math.log(max(2, totals.count())) + 2
    doubtful = bad > n * max(0.6, share)
    suspect = doubtful & (F.col("ratio") > need)
    strongest = scored.where(doubtful & (n > 1)).orderBy(F.desc("ratio"), "unit").limit(MOST_UNITS).collect()
    place = {bytes(r.unit): i for i, r in enumerate(strongest)}  # by falling ratio
    sent_place = spark.sparkContext.broadcast(place)

    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, marks in picked(batches):
            units = units_of(data, offsets)
            if not len(units.unit):
                continue
            none = len(sent_place.value)
            spelled = (units.letters[a : a + s].tobytes() for a, s in zip(units.starts, units.sizes, strict=True))
            rank = np.array([sent_place.value.get(u, none) for u in spelled])
            best = np.full(len(marks), none)
            np.minimum.at(best, units.row, rank[units.unit])
            found = best[marks & (best < none)]
            yield pa.RecordBatch.from_pydict({"place": pa.array(found, pa.int64())})

    chosen_by = narrow.mapInArrow(witnesses, "place long").groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MOST_UNITS
    witnessed = {r.place for r in chosen_by if r.n >= WITNESSED}
    positive = [r for i, r in enumerate(strongest) if r.ratio > need or (i in witnessed and r.ratio > need / 2)]
    if not positive:
        positive = scored.where(bad > n * share).orderBy(F.desc("ratio"), "unit").limit(20).collect()
    clean = scored.where((bad <= n * share) & ~suspect)
    common = clean.orderBy(F.desc("n"), "unit").limit(MOST_UNITS // 2).collect()
    other = clean.orderBy(F.xxhash64("unit"), "unit").limit(MOST_UNITS // 2).collect()
    clean_counts = {bytes(r.unit): r.n for r in [*common, *other]}
    toxic_counts = {bytes(r.unit): r.n for r in positive}
    # the strongest units, and some of every strength
    quarter = LANDMARKS // 4
    marks = [*_spread(list(toxic_counts), quarter), *list(toxic_counts)[:quarter], *_spread(list(clean_counts), 2 * quarter)]
    marks = list(dict.fromkeys(marks))
    for turn in range(ROUNDS):
        counts_of = {**toxic_counts, **clean_counts}
        units = list(counts_of)
        model = train_svm(
            units, np.array([u in toxic_counts for u in units]), np.array(list(counts_of.values()), float), marks)
        if turn == ROUNDS - 1:
            break
        ranked = _rescored(scored, model)
        toxic_only = ranked.where((bad == n) & (n > 1) & (F.col("score") > 0)).orderBy(F.desc("ratio"), "unit")
        seeming = ranked.where((bad <= n * share) & ~suspect).orderBy(F.desc("score"), "unit")
        hard = {bytes(r.unit): r.n for r in seeming.limit(MOST_UNITS // 2).collect()}
        toxic_counts |= {bytes(r.unit): r.n for r in toxic_only.limit(MOST_UNITS // 2).collect()}
        clean_counts |= hard
        known = list(toxic_counts)
        missed = [known[i] for i in np.argsort(model.spelled_scores(known), kind="stable")[: LANDMARKS // 2]]
        marks = list(dict.fromkeys([*marks, *list(hard)[: LANDMARKS // ROUNDS], *missed]))
    sent_model = spark.sparkContext.broadcast(model)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, texts in picked(batches):
            yield pa.RecordBatch.from_pydict({"top": sent_model.value.text_scores(data, offsets), "bad": texts})

    pairs = narrow.mapInArrow(tops, "top double, bad boolean").collect()  # at most a pair for each sampled text
    model.slope, model.shift = fit_curve(np.array([p.top for p in pairs]), np.array([float(p.bad) for p in pairs]))
    return model


def _rescored(units: DataFrame, model: Model) -> DataFrame:
    """``units`` with the score of each under ``model``."""
    sent = units.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(units: pd.Series) -> pd.Series:
        return pd.Series(sent.value.spelled_scores([bytes(u) for u in units]))

    return units.withColumn("score", score_of("unit"))


def _spread(units: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` units at even steps through the list."""
    return [units[i] for i in np.unique(np.linspace(0, len(units) - 1, min(most, len(units))).astype(int))] if units else []


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    held = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    schema = held.drop("text").schema.add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.chunks(batches):
            use = sent.value
            values = np.zeros(rows.num_rows) if use is None else use.probability(use.text_scores(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(values)], names=schema.names)

    return held.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
