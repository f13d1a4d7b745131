"""op3's search: passage vectors against plain sums, and its recall against checking every item on every whole text."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark import cloudpickle

from voxrank.llm import latent_decontam as ld


def scanner(seed=0, rank=64):
    r = np.random.default_rng(seed)
    made = object.__new__(ld.Scanner)
    table = r.standard_normal((ld.FEATURES, rank)).astype(np.float32)
    made.table = np.vstack([table, np.zeros_like(table[:1])])
    return made, r


def plain(table, words, starts):
    """Sums of the different words' lines of each half passage, stretch by stretch."""
    half = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    once = np.unique(half * ld.FEATURES + ld._feature(words))
    first = np.searchsorted(once, np.arange(len(starts)) * ld.FEATURES)
    return np.add.reduceat(table[once % ld.FEATURES], first, axis=0)


def test_passages_are_the_plain_sums_and_quicker():
    made, r = scanner(rank=192)
    words = r.integers(0, 1 << 63, 200_000).astype(np.uint64)
    words[:500] = words[0]  # a half passage of one word
    starts, _ = ld._half_starts(np.array([0, 0, 1, 34, 500, len(words)]))
    row = np.arange(len(starts))  # no half joins the next
    expected = plain(made.table, words, starts)
    expected /= np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-12)
    assert np.allclose(made._passages(words, starts, row), expected, atol=1e-5)

    def seconds(work):
        best = []
        for _ in range(3):
            start = time.process_time()
            work()
            best.append(time.process_time() - start)
        return min(best)

    assert seconds(lambda: made._passages(words, starts, row)) < 0.7 * seconds(lambda: plain(made.table, words, starts))


def test_recall_against_every_item_on_every_text(spark):
    """Reworded items inside texts; the space is fitted on a part of the passages."""
    r = np.random.default_rng(5)
    known = np.array([f"w{i}" for i in range(3000)])
    chance = 1 / np.arange(10, 3010.0)
    chance /= chance.sum()

    def made(n):
        return r.choice(known, n, p=chance)

    items = [made(int(r.integers(25, 60))) for _ in range(40)]
    texts = []
    for i in range(400):
        body = made(300)
        if i % 2:
            item = items[i % 40].copy()
            other = r.random(len(item)) < (i // 40) * 0.03
            item[other] = made(int(other.sum()))
            at = int(r.integers(0, 300))
            body = np.concatenate([body[:at], item, body[at:]])
        texts.append(" ".join(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(row.doc_id, i) for row in ld.scan(docs, bench, sample=500).collect() for i in row["items"]}
    read = ld.read_items(bench)
    true = set()
    for d, text in enumerate(texts):
        raw = text.encode()
        words = ld._words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        true |= {(d, i) for i, w, a in zip(read.ids, read.words, read.answers, strict=True) if ld._overlap(w, a, words)}
    assert len(true) > 150 and len(found & true) >= 0.9 * len(true) and found <= true
    print("recall", len(found & true), len(true))


@pytest.mark.parametrize("rank", [40, 7])
def test_orthonormal_columns_keep_their_span(rank):
    r = np.random.default_rng(2)
    matrix = (r.standard_normal((5000, rank)) * 0.5 ** np.arange(rank)) @ r.standard_normal((rank, 40))
    got = matrix.astype(np.float32)
    ld._orthonormalise(got)
    assert np.allclose(got.T @ got, np.eye(40), atol=1e-5)
    assert np.allclose(got @ (got.T @ matrix), matrix, atol=1e-4 * np.abs(matrix).max())


def test_fit_holds_and_sends_few_copies_of_its_matrices(spark, monkeypatch):
    r = np.random.default_rng(3)
    words = [r.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(250)]
    items = ld.Items(list(range(250)), words, words)
    sample = spark.createDataFrame([([int(f) for f in ld._feature(w)],) for w in words[:50]], "words array<int>")
    plain, sent = type(sample).mapInArrow, []

    def noted(self, function, schema):
        sent.append(len(cloudpickle.dumps(function)))
        return plain(self, function, schema)

    monkeypatch.setattr(type(sample), "mapInArrow", noted)
    tracemalloc.start()
    try:
        space = ld.latent_space(sample, items, np.ones(ld.FEATURES))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert space.dtype == np.float32 and peak < 5 * space.nbytes, peak / space.nbytes
    assert max(sent) < 100_000, sent  # the basis travels as a broadcast, not in the functions too
