"""op3's latent space is fitted on all passages, and its two ways to multiply agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrank.llm import latent_decontam as ld


def passages(seed, n):
    """Word lists of passages, some features in nearly all of them, and the plain TF-IDF matrix."""
    r = np.random.default_rng(seed)
    chance = 1 / np.arange(3, 503.0)
    known = np.sort(r.choice(ld.FEATURES, 500, replace=False))
    rows = [known[np.unique(r.choice(500, int(k), p=chance / chance.sum()))] for k in r.integers(1, ld.HALF + 1, n)]
    idf = r.random(ld.FEATURES) * 5 + 1
    matrix = np.zeros((n, ld.FEATURES), np.float32)
    for line, row in zip(matrix, rows, strict=True):
        line[row] = idf[row] / np.linalg.norm(idf[row])
    return rows, idf, matrix


@pytest.mark.parametrize("group", [None, 1000, 90])
def test_space_is_that_of_the_whole_matrix(spark, monkeypatch, group):
    """Directly, through one Gram matrix, and through sums of several."""
    rows, idf, matrix = passages(1, 300)
    if group:
        monkeypatch.setattr(ld, "_DIRECT", 0)
        monkeypatch.setattr(ld, "_GROUP", group)
        monkeypatch.setattr(ld, "_PAIRS", 100)
    words = spark.createDataFrame([(x.tolist(),) for x in rows], "words array<int>").repartition(5)
    items = ld.Items([0], [np.array([1 << 50], np.uint64)], [np.array([1 << 50], np.uint64)])
    space = ld.latent_space(words, items, idf, rank=30, count=len(rows))
    item = np.zeros((1, ld.FEATURES), np.float32)
    item[0, 1] = ld.ITEM_WEIGHT
    held = np.concatenate([matrix, item])
    values = np.linalg.svd(held, compute_uv=False)[:30] ** 2
    # whitened singular vectors: the products with the matrix are orthonormal, and the leading ones are there
    turned = held @ space
    assert np.allclose(turned.T @ turned, np.eye(30), atol=1e-3)
    assert np.allclose(np.sort(1 / (space**2).sum(0))[::-1][:10], values[:10], rtol=1e-2)


def test_every_passage_of_every_text_takes_part_in_the_fit(spark, monkeypatch):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 900, n)) for n in (0, 1, 31, 32, 33, 64, 500, *[4000] * 6)]
    docs = spark.createDataFrame(list(enumerate([None, *texts, texts[-1]])), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, texts[5])], "item_id long, text string")
    seen, fit = [], ld.latent_space

    def noted(given, *rest, **named):
        packed = given if "sizes" in given.columns else given.mapInArrow(ld._pack_words, ld._PACKED)
        seen.append(packed.agg(F.sum(F.length("sizes") / 2), F.sum(F.length("features") / 2)).first())
        return fit(given, *rest, **named)

    monkeypatch.setattr(ld, "latent_space", noted)
    found = ld.scan(docs, bench, sample=20).where("contaminated").count()
    assert ld.keep_clean(docs, bench).count() == docs.count() - 1  # the pipeline's stage
    pieces = [set(w[a : a + ld.HALF]) for t in [*texts, texts[-1]] if t for w in [t.split(" ")] for a in range(0, len(w), ld.HALF)]
    assert found == 1 and seen[0] == seen[1] and seen[0][0] == len(pieces) > 800
    assert abs(seen[0][1] - sum(map(len, pieces))) <= 0.05 * seen[0][1]  # features of different words may agree
