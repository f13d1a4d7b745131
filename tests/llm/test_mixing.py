"""Source mixing, source audit and hard negatives against plain versions, and awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxrank.llm import hard_negatives, source_audit, source_mixing
from voxrank.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0d]+")
CLASHES = ("key", "size", "n", "rate", "copies", "target", "hash", "bucket", "rows", "row", "term", "slot", "shard", "number", "part", "rank", "block", "vec", "norm2", "parts")


def clash(table):
    for name in CLASHES:
        table = table.withColumn(name, F.lit(1)) if name not in table.columns else table
    return table


# source mixing

def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        free = budget * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        target = {s: float(most * sizes[s]) for s in stopped} | {
            s: free * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def mixed(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    return by_source


@pytest.fixture(scope="module")
def crowd():
    """Four hundred documents: a third one text, a null source, sources of very uneven size, nulls and empties."""
    r = random.Random(3)
    rows = [(i, "one hot text of seven words here", "en", "hot", 0) for i in range(130)]
    for i in range(130, 400):
        source = r.choice(["a", "b", "", "Ä", None, "hot", "hot"])
        words = r.choice([0, 1, 5, 40, 300, r.randint(1, 900)])
        rows.append((i, " ".join(["w"] * words) if words else r.choice([None, "", " \n"]), "en", source, 0))
    return rows + [rows[200], rows[201], (None, "no id at all", "en", "a", 0), (9999, "x " * 30_000, "en", "hot", 0)]


def test_mix_targets_rates_and_copies(spark, documents, crowd):
    docs = clash(documents(crowd))
    out = source_mixing.balance(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left")
    rows = [r for r in out.collect() if r.doc_id is not None]
    assert source_mixing.balance(docs).count() == len(crowd)
    sizes = Counter()
    for row in crowd:
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    target = plain_targets(sizes)
    text_of = {row[0]: row[1] or "" for row in crowd}
    taken = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(text_of[r.doc_id])) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for source, want in target.items():
        assert abs(taken[source] - want) <= 0.01 * want + 5, (source, taken[source], want)
        # the rates are one exponential tilt of the sizes, cut at two, and meet the target
        mine = [r for r in rows if r.source == source]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(want, rel=0.01)
        tilts = [math.log(r.rate) / r.size for r in mine if r.size and 1e-300 < r.rate < 2]
        if tilts:
            assert max(tilts) == pytest.approx(min(tilts), rel=1e-6, abs=1e-12)
    again = source_mixing.balance(docs.repartition(7)).join(docs.select("doc_id", "source").distinct(), "doc_id", "left")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_mix_is_the_nearest_to_one_copy_each(spark, documents, crowd):
    """No other rates that meet the target have a smaller divergence: moving words between two documents costs."""
    docs = documents(crowd)
    rows = source_mixing.balance(docs).join(docs.select("doc_id", "source"), "doc_id").where("source = 'hot' and size > 0").collect()
    cost = lambda x: x * math.log(x) - x + 1
    r = random.Random(1)
    for _ in range(300):
        a, b = r.sample(rows, 2)
        step = 0.001
        up, down = a.rate + step / a.size, b.rate - step / b.size
        if up <= 2 and 1e-6 < down and a.rate > 1e-6:
            assert cost(up) + cost(down) >= cost(a.rate) + cost(b.rate) - 1e-9


def test_mix_takes_the_rows(spark, documents, crowd):
    docs = documents([r for r in {r[0]: r for r in crowd if r[0] is not None}.values()])
    balanced = source_mixing.balance(docs).cache()
    counts = {r.doc_id: r.n for r in source_mixing.take(docs, balanced).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {r.doc_id: r.copies for r in balanced.collect() if r.copies}


def test_mix_without_rows_or_words(spark, documents):
    assert source_mixing.balance(documents([(1, "a")]).limit(0)).count() == 0
    rows = source_mixing.balance(documents([(1, None), (2, ""), (2, "")])).collect()
    assert len(rows) == 3 and all(r.size == r.taken == r.target == 0 for r in rows)


# source audit

def words_array(words):
    return pa.array(words, pa.binary())


def test_perfect_hash_finds_its_terms_only():
    r = random.Random(2)
    words = [w.encode() for w in dict.fromkeys("".join(r.choices("abcdefgé", k=r.randint(1, 12))) for _ in range(6_000))]
    known, others = words[:4_000], words[4_000:]
    built = source_audit.PerfectHash.from_bytes(source_audit.PerfectHash.build(words_array(known)).to_bytes())
    slots = built.find(words_array(known), source_audit.word_hashes(words_array(known)))
    assert sorted(slots) == list(range(len(known)))
    stored = [built.data[a:b].tobytes() for a, b in zip(built.offsets[:-1], built.offsets[1:], strict=True)]
    assert [stored[s] for s in slots] == known
    assert (built.find(words_array(others), source_audit.word_hashes(words_array(others))) == -1).all()
    empty = source_audit.PerfectHash.build(words_array([]))
    assert list(empty.find(words_array([b"a"]), source_audit.word_hashes(words_array([b"a"])))) == [-1]


def test_perfect_hash_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(source_audit, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    known, others = words_array([b"a", b"b", b"cc"]), words_array([b"b", b"x", b"cc", b"a"])
    built = source_audit.PerfectHash.build(known)
    found = built.find(others, source_audit.word_hashes(others))
    assert found[1] == -1 and sorted(found[[0, 2, 3]]) == [0, 1, 2]


def test_terms_of_bytes():
    texts = ["Ab a1b É-é", "", "z", "　x\x00y Ω"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = source_audit.terms_of(data, offsets)
    pairs = [(int(r), found.words[int(t)].as_py().decode()) for r, t in zip(found.row, found.term, strict=True)]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = [(i, w.translate(fold)) for i, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    assert pairs == expected
    assert tb.tokens(data, offsets)[0].size


def plain_audit(rows, least, most_terms):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())) for _, text, lang, source, _ in rows]
    seen = Counter((lang, w) for lang, _, words in docs for w in set(words))
    kept = {k for k, n in seen.items() if n >= least}
    counts = Counter((lang, source, w) for lang, source, words in docs for w in words if (lang, w) in kept)
    out = []
    for lang in {d[0] for d in docs}:
        terms = [w for k, w in kept if k == lang]
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=lambda s: s.encode())
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(terms))
        total = {s: sum(counts[lang, s, w] for w in terms) for s in sources}
        p = {(s, w): share(counts[lang, s, w], total[s]) for s in sources for w in terms}
        q = {w: share(sum(counts[lang, s, w] for s in sources), sum(total.values())) for w in terms}
        for s in sources:
            pairs = [(o, sum(abs(p[s, w] - p[o, w]) for w in terms)) for o in sources if o != s]
            more = [(w, p[s, w] - q[w]) for w in terms if counts[lang, s, w] and p[s, w] > q[w]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= most_terms]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "Mi", "né") for b in ("t", "run", "sa", "x", "zz")]
    rows = []
    for i in range(240):
        lang = r.choice(["en", "en", "de", None])
        source = r.choice(["s1", "s2", "s3", None, "Ä"]) if i % 3 else "hot"
        picks = r.choices(words, weights=range(1, 21), k=r.randint(0, 30))
        rows.append((i, " ".join(picks) + r.choice(["", " 12", ".", "\n-"]), lang, source, 0))
    rows += [(900, None, "en", "s1", 0), (901, "", "fr", "alone", 0), (902, "!", "fr", "other", 0), (903, "rare " * 5000, "en", "s1", 0)]
    return rows + [rows[5], rows[5]]


@pytest.mark.parametrize("limits", [{}, {"shard_terms": 2, "tile": 2, "round_bytes": 1, "most_cells": 1}])
def test_audit_against_plain_counts(spark, documents, sourced, limits):
    out = source_audit.audit(clash(documents(sourced)).repartition(3), least=9, most_terms=6, **limits)
    assert sorted(map(tuple, out.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(sourced, 9, 6)


def test_audit_without_rows(spark, documents):
    assert source_audit.audit(documents([(1, "a")]).limit(0)).count() == 0
    one = source_audit.audit(documents([(1, None, "en", "a", 0), (2, "b", "en", None, 0)])).collect()
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in one) == [("", "a", 0, 1), ("a", "", 0, 1)]


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 7, 9_000_000_000_000]), 9_000_000_000_123
    assert source_audit.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


# hard negatives

VECTORS = "vec_id long, label int, embedding array<float>"


def plain_negatives(rows, every):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        usable.setdefault(i, []).append((label, np.array(whole, "<i4").tobytes(), whole))
    usable = {i: min(options) for i, options in usable.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, _, v) in usable.items():
        if a % every:
            continue
        others = sorted(((-dot(v, w), b, m) for b, (m, _, w) in usable.items() if b != a))
        for score, b, _ in [o for o in others if o[2] == label][:5]:
            fits = [(-s, c) for s, c, m in others if m != label and 30 * -score <= 100 * -s <= 90 * -score][:10]
            out += [(a, b, i, c, -score, s) for i, (s, c) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 40.0, 60_000.0])
def test_negatives_against_all_pairs(spark, scale):
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(9)] for _ in range(5)]
    rows = []
    for i in range(700):
        if i % 3 == 0:
            v = base[0]  # a third of all rows are one vector
        else:
            v = [x + r.gauss(0, 0.7) for x in base[i % 5]]
        rows.append((i, i % 4, [float(np.float32(scale * x)) for x in v]))
    rows += [
        (1000, None, base[0]), (1010, 1, None), (1020, 1, [None] * 9), (1030, 1, [float("nan")] * 9), (1040, 1, [float("inf")] * 9),
        (1050, 1, [0.0] * 9), (1060, 1, [1.0, 2.0]), (1070, 2, []), (None, 1, base[1]), rows[10], (20, 3, base[2]), rows[13],
    ]
    table = clash(spark.createDataFrame(rows, VECTORS)).repartition(3)
    miner = hard_negatives.Miner(hard_negatives.whole_vectors(table), codes=4, part_rows=150, block_anchors=20)
    assert miner.parts > 3
    found = sorted(tuple(x) for x in miner.mine(every=10).collect())
    assert found == plain_negatives(rows, 10)


def test_cells_come_by_falling_bound_and_hold_their_bound():
    r = np.random.default_rng(1)
    rows = r.integers(-300, 300, (400, 6)).astype("<i4")
    words = tuple(hard_negatives.fit_codes(rows[:, h].astype(float), 5) for h in (slice(0, 3), slice(3, 6)))
    index = hard_negatives.MultiIndex(np.arange(400), np.zeros(400, int), rows, words, np.float64)
    anchor = r.integers(-300, 300, 6)
    cells = list(index.cells(anchor))
    assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
    assert sorted(i for _, _, a, b in cells for i in range(a, b)) == list(range(400))
    for most, least, a, b in cells:
        scores = index.rows[a:b] @ anchor
        assert least <= scores.min() and scores.max() <= most


def test_walk_stops_early_on_clear_clusters():
    r = np.random.default_rng(2)
    rows = np.concatenate([r.normal(c, 3, (3_000, 8)) for c in (-400, 0, 400)]).astype("<i4")
    words = tuple(hard_negatives.fit_codes(rows[:, h].astype(float), 8) for h in (slice(0, 4), slice(4, 8)))
    index = hard_negatives.MultiIndex(np.arange(len(rows)), np.zeros(len(rows), int), rows, words, np.float64)
    best = hard_negatives.Window_(-np.inf, np.inf, 5)
    seen = []
    taken = best.take
    best.take = lambda scores, ids: (seen.append(len(ids)), taken(scores, ids))
    index.walk(rows[-1], 0, True, [best])
    scores = rows.astype(int) @ rows[-1].astype(int)
    assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:5] and sum(seen) < len(rows) / 2


def test_negatives_without_rows_and_too_large(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.Miner(hard_negatives.whole_vectors(none)).mine().count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.Miner(hard_negatives.whole_vectors(spark.createDataFrame([(1, 1, [1e30])], VECTORS)))
