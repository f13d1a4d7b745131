"""Operators against plain-Python versions, and nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import itertools
import math
import random
import re
import time
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxrank.llm import (
    chat_format, chosen_path, importance_sampling, kd_shards, latent_decontam, line_suffixes, piece_lattice,
    quality_rules, string_kernel, token_rollup,
)
from voxrank.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SYLLABLES = ["an", "the", "or", "ti", "on", "sh", "re", "nd", "é", "ü", "Ou", "x"]


def sentence(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def awkward():
    """Rows that every operator must bear: nulls, empties, blanks, one word, a long text, repeats, equal texts."""
    r = random.Random(5)
    long = "\n".join(sentence(r, 12) for _ in range(400))
    text = sentence(r, 80)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (6, text), (6, text), (7, text), (None, text),
        (8, "x" * 5000), (9, "a▁b  c\r\n　é  "), (10, "é" * 60 + " \U0001f600"),
    ]


# textbytes

def test_words_and_hashes():
    texts = [b"", b" a b", "é à\tb".encode(), b"\n", b"a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, bounds = tb.tokens(data, offsets)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [
        [w.encode() for w in WORD.findall(t.decode())] for t in texts]
    hashes = dict(zip(found, tb.token_hashes(data, starts, ends).tolist(), strict=True))
    assert len(set(hashes.values())) == len(set(found))
    assert tb.lower(np.frombuffer("ÀÉ×Zé".encode(), np.uint8)).tobytes().decode() == "àé×zé"


# op 1

def test_toxicity_finds_altered_insults(spark, documents):
    r = random.Random(1)
    insults = ["numbskull", "dimwit", "scoundrel"]
    rows, labels = [], []
    for i in range(600):
        words = sentence(r, 30).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(30), r.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1001, "the an numb-skull on"), (1002, "d i m w i t the on"), (1003, "the dimxwit re"), (1004, "scou.ndrel or"),
             (1005, "the on re"), (1006, None), (1007, ""), (None, "the on")]
    labels = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(rows, clash=True)
    got = {row.doc_id: row for row in string_kernel.score(docs, string_kernel.train(docs, labels)).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    right = sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.97
    assert all(got[i].predicted == 1 for i in (1001, 1002, 1003, 1004))
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (1005, 1006, 1007, None))


def test_toxicity_without_labels(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(awkward())
    assert string_kernel.train(docs, empty) is None
    assert {r.score for r in string_kernel.score(docs, None).collect()} == {0.0}
    assert string_kernel.score(documents([]), None).count() == 0


def test_string_kernel_is_the_sum_over_subsequences():
    def features(unit):
        out = defaultdict(float)
        for i, j, k in itertools.combinations(range(len(unit)), 3):
            if k - i < string_kernel.SPAN:
                out[unit[i], unit[j], unit[k]] += string_kernel.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(string_kernel.DECAY ** (2 * (k - i + 1)) for i, j, k in itertools.combinations(range(len(unit)), 3)
                             if k - i < string_kernel.SPAN))
        return {c: v / norm for c, v in out.items()}

    units = [bytes([1, 2, 3, 4]), bytes([1, 9, 2, 3, 4]), bytes([5, 5, 5, 5, 5]), bytes([1, 2, 3])]
    got = string_kernel.kernel(units, units)
    for a, x in enumerate(units):
        for b, y in enumerate(units):
            fx, fy = features(x), features(y)
            assert got[a, b] == pytest.approx(sum(v * fy.get(c, 0) for c, v in fx.items()), abs=1e-5)


# op 2

def test_importance_weights_and_draw(spark, documents):
    r = random.Random(2)
    rows = [(1000 + i, sentence(r, 40) if i % 2 else " ".join(r.choices(["###", "BUY", "NOW!!"], k=40))) for i in range(200)] + awkward()
    labels = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = documents(rows, clash=True)
    ratios = importance_sampling.log_ratios(docs, labels)
    got = importance_sampling.resample(docs, labels, share=0.5).collect()
    assert len(got) == len(rows)
    weight = {x.doc_id: x.log_weight for x in got}
    # by hand: buckets of one text
    words = rows[1][1].encode()
    data = np.frombuffer(words, np.uint8)
    bucket, _ = importance_sampling._features(data, np.array([0, len(words)]))
    assert len(bucket) == 2 * 40 - 1 and weight[1001] == pytest.approx(ratios[bucket].sum())
    assert min(weight[1000 + i] for i in range(1, 200, 2)) > max(weight[1000 + i] for i in range(0, 200, 2))
    assert weight[1] == weight[2] == weight[3] == 0
    drawn = sorted((x.gumbel_key for x in got if x.sampled), reverse=True)
    assert len(drawn) == round(0.5 * len(rows)) and drawn[-1] > max(x.gumbel_key for x in got if not x.sampled)
    assert importance_sampling.resample(documents([]), labels).count() == 0


# op 3

def test_decontamination(spark, documents):
    r = random.Random(3)
    items = [(i, sentence(r, 25) + ". " + sentence(r, 8)) for i in range(30)] + [(98, ""), (99, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = [(100 + i, sentence(r, 300)) for i in range(40)]

    def inside(text):
        return sentence(r, 70) + "\n" + text + " " + sentence(r, 90)

    reworded = items[4][1].split()
    for at in (2, 9, 16):
        reworded[at] = "quite"
    reworded.insert(12, "rather")
    rows = clean + [(1, inside(items[1][1])), (2, inside(items[2][1].upper())), (3, items[3][1]), (4, inside(" ".join(reworded))),
                    (5, inside(items[5][1].split(". ")[1])), *[(i, t) for i, t in awkward() if i is None or i > 5 or t in (None, "")]]
    docs = documents(rows, clash=True)
    got = [(x.doc_id, x.contaminated, x["items"]) for x in latent_decontam.scan(docs, benchmark).collect()]
    assert len(got) == len(rows)
    assert {(i, tuple(found)) for i, bad, found in got if bad} == {(1, (1,)), (2, (2,)), (3, (3,)), (4, (4,))}
    assert sorted(map(str, (x.doc_id for x in latent_decontam.keep_clean(docs, benchmark).collect()))) == sorted(
        str(i) for i, bad, _ in got if not bad)
    assert latent_decontam.scan(docs, benchmark.where("false")).where("contaminated").count() == 0
    assert latent_decontam.scan(documents([]), benchmark).count() == 0


def test_latent_space_has_its_rank_and_repeats(spark):
    """200 items of words of their own fill all dimensions."""
    words = [tb.mix(np.arange(40 * k + 1, 40 * k + 31, dtype=np.uint64)) for k in range(200)]
    items = latent_decontam.Items(list(range(200)), words, words)
    sample = spark.createDataFrame([([int(f) for f in latent_decontam._feature(w)],) for w in words[:50]], "words array<int>")
    space = latent_decontam.latent_space(sample, items, np.ones(latent_decontam.FEATURES))
    assert space.shape == (latent_decontam.FEATURES, 192)
    again = latent_decontam.latent_space(sample, items, np.ones(latent_decontam.FEATURES))
    assert (space == again).all()


def test_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(50):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not row else row
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert latent_decontam.lcs(np.array(a), np.array(b)) == row[-1]


# op 4

@pytest.fixture(scope="module")
def pieces():
    return piece_lattice.Pieces()


def all_segmentations(unit, pieces):
    out = []

    def walk(at, score, path):
        if at == len(unit):
            out.append((score, path))
        for to in range(at + 1, len(unit) + 1):
            i = pieces.by_bytes.get(unit[at:to])
            i = int(pieces.byte_ids[unit[at]]) if i is None and to == at + 1 else i
            if i is not None:
                walk(to, score + pieces.score[i], (*path, i))

    walk(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_n_best_against_all_segmentations(pieces):
    for unit in (b" hello", " éa".encode(), b"   ", b"x\xe2\x96\x81y", b"\n", b" thonst"):
        expected = all_segmentations(unit, pieces)
        got = piece_lattice.n_best_unit(unit, pieces, 5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in expected[:5]])
        _, _, score, cost = piece_lattice.best_segments(np.frombuffer(unit, np.uint8)[None], pieces)
        assert score[0] == pytest.approx(expected[0][0])
        assert len(expected) == 1 or cost[0] == pytest.approx(expected[0][0] - expected[1][0])


def test_encoding_round_trip_and_text_n_best(spark, documents, pieces):
    rows = [*awkward(), (20, "to be")]
    docs = documents(rows, clash=True).withColumn("id", F.monotonically_increasing_id())
    encoded = piece_lattice.encode(docs, keep=("id",)).cache()
    back = {r.id: r.text for r in piece_lattice.decode(encoded, keep=("id",)).collect()}
    assert all(back[r.id] == r.text for r in docs.collect())
    for row in encoded.join(docs.select("id", "text"), "id").collect():
        if row.text is None:
            assert row.ids is None and row.nbest is None
            continue
        assert row.score == pytest.approx(sum(pieces.score[row.ids]), abs=1e-4)
        for other in row.nbest:
            ids = piece_lattice.apply_edits(row.ids, [e.asDict() for e in other.edits])
            assert ids != row.ids and b"".join(pieces.bytes[i] for i in ids) == b" " + row.text.encode()
            assert other.score == pytest.approx(sum(pieces.score[ids]), abs=1e-4)
        if row.text == "to be":
            expected = all_segmentations(b" to be", pieces)[:4]
            assert [row.score, *[o.score for o in row.nbest]] == pytest.approx([s for s, _ in expected])
    assert piece_lattice.encode(documents([])).count() == 0


def test_encoding_and_decoding_in_one_worker(spark, documents):
    """``round_trip`` returns what ``decode`` of ``encode`` does, in one step of Python."""
    docs = documents(awkward(), clash=True).withColumn("id", F.monotonically_increasing_id())
    whole = piece_lattice.round_trip(docs, keep=("id",))
    apart = piece_lattice.decode(piece_lattice.encode(docs, keep=("id",)), keep=("id", "ids", "score", "nbest"))
    assert whole.schema == apart.schema and sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert piece_lattice.round_trip(documents([])).count() == 0


# op 5

def plain_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_bounds(spark, documents):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        words = sentence(r, 60)
        rows.append((100 + i, words if good else words.replace(" ", " ### ")))
        labels.append((100 + i, int(good), 0))
    rows += [(i, t) for i, t in awkward() if t is None or len(t) < 9000] + [(20, "a b c a b c\na b c\nx"), (21, "A B " * 60)]
    labels = spark.createDataFrame([*labels, (100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows, clash=True)
    got = quality_rules.judge(docs, labels, risk=0.1).collect()
    keys = defaultdict(list)
    for i, t in rows:
        keys[i].append(plain_measures(t))
    found = defaultdict(list)
    for x in got:
        found[x.doc_id].append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words))
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.base_failed and x.kept)
    assert {k: sorted(v) for k, v in keys.items()} == {k: sorted(v) for k, v in found.items()}
    verdict = {x.doc_id: x.kept for x in got}
    assert all(verdict[100 + i] == (i % 3 > 0) for i in range(900))
    assert quality_rules.keep_good(docs, labels, risk=0.1).count() == sum(x.kept for x in got)
    none = quality_rules.judge(docs, labels.where("false")).collect()
    assert all(x.kept != x.base_failed for x in none)
    assert quality_rules.judge(documents([]), labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 30, 0.1), (3, 30, 0.1), (17, 400, 0.05), (0, 1, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.log_binomial_tail(F.lit(k).cast("long"), F.lit(float(n)), p)).first()[0]
        assert math.exp(got) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_uncertain_cutoffs_reject_nothing(spark, documents):
    rows = [(i, sentence(random.Random(i), 60) + (" ###" * 30 if i < 5 else "")) for i in range(20)]
    labels = spark.createDataFrame([(i, int(i >= 5), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(r.rejected_by == "" for r in quality_rules.judge(documents(rows), labels).collect())  # 15 good texts prove nothing


# op 6

def plain_join(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    linked = [[j for j in range(len(rows)) if j != i and (sets[i] == sets[j] or (
        5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[i] | sets[j]))] for i in range(len(rows))]
    classes = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        classes.append(min(named, default=None))
    return sorted((str(rows[i][0]), str(classes[i]), len(linked[i]), len({sets[j] for j in linked[i]} - {sets[i]})) for i in range(len(rows)))


def near_copies(seed=7, groups=12, size=9):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        words = sentence(r, r.choice([6, 20, 60, 200])).split()
        for k in range(size):
            new = list(words)
            for _ in range(k // 3):
                new[r.randrange(len(new))] = sentence(r, 1)
            rows.append((20_000 + 1000 * g + k, " ".join(new)))
    return rows


def test_join_against_all_pairs(spark, documents):
    rows = near_copies() + awkward()
    got = chosen_path.join(documents(rows, clash=True)).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links, x.n_text_links) for x in got) == plain_join(rows)
    kept = chosen_path.keep_first(documents(rows)).collect()
    assert len(kept) == len({x[1] for x in plain_join(rows)})
    assert chosen_path.join(documents([])).count() == 0


def test_join_with_split_buckets_and_blocks(spark, documents, monkeypatch):
    """Small limits send the same rows through bucket splits, block pairs and windows."""
    rows = near_copies(seed=8, groups=3, size=60)
    monkeypatch.setattr(chosen_path, "_BLOCK_SETS", 7)
    got = chosen_path.join(documents(rows), recall=0.99999).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links, x.n_text_links) for x in got) == plain_join(rows)


def test_split_keeps_near_sets_together():
    r = np.random.default_rng(9)
    base = r.integers(0, 2**16, chosen_path.TOKENS).astype(np.uint16)
    tokens = np.array([np.where(r.random(chosen_path.TOKENS) < 0.95, base, r.integers(0, 2**16, chosen_path.TOKENS)) for _ in range(3000)], np.uint16)
    forest = chosen_path._split(tokens, np.arange(3000), 1, 0, 0.8)
    left, right = np.array(forest).T
    assert (chosen_path._spanning(3000, left, right) == 0).mean() > 0.6  # one path; the runs repeat it
    full = chosen_path._brute(tokens, np.arange(3000))
    assert len(full) == 2999


def test_short_pairs_at_the_threshold_are_found(spark, documents):
    """600 pairs of 5, 10 and 20 windows in all, of which the two texts share 80 %."""
    rows, word = [], itertools.count()
    for k in range(600):
        n = (5, 10, 20)[k % 3]
        words = [f"w{next(word)}" for _ in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 4 * n // 5 + 4]))]
    expected = plain_join(rows)
    assert all(x[2:] == (1, 1) for x in expected)
    got = chosen_path.join(documents(rows)).collect()
    found = {(str(x.doc_id), str(x.class_id), x.n_links, x.n_text_links) for x in got}
    assert len(set(expected) - found) <= 4  # both rows of two pairs


def test_groups_are_never_cut(monkeypatch):
    monkeypatch.setattr(chosen_path, "WINDOW", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array([b] * 90), pa.array(range(90))], names=["bucket", "set_id"]) for b in (1, 2, 2, 2, 3)]
    got = [set(x.column("bucket").to_pylist()) for x in chosen_path.groups(iter(batches), ["bucket"])]
    assert [len([g for g in got if b in g]) for b in (1, 2, 3)] == [1, 1, 1]


def test_hot_buckets_are_dealt_again_and_compared_in_blocks(spark, monkeypatch):
    """600 sets, half of them near copies of the others, agree at all places sampled first and some more."""
    r = np.random.default_rng(3)
    tokens = r.integers(0, 2**16, (600, chosen_path.TOKENS)).astype(np.uint16)
    for k in range(300):
        same = r.random(chosen_path.TOKENS) < 0.9
        tokens[300 + k, same] = tokens[k, same]
    places = chosen_path.sampled_places(0.8, 10, 1)
    tokens[:, list(dict.fromkeys([p for _, p in places] + list(range(chosen_path.TOKENS))))[:30]] = 7
    monkeypatch.setattr(chosen_path, "WINDOW", 40)
    monkeypatch.setattr(chosen_path, "BRUTE", 16)
    sets = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(tokens)], "set_id long, tokens binary")
    assert len(chosen_path.hot_buckets(sets, places, 0.8, 40)) == chosen_path.DEPTH
    edges = [(x.u, x.v) for x in chosen_path.candidates(sets, 0.8, 10).collect()]
    label = chosen_path._spanning(600, *np.array(edges).T)
    alike = [(i, j) for i, j in itertools.combinations(range(600), 2) if (tokens[i] == tokens[j]).sum() >= 0.6 * chosen_path.TOKENS]
    assert len(alike) == 300 and all(label[i] == label[j] for i, j in alike)
    assert len(set(label)) == 300


def test_blocks_meet_every_pair():
    r = np.random.default_rng(4)
    tokens = r.integers(0, 2**16, (200, chosen_path.TOKENS)).astype(np.uint16)
    tokens[100:] = tokens[r.permutation(100)]
    forest = chosen_path._across(tokens, np.arange(100), np.arange(100, 200))
    assert sorted(forest) == sorted((i, 100 + j) for i in range(100) for j in range(100) if (tokens[i] == tokens[100 + j]).all())


# op 7

def test_chats(spark):
    rows = [
        (1, 0, "system", "be <|end|> [INST] &lt; brief"), (1, 1, "user", "a"), (1, 2, "user", "b\n"), (1, 3, "assistant", ""),
        (1, 4, "assistant", "x<|next|>"), (2, 1, "assistant", None), (2, 0, None, "null role"), (3, 5, "user", "tie b"),
        (3, 5, "user", "tie a"), (3, 5, "user", "tie a"), (3, 5, "user", "'a"), (3, 5, "user", "<b"), (3, 5, "[x", "&"), (None, 1, "assistant", "no id"), (4, None, "assistant", "é🙂 &amp;"),
    ]
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, run int, blocks string")
    chats = chat_format.format_chats(table)
    got = {r.conv_id: r for r in chats.select(
        "*", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in turns]
        assert got[conv].loss == "".join(t[3] for t in turns if t[2] == "assistant")
    assert got[1].formatted.count("<|start|>") == 3 and got[1].formatted.count("<|next|>") == 2
    assert chat_format.format_chats(table.where("false")).count() == 0


def test_long_conversations_take_linear_time(spark):
    """Sixteen thousand turns against four thousand, and every offset of the mask."""
    def seconds(n):
        rows = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("é<text> "), F.col("id").cast("string"), F.repeat(F.lit(" word"), 20)).alias("text"))
        begin = time.perf_counter()
        got = chat_format.format_chats(rows).select("formatted", "loss_spans", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                                                    F.size(chat_format.read_turns(F.col("formatted"))).alias("n")).first()
        took = time.perf_counter() - begin
        said = [chat_format_plain(got.formatted[s.start : s.end]) for s in got.loss_spans]
        assert said == [f"é<text> {i}" + " word" * 20 for i in range(n) if i % 3] and got.loss == "".join(said) and got.n == n
        return took

    seconds(50)
    short = seconds(4_000)
    assert seconds(16_000) < 6 * short + 2


def chat_format_plain(text):
    return text.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def test_a_mask_beside_the_texts_fails(spark):
    chats = chat_format.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string"))
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end")))
    with pytest.raises(Exception, match="does not cover"):
        chats.select(chat_format.read_loss(F.col("formatted"), moved)).collect()


# op 8

def plain_shards(rows, shards=24, share=kd_shards.GROUP_SHARE):
    """Which rows may share a unit: groups of equal texts up to the share of a shard, else single rows."""
    total = sum(len((t or "").encode()) + 8 for _, t, *_ in rows)
    size = defaultdict(int)
    for _, t, *_ in rows:
        size[t or ""] += len((t or "").encode()) + 8
    return {t for t, n in size.items() if n <= total * share / shards}


def test_shards(spark, documents):
    r = random.Random(10)
    rows = [(i, sentence(r, r.randint(1, 120)), r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), 0) for i in range(3000)]
    rows += [(5000 + i, "the same " * 20, "en", "a", 0) for i in range(1500)] + [(i, t, "en", "a", 0) for i, t in awkward()]
    got = kd_shards.assign_shards(documents(rows, clash=True)).collect()
    assert len(got) == len(rows) and sorted({x.shard for x in got}) == list(range(24))
    assert sorted((x.size, x.text_crc32) for x in got) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    total = defaultdict(int)
    for x in got:
        total[x.shard] += x.size
    mean = sum(total.values()) / 24
    assert max(total.values()) < 1.3 * mean and min(total.values()) > 0.7 * mean
    crc = {zlib.crc32(t.encode()) for t in plain_shards(rows)}
    places = defaultdict(set)
    for x in got:
        places[x.text_crc32].add(x.shard)
    assert all(len(places[c]) == 1 for c in crc)
    assert {x.text_crc32 for x in got if x.split_group} == {zlib.crc32(("the same " * 20).encode())}
    for shard in range(24):
        assert sorted(x.slot for x in got if x.shard == shard) == list(range(sum(x.shard == shard for x in got)))
    again = kd_shards.assign_shards(documents(rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert kd_shards.assign_shards(documents([])).count() == 0
    assert kd_shards.assign_shards(documents([(1, None)])).count() == 1


def test_written_shards_hold_their_rows(spark, documents, tmp_path):
    r = random.Random(11)
    docs = documents([(i, sentence(r, r.randint(1, 40)), "en", r.choice("ab"), 0) for i in range(300)])
    assigned = kd_shards.assign_shards(docs, shards=5).cache()
    kd_shards.write_shards(docs, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(x.doc_id, x.shard, x.slot, x.text) for x in back.collect()} == {
        (x.doc_id, x.shard, x.slot, x.text) for x in docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id").collect()}
    one = [x.slot for f in sorted((tmp_path / "shards" / "shard=0").glob("*.parquet")) for x in spark.read.parquet(str(f)).collect()]
    assert one == list(range(len(one)))


def test_cuts_stand_at_the_weighted_quantile(spark):
    """The first cut leaves half of the bytes on each side, up to one unit."""
    rows = [(i, "x" * (i % 97 + 1), "en", "s", 0) for i in range(2_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = kd_shards.assign_shards(table, shards=2, group_share=0.0).collect()
    half = sum(x.size for x in got if x.shard == 0)
    assert abs(2 * half - sum(x.size for x in got)) <= 2 * 105


# op 9

def test_rollup(spark, documents, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"{tmp_path}/{uuid.uuid4().hex}")

    def changes(rows):
        return spark.createDataFrame([(*r, "clash") for r in rows], "op string, doc_id long, source string, lang string, text string, tokens string")

    def totals():
        return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}

    assert rollup.totals().count() == 0
    first = changes([("insert", 1, "a", "en", "one two"), ("insert", 2, "a", "en", None), ("insert", 2, "a", "en", None),
                     ("insert", 3, None, None, "three"), ("insert", None, "b", "de", "x y z"), ("delete", 9, "a", "en", None),
                     ("revise", 8, "a", "en", "unknown"), ("noise", 7, "a", "en", "x")])
    assert rollup.apply("b1", first, "byte_bpe_50k")
    count = lambda t: token_rollup.count_tokens(documents([(1, t)]), "byte_bpe_50k").first().tokens
    assert totals() == {("a", "en", "byte_bpe_50k"): (2, count("one two")), (None, None, "byte_bpe_50k"): (1, count("three")),
                        ("b", "de", "byte_bpe_50k"): (1, count("x y z"))}
    second = changes([("delete", 1, None, None, None), ("revise", 3, "c", "fr", "drei vier"), ("insert", None, "b", "de", "y")])
    assert rollup.apply("b2", second, "byte_bpe_multi_50k")
    after = totals()
    assert not rollup.apply("b1", second, "byte_bpe_50k") and not rollup.apply("b2", first, "byte_bpe_50k")
    assert totals() == after and rollup.committed() == ["b1", "b2"]
    assert ("c", "fr", "byte_bpe_multi_50k") in after and after["a", "en", "byte_bpe_50k"] == (1, 0)
    live = rollup.states().groupBy("source", "lang", "version").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    assert {(r.source, r.lang, r.version): (r.n, r.t) for r in live} == after
    # an attempt without a commit file has no effect and is overwritten
    spark.range(1).write.parquet(f"{rollup.folder}/ledger/b3")
    assert totals() == after and rollup.apply("b3", changes([]), "byte_bpe_50k") and totals() == after


# op 10

def plain_dedup(rows, min_words):
    """Every later copy of every run of lines with enough words, by comparing all pairs of places."""
    texts = {}
    for i, t in rows:
        if t is not None:
            texts[i is not None, i or 0, t] = [x for x in t.split("\n") if WORD.search(x)]
    keys = sorted(texts, key=lambda k: k[:2])
    gone = defaultdict(set)
    places = [(d, a) for d in keys for a in range(len(texts[d]))]
    starts = defaultdict(list)
    for n, (d, a) in enumerate(places):
        for e, b in starts[texts[d][a]]:
            size = 0
            while a + size < len(texts[d]) and b + size < len(texts[e]) and texts[d][a + size] == texts[e][b + size]:
                size += 1
            if sum(len(WORD.findall(x)) for x in texts[d][a : a + size]) >= min_words:
                gone[d].update(range(a, a + size))
        starts[texts[d][a]].append((d, a))
    out = []
    for i, t in rows:
        if t is None:
            out.append((str(i), None))
            continue
        at, kept = 0, []
        for line in t.split("\n"):
            if WORD.search(line):
                at += 1
                if at - 1 in gone[i is not None, i or 0, t]:
                    continue
            kept.append(line)
        out.append((str(i), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_against_all_pairs(spark, documents):
    r = random.Random(11)
    pool = [sentence(r, r.choice([1, 4, 9])) for _ in range(14)]
    rows = []
    for i in range(60):
        lines = [r.choice(pool) if r.random() < 0.8 else sentence(r, 5) for _ in range(r.randint(0, 25))]
        if i % 4 == 1:
            lines[2:2] = pool[:8]
        if i % 9 == 2:
            lines += ["", "same here"] * 20
        rows.append((i, "\n".join(lines)))
    rows += [(70, rows[5][1]), (70, rows[5][1]), (None, rows[6][1]), (71, None), (72, ""), (73, "\n \n"), (74, rows[5][1] + "\nend")]
    for words in (12, 50):
        got = line_suffixes.dedup_lines(documents(rows, clash=True), words)
        assert sorted(((str(x.doc_id), x.text) for x in got.collect()), key=str) == plain_dedup(rows, words)
    assert [x.n_chars for x in got.where("doc_id = 74").collect()] == [len(x.text) for x in got.where("doc_id = 74").collect()]
    assert line_suffixes.dedup_lines(documents([])).count() == 0


def test_repeated_passage_of_over_fifty_words_is_cut(documents):
    r = random.Random(12)
    passage = sentence(r, 55)
    rows = [(i, f"{sentence(r, 20)}\n{passage}\n{sentence(r, 20)}") for i in range(5)]
    kept = {x.doc_id: x.text for x in line_suffixes.dedup_lines(documents(rows)).collect()}
    assert kept[0] == rows[0][1] and all(passage not in kept[i] and kept[i].count("\n") == 1 for i in range(1, 5))
