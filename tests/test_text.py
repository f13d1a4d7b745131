import re
import textwrap
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions import numbers, text as tx

SAMPLES = [
    " Good! ", "good!", "a b  c\t\nd", "Ｆｕｌｌ ｗｉｄｔｈ", "ﬁne ½ ² ℌ", "Straße", "STRASSE ẞ", "İstanbul ſ K", "été",
    "x\x1cy\x1fz\x85w", "漢字 仮名", "", "   ", "123 !!", "ŉ µ ŀ ĳ", "naïve café", "Ωμέγα ΣΑΣ", "ΟΔΟΣ οδός", "“quoted” – it’s €5… ﬂat ™ ½", "각 각 ﾊﾞ", "e\u0301 \u0323\u0307s", "😀 fine", "\U0002f800", " em line",
]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(3)
    return [r[1] for r in sorted(rows.select("i", expression.alias("o")).collect())]


def python_clean(value):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip()


def normalised(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(3)
    return [(r.t, r.k) for r in sorted(tx.with_normalised(rows, "v", "t", "k").collect(), key=lambda r: r.i)]


def test_normalisation_follows_python(spark):
    for value, (text, key) in zip(SAMPLES, normalised(spark, SAMPLES)):
        assert text == python_clean(value)
        assert key == python_clean(value).casefold()


def test_normalisation_of_arbitrary_text(spark):
    alphabet = st.characters(min_codepoint=1, max_codepoint=0x3100, exclude_categories=["Cs", "Cn", "Co"])
    found = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(st.text(alphabet, max_size=12))
    def gather(value):
        found.append(value)

    gather()
    for value, (text, key) in zip(found, normalised(spark, found)):
        assert text == python_clean(value), ascii(value)
        assert key == python_clean(value).casefold(), ascii(value)


def test_every_character_by_itself(spark):
    """All characters below the table's limit: those the JVM maps follow Python, alone and beside a letter."""
    left = set(tx.character_tables().left)
    alone = [chr(c) for c in range(0x21, 0x20000) if unicodedata.category(chr(c)) not in ("Cs", "Cn") and chr(c) not in left]
    assert len(alone) > 60_000 and all(c not in left for c in "’“”–—€…ﬁＡ가漢字😀ßé")
    chunks = [alone[i : i + 64] for i in range(0, len(alone), 64)]
    texts = ["a".join(chunk) for chunk in chunks] + ["".join(chunk) for chunk in chunks]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").repartition(8)
    assert rows.where(tx.is_special(F.col("v"))).count() < 0.1 * len(texts)  # characters newer than the JVM's table
    for value, (text, key) in zip(texts, normalised(spark, texts), strict=True):
        assert text == python_clean(value), ascii(value)
        assert key == python_clean(value).casefold(), ascii(value)
    assert column(spark, sorted(left), tx.is_special(F.col("v")), "string") == [True] * len(left)


def test_context_sentences(spark):
    original = "Battery lasts all day. I take it on the train. After 12 days of use, this is my experience."
    near = "I use it for video editing because performance is excellent."
    only = "I take it on the train."
    assert column(spark, [original, near, only], tx.topic_text(F.col("v"))) == ["Battery lasts all day", near, only]


def test_words_and_pairs(spark):
    texts = ["The 4k-screen isn't x_y é a bb", "", "one"]
    for shortest, pattern in ((2, r"(?u)\b\w\w+\b"), (1, r"(?u)\b\w+\b")):
        assert column(spark, texts, tx.words(F.col("v"), shortest)) == [re.findall(pattern, t.lower()) for t in texts]
    got = column(spark, texts, tx.with_word_pairs(tx.words(F.col("v"))))
    for value, terms in zip(texts, got):
        tokens = re.findall(r"(?u)\b\w\w+\b", value.lower())
        assert terms == tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def test_words_found_in_bytes(spark):
    """Joined words are those of the regex, for every character and in rows that touch."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(chr(c) + " " * (i % 5 == 0) for i, c in enumerate(points[at : at + 1024])) for at in range(0, len(points), 1024)]
    texts += [None, "", "the", "ab", "cd ef", "é", "éa the 4k-screen isn't x_y", "漢字 仮 ΟΔΟΣ the", " ab", "ab ", "\U00020000b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").coalesce(1)
    for shortest in (1, 2):
        found = tx.with_words(rows, "v", "w", ["the", "ef"], shortest)
        assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
        got = dict(found.select("i", tx.split_words(F.col("w"))).collect())
        assert got == dict(rows.select("i", tx.without(tx.words(F.col("v"), shortest), ["the", "ef"])).collect())
    assert got[len(points) // 1024 + 2] is not None and got[texts.index(None)] is None


def test_character_runs(spark):
    texts = ["Ab  c", "é", ""]
    for value, runs in zip(texts, column(spark, texts, tx.character_runs(F.col("v")))):
        flat = re.sub(r"\s\s+", " ", value.lower())
        expected = [flat[i:i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)]
        assert Counter(runs) == Counter(expected)


def test_term_counts(spark):
    texts = ["b a b c a b", "x", ""]
    got = column(spark, texts, tx.term_counts(tx.words(F.col("v"), 1)))
    for value, counts in zip(texts, got):
        assert {c.term: c.tf for c in counts or []} == dict(Counter(value.split()))


def test_commercial_mentions_are_whole_words(spark):
    texts = ["Great VALUE here", "devalued", "valueé", "worth_it", "It's worth it", "price."]
    expected = [bool(re.search(r"\b(?:" + "|".join(fixed.COMMERCIAL_TERMS) + r")\b", t, re.I)) for t in texts]
    assert column(spark, texts, tx.mentions(F.col("v"))) == expected
    exact = [bool(re.search(r"\b(?:" + "|".join(fixed.COMMERCIAL_TERMS) + r")\b", t)) for t in texts]
    assert column(spark, texts, tx.mentions(F.col("v"), ignore_case=False)) == exact


def test_forbidden_claims(spark):
    texts = ["no claim", "5 stars", "٣", "$", "100%", "Revenue", "market wide", "Market-Wide", "marketwide", "because", "causes", "guaranteed", "guarantees it"]
    expected = [False, True, True, True, True, True, True, True, False, False, True, True, True]
    assert column(spark, texts, tx.makes_forbidden_claim(F.col("v"))) == expected


def test_title_case_and_occurrences(spark):
    texts = ["4k screen", "word's end", "été x_y", "aaaa aa"]
    assert column(spark, texts, tx.title_case(F.col("v"))) == [t.title() for t in texts]
    assert column(spark, texts, tx.occurrences(F.col("v"), "aa")) == [t.count("aa") for t in texts]


@pytest.mark.parametrize("width", [10, 31])
def test_shorten(spark, width):
    texts = ["Battery / Commute Evening / Evening", "short", "  spaced   out  ", "long-term battery-life problems here now", "exactly ten", "Unbreakablyverylongsinglewordwithoutanyspace"]
    assert column(spark, texts, tx.shorten(F.col("v"), width)) == [textwrap.shorten(t, width, placeholder="…") for t in texts]


def test_spreadsheet_safety(spark):
    texts = ["=1+1", "  +x", "-", "@a", "a=b", "", "'=", " =x"]
    expected = ["'" + t if t.lstrip().startswith(("=", "+", "-", "@")) else t for t in texts]
    assert column(spark, texts, tx.spreadsheet_safe(F.col("v"))) == expected


def test_decimals_match_python(spark):
    values = [0.0, 0.125, 2.675, 2.5, 0.05, 0.15, 0.25, 0.35, 99.95, 1e-9, 12.345, 33.333333, 0.375, 7.0 / 3, 100.0, 0.65625, 5.015, 1.005]
    values += [-v for v in values] + [i / 16 for i in range(64)] + [i / 7 for i in range(40)] + [i / 200 for i in range(200)]
    for digits in (1, 2, 4):
        assert column(spark, values, numbers.fixed_decimals(F.col("v"), digits), "double") == [f"{v:.{digits}f}" for v in values]
        assert column(spark, values, numbers.fixed_decimals(F.col("v"), digits, True), "double") == [f"{v:+.{digits}f}" for v in values]
        assert column(spark, values, numbers.round_exact(F.col("v"), digits), "double") == [round(v, digits) for v in values]


def test_counted_vocabularies_are_the_plain_ones(spark, monkeypatch):
    from voxrank.operators import lexical
    from voxrank.session import materialise

    texts = ["Ab ab cd, ab", "cd ef ab cd", "x  y\\n\\tZz ÄÖ\U00020001b", None, "", "ef ef ef ef", "Kelvin K İi", "ab cd ab cd"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_no long, text string").repartition(3)
    monkeypatch.setattr(lexical, "_AT_ONCE", 7)  # many small stretches

    def seen(df):
        return sorted(map(tuple, df.select("term", "total", "doc_freq", F.round("idf", 9)).collect()))

    words = materialise(rows.select(lexical.word_terms(F.col("text"), ["x"], pairs=False).alias("words")), "words")
    plain = words.select(tx.with_word_pairs(F.col("words")).alias("terms"))
    for most in (1, 2, 3, 5, 8, 1000):
        expected = seen(lexical.vocabulary(plain, most))
        assert seen(lexical.word_vocabulary(words, most)) == expected
        monkeypatch.setattr(lexical, "_CANDIDATES", 0)  # nothing may be broadcast
        assert seen(lexical.word_vocabulary(words, most)) == expected
        monkeypatch.undo()
    for most in (3, 1000):
        expected = seen(lexical.vocabulary(rows.select(tx.character_runs(F.col("text")).alias("terms")), most))
        assert seen(lexical.character_vocabulary(rows.select(tx.flat_text(F.col("text")).alias("text")), most)) == expected


def test_texts_are_normalised_in_one_pass_of_python(spark):
    """Tables of thousands of characters, looked up in the JVM for each text, took several times as long."""
    rows = spark.createDataFrame([("Ｆｉｎｅ  Straße",), (None,), ("é ﬁ",)], "v string")
    found = tx.with_normalised(rows, "v", "t", "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "translate(" not in plan
    assert [(r.t, r.k) for r in found.collect()] == [("Fine Straße", "fine strasse"), ("", ""), ("é fi", "é fi")]
