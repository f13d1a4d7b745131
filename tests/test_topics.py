import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrank.functions import text as tx
from voxrank.operators import clean, density, lexical, naming, sentiment, skew, topics
from voxrank.plans import analyze

STOPS = ["the", "a", "and", "is"]
TEXTS = [
    "the battery dies and the battery drains", "battery life is great", "screen is crisp and bright",
    "the screen colors", "price is great value", "value for the price and price", "a the", "battery screen price",
]


def spaced(spark, texts=TEXTS, groups=3):
    rows = [(i, f"R{i + 1:06d}", i % groups, f"g{i % groups}", t, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_no long, review_id string, topic_id int, topic string, review_text string, topic_text string")


def tfidf(texts, tokenise):
    docs = [Counter(tokenise(t)) for t in texts]
    df = Counter(t for d in docs for t in d)
    out = []
    for d in docs:
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items()}
        n = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / n for t, v in w.items()})
    return out


def words_and_pairs(text):
    kept = [w for w in re.findall(r"(?u)\b\w\w+\b", text.lower()) if w not in STOPS]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]


def test_weights_keywords_and_representatives(spark):
    frame = spaced(spark)
    features = lexical.lexical_features(frame, STOPS)
    expected = tfidf(TEXTS, words_and_pairs)
    got = defaultdict(dict)
    for r in features.entries().collect():
        got[r.row_no][r.term] = r.weight
    for i, weights in enumerate(expected):
        assert got[i] == pytest.approx(weights)
    assert features.method == "words"
    sums = defaultdict(Counter)
    for i, weights in enumerate(expected):
        for t, w in weights.items():
            sums[i % 3][t] += w
    for row in lexical.topic_keywords(features).collect():
        best = sorted(sums[row.topic_id], key=lambda t: (-round(sums[row.topic_id][t], 9), t))[:8]
        assert row.keywords == best
        assert row.label == " / ".join(t.title() for t in best[:3])
    for row in lexical.lexical_representatives(features).collect():
        centre = sums[row.topic_id]
        length = math.sqrt(sum(v * v for v in centre.values()))
        assert row.similarity == pytest.approx(sum(v * centre[t] for t, v in expected[row.row_no].items()) / length)


@pytest.mark.parametrize("most", [0, 2, 5, 100])
def test_cohesion_with_few_words_as_numbers(spark, most):
    """Words beyond the numbered ones are pairs; the result is the same, and no list of terms is sorted in the JVM."""
    texts = [*TEXTS, "", "ab ab 漢字", "unique"]
    rows = spaced(spark, texts).withColumn("topic_id", F.when(F.col("row_no") != 9, F.col("topic_id")))
    weights = tfidf(texts, lambda t: re.findall(r"(?u)\b\w+\b", t.lower()) or ["\0"])  # no words, no length: one that is not counted
    sums, sizes = defaultdict(Counter), Counter()
    for i, row in enumerate(weights):
        topic = None if i == 9 else i % 3
        sizes[topic] += 1
        for term, weight in row.items():
            if term != "\0":
                sums[topic][term] += weight
    got = {r.topic_id: r for r in lexical.lexical_cohesion(rows, most=most).collect()}
    assert set(got) == set(sizes)
    for topic in (0, 1, 2):
        length = math.sqrt(sum(v * v for v in sums[topic].values()))
        assert got[topic].lexical_cohesion == pytest.approx(length / sizes[topic])


def test_joined_words_and_lists_count_alike(spark):
    docs = spark.createDataFrame([(["aa", "bb", "aa"],), ([],), (None,), (["bb"],), (["cc", "aa", "bb"],)], "words array<string>").coalesce(1)
    joined = docs.select(F.array_join("words", " ").alias("words"))
    for size in (2, 100):
        assert sorted(lexical.word_vocabulary(joined, size).collect()) == sorted(lexical.word_vocabulary(docs, size).collect())
    assert sorted(lexical.word_counts(joined).collect()) == sorted(lexical.word_counts(docs).collect())


def test_uncut_weights_meet_their_number_in_one_pass(spark):
    """Weights carry their term's number; row numbers may repeat or be null, texts may be null or without words."""
    texts = [*TEXTS, TEXTS[1], None, "", "aa", "aab a_a", "漢字 aa 漢字"]
    numbers = [*range(len(TEXTS)), 1, 1, 99, None, None, 7]
    rows = spark.createDataFrame(list(zip(numbers, texts)), "row_no long, topic_text string").repartition(5)
    entries, terms = lexical.uncut_weights(rows, STOPS)
    counts = Counter(t for text in texts for t in set(words_and_pairs(text or "")))
    known = sorted(counts, key=str.encode)
    assert sorted((r["index"], r.term, r.doc_freq) for r in terms.collect()) == [(i, t, counts[t]) for i, t in enumerate(known)]
    n, wanted = len(texts), Counter()
    for number, text in zip(numbers, texts):
        tf = Counter(words_and_pairs(text or ""))
        weights = {t: c * (math.log((1 + n) / (1 + counts[t])) + 1) for t, c in tf.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        wanted.update((str(number), t, known.index(t), round(w / length, 9)) for t, w in weights.items())
    assert Counter((str(r.row_no), r.term, r["index"], round(r.weight, 9)) for r in entries.collect()) == wanted


def test_vocabulary_limit_prefers_frequent_then_alphabetical(spark):
    docs = spark.createDataFrame([(["b", "a", "b"],), (["c", "a"],), ([],)], "terms array<string>")
    rows = lexical.vocabulary(docs, 2).collect()
    assert [(r.term, r.total, r.doc_freq) for r in rows] == [("a", 2, 2), ("b", 2, 1)]
    assert rows[1].idf == pytest.approx(math.log(4 / 2) + 1)


def test_characters_when_no_word_remains(spark):
    features = lexical.lexical_features(spaced(spark, ["a", "the"]), STOPS)
    assert features.method == "characters" and "th" in features.terms


def test_cohesion_equals_the_mean_cosine(spark):
    frame = spaced(spark)
    rows = tfidf(TEXTS, lambda t: re.findall(r"(?u)\b\w+\b", t.lower()))
    found = {r.topic_id: r for r in lexical.lexical_cohesion(frame).collect()}
    for topic in range(3):
        mine = [rows[i] for i in range(len(TEXTS)) if i % 3 == topic]
        centre = Counter()
        for r in mine:
            for t, w in r.items():
                centre[t] += w / len(mine)
        length = math.sqrt(sum(v * v for v in centre.values()))
        cosines = [sum(w * centre[t] for t, w in r.items()) / length for r in mine]
        assert found[topic].lexical_cohesion == pytest.approx(float(np.mean(cosines)))
    single = lexical.lexical_cohesion(spaced(spark, ["one two"], 1)).first()
    assert single.singleton and single.lexical_cohesion == pytest.approx(1)


def test_join_by_frequency_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    for heavy in (1, 4, 1000):
        joined = skew.join_by_frequency(rows, lookup, ["k"], "n", heavy)
        assert joined.count() == 1000 and joined.where("v <> k * 10").isEmpty()


def test_lexicon_names(spark):
    frame = spaced(spark).withColumn("topic_id", F.when(F.col("row_no") == 6, -1).otherwise(F.col("topic_id")))
    lexicon = {"Power": ["battery", "drain"], "Screen": ["screen", "crisp"], "Money": ["price", "value"]}
    names = {r.topic_id: r.name for r in naming.lexicon_names(frame, lexicon).collect()}
    expected = {}
    for t in range(3):
        corpus = " ".join(x for i, x in enumerate(TEXTS) if i % 3 == t and i != 6)
        counts = {k: sum(corpus.count(w) for w in v) for k, v in lexicon.items()}
        expected[t] = max(counts, key=counts.get)
    assert names == expected | {-1: "Unassigned / mixed"}
    assert naming.lexicon_names(spaced(spark, ["zzz"], 1), lexicon).first().name == "Other / mixed"


def test_proposed_labels(spark):
    old = spark.createDataFrame([(-1, "Unassigned / mixed"), (0, "A"), (1, "B")], "topic_id int, label string")
    contents = {
        1: ('{"0":"Battery","1":"Screen"}', True), 2: ('{"0":"Battery"}', False), 3: ('{"0":"Battery","1":"Screen","-1":"x"}', False),
        4: ('{"0":"Battery","1":" "}', False), 5: ('{"0":"Battery","1":5}', False), 6: ('{"0":"Battery","1":"two\\nlines"}', False),
        7: ("not json", False), 10: ("{}", False), 11: ('{"0":"Battery","2":"Screen"}', False), 8: ('{"0":"Battery","1":"' + "x" * 81 + '"}', False), 9: ('{"1":"' + "x" * 80 + '","0":"B"}', True),
    }
    proposals = spark.createDataFrame([(k, v[0]) for k, v in contents.items()], "proposal_id int, content string")
    checked = naming.check_proposed_labels(proposals, old)
    assert {r.proposal_id: r.accepted for r in checked.proposals.collect()} == {k: v[1] for k, v in contents.items()}
    labels = checked.accepted_labels.collect()
    assert {r.topic_id: r.label for r in labels if r.proposal_id == 1} == {0: "Battery", 1: "Screen"}
    assert {r.proposal_id for r in labels} == {1, 9}
    for proposal, names in ((1, {-1: "Unassigned / mixed", 0: "Battery", 1: "Screen"}), (5, {-1: "Unassigned / mixed", 0: "A", 1: "B"})):
        renamed = naming.rename_topics(old, proposals.where(F.col("proposal_id") == proposal))
        assert {r.topic_id: r.label for r in renamed.collect()} == names


def test_every_topic_stands_under_every_proposal(spark):
    old = spark.createDataFrame([(-1, "Unassigned / mixed"), (0, "A"), (1, "B")], "topic_id int, label string")
    proposals = spark.createDataFrame([(1, '{"0":"Battery","1":"Screen"}'), (2, "not json")], "proposal_id int, content string")
    rows = naming.labels_under(naming.check_proposed_labels(proposals, old), old).collect()
    assert sorted((r.proposal_id, r.accepted, r.topic_id, r.label, r.old_label) for r in rows) == [
        (1, True, -1, "Unassigned / mixed", "Unassigned / mixed"), (1, True, 0, "Battery", "A"), (1, True, 1, "Screen", "B"),
        (2, False, -1, "Unassigned / mixed", "Unassigned / mixed"), (2, False, 0, "A", "A"), (2, False, 1, "B", "B")]


@pytest.mark.parametrize("texts", [["ok"], ["a", "the"], ["great", "bad", "fine"]])
def test_tiny_uploads(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_no long, text string")
    result = analyze.analyze(frame, "offline", restarts=1)
    assert {r.sentiment_label for r in result.reviews.collect()} == {"Unknown"}
    assert not result.trend_meta.first().available
    assert all(0 <= r.impact_score <= 10 for r in result.scores.collect())
    assert result.summary.first().method.startswith("Deterministic")


def test_no_text_is_an_error(spark):
    frame = spark.createDataFrame([(0, None), (1, " ")], "row_no long, text string")
    with pytest.raises(ValueError, match="No valid reviews"):
        analyze.analyze(frame, "offline")


def embedded(spark, vectors):
    rows = [(i, f"R{i + 1:06d}", f"review number {i % 9} about thing{i % 4}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "row_no long, review_id string, review_text string, v array<double>")


def test_embedding_kmeans_makes_five_topics(spark):
    vectors = np.random.default_rng(42).normal(size=(20, 6))
    found = topics.discover_topics(embedded(spark, vectors), "kmeans", embedding="v", restarts=2)
    assert found.method == "Embeddings + KMeans" and found.topics.count() == 5
    for row in found.topics.collect():
        assert 1 <= len(row.representative_ids) <= 3 and len(row.keywords) <= 8


def test_missing_model_degrades_visibly(spark):
    found = topics.discover_topics(embedded(spark, np.eye(20, 6)).drop("v"), "auto", restarts=1)
    assert "TF-IDF" in found.method and "Semantic model unavailable" in found.warnings[0]

    def load():
        raise OSError("no weights")

    found = topics.discover_topics(embedded(spark, np.eye(20, 6)).drop("v"), "kmeans", load, restarts=1)
    assert "lexical TF-IDF" in found.warnings[0]


def test_model_embeddings_have_unit_length(spark):
    def load():
        return lambda texts: np.array([[len(t), 3.0, 4.0] for t in texts], dtype="float32")

    rows = topics.embed(spaced(spark), load).collect()
    assert all(sum(x * x for x in r.embedding) == pytest.approx(1, abs=1e-6) for r in rows)


def test_density_topics_through_discovery(spark):
    rng = np.random.default_rng(7)
    centres = np.eye(8)[:3] * 10
    blobs = np.concatenate([c + rng.normal(scale=0.3, size=(60, 8)) for c in centres] + [rng.uniform(-40, -20, size=(4, 8))])
    found = topics.discover_topics(embedded(spark, blobs), "auto", embedding="v", restarts=1)
    assert found.method == "Embeddings + density topics" and not found.warnings
    placed = {r.row_no: r.topic_id for r in found.reviews.collect()}
    groups = [{placed[i] for i in range(b * 60, b * 60 + 60)} - {-1} for b in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and len(placed) == 184
    labels = {r.topic_id: r.label for r in found.topics.collect()}
    assert {r.topic_id: r.topic for r in found.reviews.collect()} == labels


def test_one_blob_falls_back_to_kmeans(spark):
    same = np.tile([[1.0, 0.0, 0.0]], (40, 1))
    found = topics.discover_topics(embedded(spark, same), "auto", embedding="v", restarts=1)
    assert found.method == "Embeddings + KMeans" and "degenerate" in found.warnings[0]


def brute_grid(points, low, width, minimum):
    cells = [tuple(int(math.floor((x - l) / width)) for x, l in zip(p, low)) for p in points]
    count = Counter(cells)
    near = lambda a, b: all(abs(x - y) <= 1 for x, y in zip(a, b))
    dense = {c for c in count if sum(n for d, n in count.items() if near(c, d)) >= minimum}
    component = {}
    for start in sorted(dense):
        if start in component:
            continue
        stack, component[start] = [start], start
        while stack:
            here = stack.pop()
            for d in dense:
                if d not in component and near(here, d):
                    component[d] = start
                    stack.append(d)
    key = lambda c: sum((x + 1) * 4096**i for i, x in enumerate(c))
    for c in count:
        if c not in dense:
            beside = [d for d in dense if near(c, d)]
            if beside:
                component[c] = component[max(beside, key=lambda d: (count[d], -key(d)))]
    return [component.get(c) for c in cells]


@pytest.mark.parametrize("width", [0.5, 1.0])
def test_density_grid_against_brute_force(spark, width):
    rng = np.random.default_rng(11)
    snake = np.array([[0.4 * i, 3 * math.sin(i / 6)] for i in range(80)])
    points = np.concatenate([snake, rng.normal([5, 12], 0.4, size=(60, 2)), rng.uniform([-5, -8], [35, 20], size=(40, 2)), np.tile([[20.0, 15.0]], (50, 1))])
    low, high = points.min(0).tolist(), points.max(0).tolist()
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "row_no long, point array<double>")
    expected = brute_grid(points, low, width, 4)
    sizes = Counter(e for e in expected if e is not None)
    got = {r.row_no: r.topic_id for r in density.topics_at_width(frame.repartition(5), low, high, width, 4).collect()}
    grouped = defaultdict(set)
    for i, e in enumerate(expected):
        outlier = e is None or sizes[e] < 4
        assert (got[i] == -1) == outlier
        if not outlier:
            grouped[e].add(got[i])
    assert all(len(v) == 1 for v in grouped.values())
    numbers = [next(iter(v)) for v in grouped.values()]
    assert sorted(numbers) == list(range(len(numbers)))
    ordered = sorted(grouped, key=lambda e: next(iter(grouped[e])))
    assert [sizes[e] for e in ordered] == sorted(sizes[e] for e in grouped)[::-1]


def test_long_chain_is_one_component(spark):
    nodes = spark.range(200).select(F.col("id").alias("cell"))
    edges = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for most in (0, 1_000):
        assert density.connected_components(nodes, both, most).select("component").distinct().count() == 1


def test_cluster_policy(spark):
    rows = [(n, n) for n in (3, 499, 500, 1999, 2000, 9999, 10000)] + [(600, 2), (4, 0)]
    counted = spark.createDataFrame(rows, "n long, texts long").select("n", topics.cluster_count(F.col("n"), F.col("texts")).alias("k"))
    assert [r.k for r in counted.collect()] == [3, 5, 8, 8, 12, 12, 15, 2, 1]
    assert [density.minimum_topic_size(n) for n in (10, 100, 1000)] == [3, 5, 15]


def test_word_vectors_are_formed_without_putting_pairs_together(spark):
    """Equal to vectors of the joined terms; terms left out by the cut are no pairs either, and empty rows stay."""
    rows = [(0, ["a", "b", "a", "b", "c"]), (1, []), (2, ["c", "a", "x", "b"]), (3, ["b", "a", "b"]), (4, ["x"])]
    listed = spark.createDataFrame(rows, "row_no long, words array<string>").repartition(2)
    for most in (1, 4, 100):
        vocab = lexical.word_vocabulary(listed, most).orderBy("term").collect()
        plain = lexical._vectorise(listed, ["row_no"], tx.with_word_pairs(F.col("words")), vocab, "words")
        found = lexical._vectorise_words(listed, ["row_no"], vocab)
        expected = {r.row_no: r.features for r in plain.vectors.collect()}
        got = {r.row_no: r.features for r in found.vectors.collect()}
        assert set(got) == set(range(5)) and found.terms == plain.terms
        for i, vector in expected.items():
            assert got[i].size == vector.size and got[i].indices.tolist() == vector.indices.tolist()
            assert got[i].values.tolist() == pytest.approx(vector.values.tolist())
