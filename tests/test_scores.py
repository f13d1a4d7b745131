from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrank.operators import evaluate, impact, sentiment, trends
from voxrank.plans import analyze, views

DAY = datetime(2026, 1, 1)


def narrow(spark, rows):
    """rows: (topic_id, days or None, rating or None, text)"""
    frame = spark.createDataFrame(
        [(i, f"R{i + 1:06d}", t, f"Topic {t}", None if d is None else DAY + timedelta(days=d), r, x) for i, (t, d, r, x) in enumerate(rows)],
        "row_no long, review_id string, topic_id int, topic string, date timestamp, rating double, review_text string",
    )
    return analyze.with_flags(sentiment.from_rating(frame))


def test_rating_classes(spark):
    ratings = [5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.0, None]
    rows = narrow(spark, [(0, None, r, "x") for r in ratings]).orderBy("row_no").collect()
    assert [r.sentiment_label for r in rows] == ["Positive", "Positive", "Unknown", "Neutral", "Unknown", "Negative", "Negative", "Unknown"]
    assert [r.sentiment_score for r in rows] == [1.0, 0.5, None, 0.0, None, -0.5, -1.0, None]
    assert rows[2].sentiment_method == "Unavailable" and rows[0].sentiment_method == "Rating proxy"


def test_known_trend(spark):
    frame = narrow(spark, [(0, 0, None, "a"), (0, 0, None, "b"), (0, 31, None, "c"), (1, 31, None, "d")])
    changes, meta = trends.analyze_trends(frame)
    found = {r.topic_id: r for r in changes.collect()}
    assert found[1].change_pp == 50 and found[1].trend == "Emerging" and found[0].trend == "Declining"
    m = meta.first()
    assert m.available and m.low_sample and (m.earlier_n, m.later_n) == (2, 2)
    assert m.split == "2026-01-16T12:00:00+00:00"


def test_midpoint_is_earlier_and_undated_topics_stay(spark):
    frame = narrow(spark, [(0, 0, None, "a"), (0, 1, None, "b"), (0, 2, None, "c"), (1, 2, None, "d"), (2, None, None, "e")])
    changes, meta = trends.analyze_trends(frame)
    found = {r.topic_id: r for r in changes.collect()}
    assert meta.first().earlier_n == 2
    assert (found[2].earlier_share, found[2].later_share, found[2].trend) == (0.0, 0.0, "Stable")
    assert sum(r.change_pp for r in found.values()) == pytest.approx(0)


@pytest.mark.parametrize("days", [[0, 1, 2], [5, 5, 5, 5], [None, None]])
def test_trend_unavailable(spark, days):
    frame = narrow(spark, [(0, d, 5.0, "x") for d in days])
    changes, meta = trends.analyze_trends(frame)
    assert changes.count() == 0 and not meta.first().available
    assert "four dated reviews" in meta.first().reason
    scored = impact.score_topics(frame, changes).first()
    assert scored.trend == "Unavailable" and scored.change_pp is None
    assert scored.available_weight == pytest.approx(0.85)


def test_scores_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        t = int(rng.integers(0, 5)) if i % 3 else 0
        d = None if i % 7 == 0 else int(rng.integers(0, 40)) + (t == 2) * 30
        r = None if i % 4 == 0 or t == 4 else float(rng.integers(1, 6))
        rows.append((t, d, r, "Good price here" if rng.random() < 0.3 else "nothing to say"))
    frame = narrow(spark, rows)
    for parts in (1, 7):
        changes, _, scores = analyze.score(frame.repartition(parts))
        found = scores.orderBy("impact_rank").collect()
        change = {r.topic_id: r.change_pp for r in changes.collect()}
        assert sum(s.share_pct for s in found) == pytest.approx(100)
        for s in found:
            mine = [r for r in rows if r[0] == s.topic_id]
            known = [(r[2] - 3) / 2 for r in mine if r[2] is not None]
            parts_of = {
                "prevalence": (0.35, 10 * len(mine) / len(rows)),
                "intensity": (0.30, 10 * float(np.mean([-min(k, 0) for k in known])) if known else None),
                "relevance": (0.20, 10 * float(np.mean(["price" in r[3] for r in mine]))),
                "growth": (0.15, min(max(change[s.topic_id], 0), 10)),
            }
            usable = [(w, v) for w, v in parts_of.values() if v is not None]
            assert s.impact_score == pytest.approx(sum(w * v for w, v in usable) / sum(w for w, _ in usable))
            assert 0 <= s.impact_score <= 10
            assert s.positive_pct + s.neutral_pct + s.negative_pct + s.unknown_pct == pytest.approx(100)
        assert [s.impact_rank for s in found] == list(range(1, 6))
        assert found[0].impact_score >= found[-1].impact_score
    assert next(s for s in found if s.topic_id == 4).negative_intensity_score is None


def test_ties_go_to_the_lower_topic(spark):
    frame = narrow(spark, [(3, None, 5.0, "a"), (1, None, 5.0, "b"), (2, None, 5.0, "c")])
    assert [r.topic_id for r in analyze.score(frame)[2].orderBy("impact_rank").collect()] == [1, 2, 3]


def test_views(spark):
    frame = narrow(spark, [(0, 0, 1.0, "a"), (0, 0, 5.0, "b"), (0, 31, 1.0, "c"), (1, 31, 2.0, "d")])
    changes, _, scores = analyze.score(frame)
    assert [r.change_text for r in views.fastest_rising(scores).collect()] == ["+50.0 pp"]
    assert views.headline(frame).first().negative_pct == 75
    assert {r.weight for r in views.score_components(scores).collect()} == {"35%", "30%", "20%", "15%"}
    assert views.trend_lines(changes, scores).count() == 4
    shown = views.drill_down(scores, scores.select("topic_id", F.array("topic").alias("keywords"))).collect()
    assert {r.rank_text for r in shown} == {"1 of 2", "2 of 2"}


def stub(rows_to_probabilities):
    def load():
        return rows_to_probabilities
    return load


def test_model_sentiment(spark):
    frame = spark.createDataFrame([(0, "bad", None), (1, "ok", None), (2, "good", 1.0)], "row_no long, review_text string, rating double")

    def predict(texts):
        table = {"bad": [0.7, 0.2, 0.1], "ok": [0.2, 0.6, 0.2], "good": [0.1, 0.2, 0.7]}
        return np.array([table[t] for t in texts])

    felt, meta = sentiment.analyze_sentiment(frame, stub(predict), ["LABEL_0", "LABEL_1", "LABEL_2"])
    rows = felt.orderBy("row_no").collect()
    assert [r.sentiment_label for r in rows] == ["Negative", "Neutral", "Positive"]
    assert [r.sentiment_score for r in rows] == pytest.approx([-0.6, 0.0, 0.6])
    assert meta["method"] == "Text model" and not meta["warnings"]


def test_failed_model_falls_back_for_every_row(spark):
    frame = spark.createDataFrame([(0, "a", 5.0), (1, "b", None)], "row_no long, review_text string, rating double")

    def load():
        raise RuntimeError("offline")

    felt, meta = sentiment.analyze_sentiment(frame, load)
    assert {r.sentiment_method for r in felt.collect()} == {"Rating proxy", "Unavailable"}
    assert "using ratings" in meta["warnings"][0]
    _, meta = sentiment.analyze_sentiment(frame, load, ["good", "bad"])
    assert "ValueError" in meta["warnings"][0]


def test_label_accuracy_without_labels_is_null(spark):
    frame = spark.createDataFrame([("", "", "", "")], "human_topic string, human_sentiment string, topic_correct string, sentiment_correct string")
    row = evaluate.label_accuracy(frame).first()
    assert row.topic_accuracy_pct is None and not row.accuracy_reported and row.rows_with_both_labels == 0


def test_one_to_one_is_enforced(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, y int")
    with pytest.raises(Exception, match="must be unique: a"):
        evaluate.join_one_to_one(left, twice, ["k"]).collect()
    with pytest.raises(Exception, match="must be unique: a"):
        evaluate.join_one_to_one(twice, left, ["k"]).collect()
    assert evaluate.join_one_to_one(left, twice.limit(1), ["k"]).count() == 2


def test_sample_does_not_depend_on_partitions(spark):
    frame = spark.range(500).select(
        F.format_string("R%06d", F.col("id")).alias("review_id"), F.col("id").cast("string").alias("review_text"),
        F.lit("t").alias("topic"), F.lit("Unknown").alias("sentiment_label"),
    )
    one = {r.review_text for r in evaluate.validation_sample(frame.repartition(1)).collect()}
    assert len(one) == 50 and one == {r.review_text for r in evaluate.validation_sample(frame.repartition(9)).collect()}
    assert evaluate.validation_sample(frame.limit(7)).count() == 7
