"""Text stays where it is: no exchange of an analysis carries it."""

import pytest
from pyspark.sql import functions as F

from voxrank import session
from voxrank.operators import clean, late
from voxrank.plans import analyze

TEXTS = ["review_text", "topic_text", "text", "value", "record", "_raw", "_plain", "_special"]


def exchanged(plan):
    """(node, column names) of every exchange under a physical plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from exchanged(plan.initialPlan())
    if "Exchange" in name:
        output = plan.output()
        yield name, [output.apply(i).name() for i in range(output.size())]
    children = plan.children()
    for i in range(children.size()):
        yield from exchanged(children.apply(i))


@pytest.fixture
def plans(monkeypatch):
    """The exchanges of everything that is stored."""
    found, store = [], session.store

    def recorded(df, name):
        found.extend(exchanged(df._jdf.queryExecution().executedPlan()))
        return store(df, name)

    monkeypatch.setattr(session, "store", recorded)
    return found


def reviews(spark, n=120):
    rows = [(i, f"Review {'abcdefgh'[i % 8]} about thing{'xyzw'[i % 4]} and price" if i % 3 else "The same words again", str(i % 5 + 1), [float(i % 4), 1.0, float(i % 7)]) for i in range(n)]
    return spark.createDataFrame(rows, "row_no long, text string, rating string, v array<double>")


@pytest.mark.parametrize("mode,embedding", [("offline", None), ("kmeans", "v"), ("auto", "v")])
def test_no_text_in_an_exchange(spark, plans, mode, embedding):
    result = analyze.analyze(reviews(spark), mode, embedding=embedding, restarts=1, smallest_topic=3)
    frames = [result.reviews, result.scores, result.insights, result.topics, result.trends, result.quality]
    for frame in frames:
        plans.extend(exchanged(frame._jdf.queryExecution().executedPlan()))
    assert len(plans) > 10
    assert not [(n, c) for n, c in plans if set(c) & set(TEXTS)]
    if mode == "auto":
        assert result.topic_method in ("Embeddings + density topics", "Embeddings + KMeans")


@pytest.mark.parametrize("most", [1_000_000, 3, 1])
def test_keep_and_values_in_rounds(spark, most):
    rows = late.stored(spark.range(2_000).select("id", F.concat(F.lit("text "), "id").alias("text")).repartition(5), "rows")
    kept = rows.where("id % 3 <> 0").select(late.PLACE)
    assert sorted(r.id for r in late.keep(rows, kept, most).collect()) == [i for i in range(2_000) if i % 3]
    assert late.keep(rows, kept.limit(0), most).count() == 0
    assert late.keep(rows, rows.select(late.PLACE), most).count() == 2_000
    values = rows.where("id % 5 = 2").select(late.PLACE, (F.col("id") * 2).alias("double"))
    found = late.with_value(rows, values, "double", most).collect()
    assert {r.id: r.double for r in found} == {i: 2 * i if i % 5 == 2 else None for i in range(2_000)}


def test_first_of_equal_texts_is_kept(spark):
    rows = [(9, "Same  text"), (4, "same text"), (7, "other"), (8, " "), (5, "12"), (6, "OTHER")]
    frame = spark.createDataFrame(rows, "row_no long, text string").repartition(3)
    kept = clean.clean(clean.prepare(frame)).collect()
    assert sorted((r.row_no, r.review_text) for r in kept) == [(4, "same text"), (6, "OTHER")]
    assert clean.clean(clean.prepare(frame.limit(0))).count() == 0
