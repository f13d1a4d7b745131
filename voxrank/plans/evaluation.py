"""The summary of one analysis: quality, grounding, repeatability, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrank.operators import brief, evaluate, lexical
from voxrank.plans.analyze import NARROW, score
from voxrank.session import materialise

_PERCENT = "percent"
_UNITS = {
    "Lexical topic cohesion proxy (weighted mean)": "cosine similarity",
    "Sentiment coverage": _PERCENT,
    "Topic assignment coverage": _PERCENT,
    "Topic outlier rate": _PERCENT,
    "Recommendation evidence citation rate": _PERCENT,
    "Deterministic brief reproducibility": "boolean (1=true)",
    "Maximum recalculated impact-score difference": "score points",
    "Human-validated topic accuracy": _PERCENT,
    "Human-validated sentiment accuracy": _PERCENT,
}
_LABELLED = "Completed human validation rows"


def evaluation_summary(reviews: DataFrame, scores: DataFrame, ids: DataFrame, validation: DataFrame) -> DataFrame:
    """(metric, value, unit) rows for a scored, flagged review table.

    Each part is a distributed aggregate of one row; the parts are written and
    then laid side by side. Scores are recomputed from the reviews, and the
    brief is made twice, to show that neither moves.
    """
    def made(s: DataFrame, i: DataFrame) -> DataFrame:
        return brief.brief_fingerprint(brief.brief_summary(s), brief.deterministic_insights(s, i))

    insights = materialise(brief.deterministic_insights(scores, ids), "insights")
    again = score(reviews.select(*NARROW))[2]
    parts = {
        "cohesion": lexical.cohesion_summary(lexical.lexical_cohesion(reviews)),
        "coverage": evaluate.coverage(reviews),
        "citations": evaluate.citation_metrics(insights, reviews),
        "first": made(scores, ids),
        "second": made(scores.repartition(3), ids.repartition(2)),
        "difference": evaluate.largest_score_difference(scores, again),
        "labels": evaluate.label_accuracy(validation),
    }
    row = {name: materialise(part, name) for name, part in parts.items()}

    def value(part: str, column: str):
        return row[part].select(F.col(column).cast("double")).scalar()

    same = row["first"].select("brief_sha256").scalar() == row["second"].select("brief_sha256").scalar()
    values = [
        value("cohesion", "weighted_mean"), value("coverage", "sentiment_coverage_pct"),
        value("coverage", "assignment_coverage_pct"), value("coverage", "outlier_rate_pct"),
        value("citations", "citation_rate_pct"), same.cast("double"), value("difference", "max_difference"),
        value("labels", "topic_accuracy_pct"), value("labels", "sentiment_accuracy_pct"),
    ]
    wide = row["labels"].select(
        F.concat(F.lit("of "), F.col("sample_rows").cast("string")).alias("sample"),
        *[v.alias(name) for v, name in zip(values, _UNITS)], F.col("rows_with_both_labels").cast("double").alias(_LABELLED),
    )
    unit = F.when(F.col("metric") == _LABELLED, F.col("sample"))
    for name, text in _UNITS.items():
        unit = unit.when(F.col("metric") == name, text)
    return wide.unpivot(["sample"], [*_UNITS, _LABELLED], "metric", "value").select("metric", "value", unit.alias("unit"))
