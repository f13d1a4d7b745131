"""From an upload to ranked topics, evidence and a brief."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions import text as tx
from voxrank.operators import brief, clean, evidence, impact, sentiment, topics, trends
from voxrank.session import materialise

# Everything scoring, trends and evidence selection read; no review text.
NARROW = ["row_no", "review_id", "topic_id", "topic", "date", "sentiment_label", "sentiment_score", "is_commercial", "cites_commerce"]


def with_flags(reviews: DataFrame, terms: Sequence[str] = fixed.COMMERCIAL_TERMS, case_sensitive_evidence: bool = True) -> DataFrame:
    """Commercial wording as two flags: any case for scores, as written for evidence."""
    text = F.col("review_text")
    return reviews.withColumns({
        "is_commercial": tx.mentions(text, terms),
        "cites_commerce": tx.mentions(text, terms, ignore_case=not case_sensitive_evidence),
    })


def narrow_reviews(upload: DataFrame, terms: Sequence[str] = fixed.COMMERCIAL_TERMS, case_sensitive_evidence: bool = True) -> DataFrame:
    """Clean reviews that already have a topic, as the narrow scoring table.

    Flags are taken from the text before repeats are dropped, so the text is
    read once and never shuffled. Written once: trends need two passes, scores
    and evidence one each.
    """
    flagged = with_flags(sentiment.from_rating(clean.prepare(upload)), terms, case_sensitive_evidence)
    return materialise(clean.clean(flagged, NARROW), "narrow")


@dataclass
class Analysis:
    reviews: DataFrame
    quality: DataFrame
    topics: DataFrame
    topic_method: str
    topic_warnings: list[str]
    sentiment_method: str
    sentiment_warnings: list[str]
    trends: DataFrame
    trend_meta: DataFrame
    scores: DataFrame
    evidence_ids: DataFrame
    summary: DataFrame
    insights: DataFrame


def score(narrow: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trends, trend metadata, scores) of the narrow table."""
    changes, meta = trends.analyze_trends(narrow)
    return changes, meta, impact.score_topics(narrow, changes)


def analyze(
    upload: DataFrame, mode: str = "auto", load_sentiment_model: Callable | None = None,
    load_embedding_model: Callable | None = None, embedding: str | None = None,
    terms: Sequence[str] = fixed.COMMERCIAL_TERMS, case_sensitive_evidence: bool = True,
    stop_words: Sequence[str] | None = None, sentences: Sequence[str] = fixed.CONTEXT_SENTENCES,
    restarts: int = fixed.CLUSTER_RESTARTS, iterations: int = fixed.CLUSTER_ITERATIONS, clusters: int | None = None,
    smallest_topic: int | None = None,
) -> Analysis:
    """The whole analysis of an upload with row numbers.

    Review texts are stored, read again and scanned, but never shuffled: what is found on
    narrow columns comes back to the stored rows (``operators.late``).
    """
    prepared = clean.prepare(upload)
    quality = materialise(clean.quality_report(prepared, clean.uploaded_columns(upload)), "quality")
    cleaned = materialise(clean.clean(prepared), "clean")
    found = topics.discover_topics(
        cleaned, mode, load_embedding_model, embedding, stop_words, sentences, restarts, clusters, smallest_topic, iterations)
    felt, mood = sentiment.analyze_sentiment(found.reviews, load_sentiment_model)
    reviews = materialise(with_flags(felt, terms, case_sensitive_evidence), "reviews")
    narrow = reviews.select(*NARROW)
    changes, meta, scored = score(narrow)
    scores = materialise(scored, "scores")
    ids = materialise(evidence.ids_by_kind(found.topics, evidence.supporting_rows(narrow)), "evidence_ids")
    return Analysis(
        reviews, quality, found.topics, found.method, found.warnings, mood["method"], mood["warnings"],
        changes, meta, scores, ids, brief.brief_summary(scores), brief.deterministic_insights(scores, ids),
    )
