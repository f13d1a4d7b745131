"""The 0-10 priority score of each topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed


def topic_measures(reviews: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Counts and sums per topic, in one pass over a narrow table.

    Needs topic_id, topic, sentiment_label, sentiment_score, is_commercial and
    the row number. Grouping first by (topic_id, topic) keeps every aggregate
    of fixed width, so the large step is a hash aggregate with partial sums; a
    second, tiny grouping picks the label seen first.
    """
    label, score = F.col("sentiment_label"), F.col("sentiment_score")
    known = label != "Unknown"
    per_label = reviews.groupBy("topic_id", "topic").agg(
        F.count("*").alias("review_count"),
        *[F.count_if(label == s).alias(f"{s.lower()}_n") for s in fixed.SENTIMENTS],
        F.sum(score).alias("score_sum"),
        F.count(score).alias("score_n"),
        F.sum(F.when(known, -F.least(score, F.lit(0.0)))).alias("intensity_sum"),
        F.count(F.when(known, score)).alias("intensity_n"),
        F.count_if("is_commercial").alias("commercial_n"),
        F.min(row_no).alias("first_row"),
    )
    sums = [c for c in per_label.columns if c not in ("topic_id", "topic", "first_row")]
    return per_label.groupBy("topic_id").agg(
        F.min_by("topic", "first_row").alias("topic"), *[F.sum(c).alias(c) for c in sums]
    )


def weighted_impact(weights: dict[str, float] = fixed.IMPACT_WEIGHTS) -> tuple[Column, Column]:
    """(score, weight available), leaving out components that are null."""
    parts = [F.coalesce(F.col(c) * F.lit(w), F.lit(0.0)) for c, w in weights.items()]
    shares = [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()]
    available = sum(shares[1:], shares[0])
    return sum(parts[1:], parts[0]) / available, available


def score_topics(
    reviews: DataFrame, trends: DataFrame, weights: dict[str, float] = fixed.IMPACT_WEIGHTS, row_no: str = "row_no"
) -> DataFrame:
    """One ranked row per topic; ties go to the lower topic id."""
    n = F.col("review_count")
    share = n / F.sum("review_count").over(Window.partitionBy())  # one row per topic
    scored = topic_measures(reviews, row_no).select(
        "topic_id", "topic", "review_count",
        (share * 100).alias("share_pct"),
        *[(F.col(f"{s.lower()}_n") / n * 100).alias(f"{s.lower()}_pct") for s in fixed.SENTIMENTS],
        (F.col("score_sum") / F.when(F.col("score_n") > 0, F.col("score_n"))).alias("average_sentiment"),
        ((n - F.col("unknown_n")) / n * 100).alias("sentiment_coverage"),
        (share * 10).alias("prevalence_score"),
        (F.col("intensity_sum") / F.when(F.col("intensity_n") > 0, F.col("intensity_n")) * 10).alias("negative_intensity_score"),
        (F.col("commercial_n") / n * 10).alias("purchase_relevance_score"),
    )
    change = trends.select("topic_id", "change_pp", F.col("trend").alias("_trend"))
    joined = scored.join(change, "topic_id", "left").withColumns({
        "trend_growth_score": F.least(F.greatest(F.col("change_pp"), F.lit(0.0)), F.lit(10.0)),
        "trend": F.coalesce("_trend", F.lit(fixed.UNAVAILABLE)),
    }).drop("_trend")
    joined = joined.withColumn(
        "trend_growth_score", F.when(F.col("change_pp").isNotNull(), F.col("trend_growth_score"))
    )
    impact, available = weighted_impact(weights)
    ranked = Window.orderBy(F.desc("impact_score"), "topic_id")
    return joined.withColumns({"impact_score": impact, "available_weight": available}).withColumn(
        "impact_rank", F.row_number().over(ranked)
    )
