"""The result tables behind a review dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions.numbers import fixed_decimals
from voxrank.functions.text import shorten
from voxrank.operators.skew import counted_broadcast


def headline(reviews: DataFrame) -> DataFrame:
    label = F.col("sentiment_label")

    def percent(condition):
        return F.avg(condition.cast("int")) * 100

    return reviews.agg(
        F.count("*").alias("reviews"), F.count_distinct("topic_id").alias("topics"),
        percent(label == "Positive").alias("positive_pct"), percent(label == "Negative").alias("negative_pct"),
        percent(label != "Unknown").alias("coverage_pct"),
    )


def sentiment_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("sentiment_label").agg(F.count("*").alias("reviews"))


def is_synthetic(reviews: DataFrame) -> DataFrame:
    found = F.contains(F.lower(F.col("product").cast("string")), F.lit("synthetic"))
    return reviews.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("synthetic"))


def priority_table(scores: DataFrame) -> DataFrame:
    return scores.orderBy("impact_rank").select(
        "topic", "review_count", "share_pct", "negative_pct", "impact_score", "trend", "change_pp"
    )


def reach_points(scores: DataFrame) -> DataFrame:
    """Reach against dissatisfaction; only the three leading topics carry text."""
    marked = F.when(F.col("impact_rank") <= 3, shorten(F.col("topic"), 27)).otherwise("")
    return scores.select("topic", "share_pct", "negative_pct", "impact_score", "review_count", marked.alias("marker"))


def most_discussed(scores: DataFrame, size: int = fixed.MOST_DISCUSSED_TOPICS) -> DataFrame:
    most = scores.orderBy(F.desc("share_pct"), "impact_rank").limit(size).orderBy("share_pct", F.desc("impact_rank"))
    return most.select(
        F.concat(F.col("topic_id").cast("string"), F.lit(" · "), shorten(F.col("topic"), 31)).alias("display_topic"),
        "topic", "review_count", "share_pct",
        F.concat(fixed_decimals(F.col("share_pct"), 1), F.lit("%")).alias("share_text"),
    )


def fastest_rising(scores: DataFrame, size: int = fixed.FASTEST_RISING_TOPICS) -> DataFrame:
    rising = scores.where((F.col("change_pp") >= fixed.TREND_THRESHOLD_POINTS) & (F.col("negative_pct") > 0))
    return rising.orderBy(F.desc("change_pp"), "impact_rank").limit(size).select(
        shorten(F.col("topic"), 34).alias("topic"),
        F.concat(fixed_decimals(F.col("change_pp"), 1, signed=True), F.lit(" pp")).alias("change_text"), "change_pp",
    )


def trend_lines(trends: DataFrame, scores: DataFrame, size: int = fixed.TREND_CHART_TOPICS) -> DataFrame:
    focus = scores.where(F.col("impact_rank") <= size).select("topic_id", "topic")
    return trends.join(focus, "topic_id").select(
        "topic_id", "topic", F.col("earlier_share").alias("Earlier period"), F.col("later_share").alias("Later period")
    ).unpivot(["topic_id", "topic"], ["Earlier period", "Later period"], "period", "share_of_dated_pct")


def score_components(scores: DataFrame, weights: dict[str, float] = fixed.IMPACT_WEIGHTS) -> DataFrame:
    """One row per topic and score component, with the component's weight."""
    long = scores.unpivot(["topic_id"], list(weights), "measure", "score")
    name, weight = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, value in weights.items():
        name = F.when(F.col("measure") == key, fixed.COMPONENT_NAMES[key]).otherwise(name)
        weight = F.when(F.col("measure") == key, f"{value:.0%}").otherwise(weight)
    return long.select("topic_id", name.alias("component"), "score", weight.alias("weight"))


def sentiment_mix(scores: DataFrame) -> DataFrame:
    columns = [F.col(f"{s.lower()}_pct").alias(s) for s in fixed.SENTIMENTS]
    return scores.select("topic_id", *columns).unpivot(["topic_id"], fixed.SENTIMENTS, "sentiment", "share_pct")


def drill_down(scores: DataFrame, topics: DataFrame) -> DataFrame:
    """Headline figures of every topic page; filter on topic_id for one."""
    total = scores.agg(F.count("*").alias("n")).scalar()
    unavailable = F.lit(fixed.UNAVAILABLE)
    return scores.join(topics.select("topic_id", "keywords"), "topic_id").select(
        "topic_id", "topic",
        F.concat(F.col("impact_rank").cast("string"), F.lit(" of "), total.cast("string")).alias("rank_text"),
        F.concat(fixed_decimals(F.col("impact_score"), 2), F.lit(" / 10")).alias("score_text"),
        F.concat(fixed_decimals(F.col("share_pct"), 1), F.lit("%")).alias("share_text"),
        F.concat(fixed_decimals(F.col("negative_pct"), 1), F.lit("%")).alias("negative_text"),
        F.coalesce(F.concat(fixed_decimals(F.col("change_pp"), 1, signed=True), F.lit(" pp")), unavailable).alias("change_text"),
        "keywords",
    )


def topic_voices(topics: DataFrame, reviews: DataFrame) -> DataFrame:
    """Representative reviews of every topic in source order of the reviews."""
    wanted = topics.select("topic_id", F.explode("representative_ids").alias("review_id"))
    rows = reviews.select("row_no", "review_id", "review_text", "sentiment_label", "source")
    return rows.join(counted_broadcast(wanted), "review_id").select(
        "topic_id", "row_no", "review_id", "review_text", "sentiment_label",
        F.coalesce("source", F.lit("Source unavailable")).alias("source"),
    )


def recommendation_panel(insights: DataFrame, cited: DataFrame) -> DataFrame:
    """Each action category with its recommendation and evidence; empty ones shown."""
    spark = insights.sparkSession
    categories = spark.createDataFrame([(i, c) for i, c in enumerate(fixed.BRIEF_CATEGORIES)], "place int, category string")
    filled = insights.select("insight_id", "category", "topic", "rank", "finding", "action").join(
        cited.select("insight_id", "position", "review_id", "review_text", "source"), "insight_id"
    )
    return categories.join(filled, "category", "left")
