"""Coverage, grounding, agreement with human labels and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.operators.skew import counted_broadcast, join_one_to_one
from voxrank.session import materialise


def parsed_flag(text: Column) -> Column:
    """``true``/``false`` in any case and padding, else null."""
    bare = F.lower(F.trim(text.cast("string")))
    return F.when(bare == "true", True).when(bare == "false", False)


def _percent(condition: Column) -> Column:
    return F.avg(condition.cast("int")) * 100


def coverage(reviews: DataFrame) -> DataFrame:
    assigned = F.col("topic_id") != fixed.OUTLIER_TOPIC
    return reviews.agg(
        _percent(F.col("sentiment_label") != "Unknown").alias("sentiment_coverage_pct"),
        _percent(assigned).alias("assignment_coverage_pct"),
        _percent(~assigned).alias("outlier_rate_pct"),
        F.count_if(~assigned).alias("outlier_reviews"),
    )


def citation_checks(insights: DataFrame, reviews: DataFrame) -> DataFrame:
    """(insight_id, grounded): cited ids exist, share the topic, and are not none."""
    cited = insights.select("insight_id", F.col("topic_id").alias("claimed"), F.explode_outer("review_ids").alias("review_id"))
    ids = materialise(cited.select("review_id").where("review_id is not null").distinct(), "cited_ids")
    known = reviews.select("review_id", "topic_id").join(counted_broadcast(ids), "review_id")
    found = cited.join(known, "review_id", "left")
    return found.groupBy("insight_id").agg(
        F.bool_and(F.coalesce(F.col("topic_id") == F.col("claimed"), F.lit(False))).alias("grounded")
    )


def citation_metrics(insights: DataFrame, reviews: DataFrame) -> DataFrame:
    distinct = insights.select(F.explode("review_ids").alias("id")).agg(F.count_distinct("id").alias("n")).scalar()
    return citation_checks(insights, reviews).agg(
        F.count("*").alias("recommendations"),
        F.count_if("grounded").alias("with_valid_citations"),
        _percent(F.col("grounded")).alias("citation_rate_pct"),
    ).withColumn("distinct_cited_reviews", distinct)


def largest_score_difference(saved: DataFrame, recomputed: DataFrame) -> DataFrame:
    pairs = saved.select("topic_id", F.col("impact_score").alias("a")).join(
        recomputed.select("topic_id", F.col("impact_score").alias("b")), "topic_id", "full"
    )
    return pairs.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"))


def label_accuracy(validation: DataFrame) -> DataFrame:
    """Agreement over the rows holding a readable verdict; null when none does."""
    topic, sentiment = parsed_flag(F.col("topic_correct")), parsed_flag(F.col("sentiment_correct"))
    filled = (F.trim("human_topic") != "") & (F.trim("human_sentiment") != "")
    return validation.agg(
        F.count("*").alias("sample_rows"),
        F.count_if(filled).alias("rows_with_both_labels"),
        F.count(topic).alias("topic_rows"),
        F.count(sentiment).alias("sentiment_rows"),
        _percent(topic).alias("topic_accuracy_pct"),
        _percent(sentiment).alias("sentiment_accuracy_pct"),
    ).withColumn("accuracy_reported", (F.col("topic_rows") > 0) & (F.col("sentiment_rows") > 0))


def validation_sample(reviews: DataFrame, rows: int = fixed.SAMPLE_ROWS, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """A repeatable sample with blank columns for people to fill.

    Ordering by a seeded hash of the id gives the same rows however the table
    is partitioned; only the top ``rows`` of each task are compared.
    """
    drawn = reviews.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "review_id")), "review_id").limit(rows)
    blanks = ["human_topic", "human_sentiment", "topic_correct", "sentiment_correct"]
    return drawn.select(
        "review_text", F.col("topic").alias("model_topic"), F.col("sentiment_label").alias("model_sentiment"),
        *[F.lit("").alias(b) for b in blanks],
    )


def reuse_sentiment(reviews: DataFrame, earlier: DataFrame) -> DataFrame:
    """Earlier sentiment carried over by review id, one row to one row."""
    columns = ["review_id", "sentiment_label", "sentiment_score", "sentiment_method"]
    return join_one_to_one(reviews, earlier.select(*columns), ["review_id"])


def compare_assignments(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Both runs' topics per review, and whether the business topic changed.

    ``current`` has (review_id, review_text, topic_text, topic_id, topic_model_label,
    topic); ``baseline`` has (review_id, topic_id, topic, display_topic, business_topic).
    """
    new = current.select(
        "review_id", "review_text", "topic_text", F.col("topic_id").alias("v2_topic_id"), "topic_model_label",
        F.col("topic").alias("v2_business_topic"),
    )
    old = baseline.select(
        "review_id", F.col("topic_id").alias("baseline_topic_id"), F.col("topic").alias("baseline_model_topic"),
        F.col("display_topic").alias("baseline_display_topic"), F.col("business_topic").alias("baseline_business_topic"),
    )
    joined = join_one_to_one(new, old, ["review_id"], "inner")
    return joined.withColumn(
        "business_topic_changed", ~F.col("v2_business_topic").eqNullSafe(F.col("baseline_business_topic"))
    )


def judged_rows(validation: DataFrame, assignments: DataFrame) -> DataFrame:
    """Hand-labelled rows matched to both runs on their text."""
    side = assignments.select("review_text", "baseline_business_topic", "v2_topic_id", "topic_model_label", "v2_business_topic")
    joined = join_one_to_one(validation, side, ["review_text"])
    return joined.withColumns({
        "baseline_topic_correct": parsed_flag(F.col("topic_correct")),
        "v2_topic_correct": F.coalesce(F.col("v2_business_topic") == F.col("human_topic"), F.lit(False)),
        "assignment_changed": ~F.col("baseline_business_topic").eqNullSafe(F.col("v2_business_topic")),
    })


def accuracy_by_class(judged: DataFrame) -> DataFrame:
    """Per human topic: rows, agreement of both runs, and prediction breakdowns.

    Counts are first taken per (topic, prediction), so the JSON maps are built
    from one small row per prediction.
    """
    cells = judged.groupBy("human_topic", "v2_business_topic", "v2_topic_correct").agg(
        F.count("*").alias("n"), F.count_if("baseline_topic_correct").alias("baseline_n"),
        F.count("baseline_topic_correct").alias("baseline_judged"),
    )

    def breakdown(condition: Column) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(condition, F.struct("v2_business_topic", "n"))))
        return F.to_json(F.map_from_entries(pairs))

    named = F.col("v2_business_topic").isNotNull()
    correct = F.sum(F.when(F.col("v2_topic_correct"), F.col("n")).otherwise(0))
    return cells.groupBy("human_topic").agg(
        F.sum("n").alias("reviews"),
        F.sum("baseline_n").alias("baseline_correct"),
        (F.sum("baseline_n") / F.when(F.sum("baseline_judged") > 0, F.sum("baseline_judged")) * 100).alias("baseline_accuracy_pct"),
        correct.alias("v2_correct"),
        (correct / F.sum("n") * 100).alias("v2_accuracy_pct"),
        breakdown(named).alias("v2_prediction_breakdown"),
        breakdown(named & ~F.col("v2_topic_correct")).alias("v2_error_breakdown"),
    )


def before_after(judged: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: accuracy of both runs, what changed, and both outlier rates."""
    was, now = F.col("baseline_topic_correct"), F.col("v2_topic_correct")
    whole = assignments.agg(
        F.count("*").alias("all_reviews"), F.count_if("business_topic_changed").alias("all_changed"),
        _percent(F.col("baseline_topic_id") == fixed.OUTLIER_TOPIC).alias("baseline_outlier_pct"),
        _percent(F.col("v2_topic_id") == fixed.OUTLIER_TOPIC).alias("v2_outlier_pct"),
    )
    result = judged.agg(
        F.count("*").alias("validation_reviews"),
        _percent(was).alias("baseline_accuracy_pct"), _percent(now).alias("v2_accuracy_pct"),
        F.count_if("assignment_changed").alias("changed"),
        F.count_if(~was & now).alias("corrected"), F.count_if(was & ~now).alias("newly_incorrect"),
        _percent(parsed_flag(F.col("sentiment_correct"))).alias("sentiment_accuracy_pct"),
    ).withColumn("change_pp", F.col("v2_accuracy_pct") - F.col("baseline_accuracy_pct"))
    result = result.withColumns({name: whole.select(name).scalar() for name in whole.columns})
    return result.withColumns({
        "baseline_coverage_pct": 100 - F.col("baseline_outlier_pct"), "v2_coverage_pct": 100 - F.col("v2_outlier_pct"),
    })


def outcome_examples(judged: DataFrame, corrected: bool, order: str, size: int = fixed.EXAMPLES_PER_OUTCOME) -> DataFrame:
    """The first judged rows that became right, or wrong, in sample order."""
    was, now = F.col("baseline_topic_correct"), F.col("v2_topic_correct")
    chosen = judged.where(~was & now if corrected else was & ~now).orderBy(order).limit(size)
    return chosen.select(
        "review_text", "human_topic", "model_topic", "baseline_business_topic", "topic_model_label", "v2_business_topic"
    )
