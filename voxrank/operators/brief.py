"""The deterministic brief: which topics to act on, with cited reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions.numbers import fixed_decimals

# (category, which topic, which evidence), in the order the brief lists them.
_RULES = [
    ("Pain Points", "pain", "negative"),
    ("Product", "pain", "negative"),
    ("Pricing", "priced", "commercial"),
    ("Marketing", "leading", "representative"),
    ("Emerging Signals", "rising", "negative"),
]


def evidence_sentence(topics: Column) -> Column:
    """The measured facts of one scored topic as text."""
    def one(name: str, digits: int) -> Column:
        return fixed_decimals(F.col(name), digits)

    text = F.concat(
        F.lit("Rank "), F.col("impact_rank").cast("string"), F.lit(" of "), topics.cast("string"), F.lit("; "),
        F.col("review_count").cast("string"), F.lit(" reviews ("), one("share_pct", 1), F.lit("% share of voice); "),
        one("negative_pct", 1), F.lit("% negative; Business Impact Score "), one("impact_score", 2),
        F.lit("/10; purchase relevance "), one("purchase_relevance_score", 2),
        F.lit("/10; sentiment coverage "), one("sentiment_coverage", 1), F.lit("%."),
    )
    change = F.concat(
        F.lit(" Topic share changed "), fixed_decimals(F.col("change_pp"), 1, signed=True),
        F.lit(" percentage points between the two dated periods."),
    )
    return F.concat(text, F.coalesce(change, F.lit("")))


def _chosen_topics(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """One row naming the topic of each rule, from one pass over the scores."""
    rank = F.col("impact_rank")
    facts = scores.join(ids, "topic_id", "left")
    negative = F.col("negative_pct") > 0
    rising = negative & (F.col("change_pp") >= fixed.TREND_THRESHOLD_POINTS)
    return facts.agg(
        F.min_by("topic_id", F.when(negative, rank)).alias("pain"),
        F.min_by("topic_id", F.when(F.size("commercial") > 0, rank)).alias("priced"),
        F.min_by("topic_id", rank).alias("leading"),
        F.max_by("topic_id", F.when(rising, F.struct("change_pp", -rank))).alias("rising"),
    )


def deterministic_insights(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per recommendation; a rule without evidence gives none.

    Works on the scored topics and the id lists of ``evidence.ids_by_kind``,
    both one row per topic.
    """
    rules = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(category).alias("category"), F.col(topic).alias("topic_id"),
            F.lit(kind).alias("kind"), F.lit(fixed.BRIEF_ACTIONS[category]).alias("action"),
        )
        for i, (category, topic, kind) in enumerate(_RULES)
    ])
    picked = _chosen_topics(scores, ids).select(F.inline(rules)).where("topic_id is not null")
    topics = scores.agg(F.count("*").alias("n")).scalar()
    cited = (
        F.when(F.col("kind") == "negative", F.col("negative"))
        .when(F.col("kind") == "commercial", F.col("commercial")).otherwise(F.col("representative"))
    )
    kept = picked.join(scores, "topic_id").join(ids, "topic_id").withColumn("review_ids", cited).where(F.size("review_ids") > 0)
    number = F.row_number().over(Window.orderBy("step"))  # at most five rows
    return kept.select(
        F.format_string("D%d", number).alias("insight_id"), "category", "topic_id", "topic",
        F.col("impact_rank").alias("rank"),
        F.concat("topic", F.lit(": "), fixed_decimals(F.col("negative_pct"), 1), F.lit("% negative across "),
                 F.col("review_count").cast("string"), F.lit(" reviews")).alias("finding"),
        evidence_sentence(topics).alias("evidence"),
        F.lit(fixed.BRIEF_IMPLICATION).alias("implication"), "action", "review_ids",
    )


def brief_summary(scores: DataFrame, method: str = fixed.BRIEF_METHOD) -> DataFrame:
    """One row: the executive summary and how it was made."""
    whole = scores.agg(
        F.sum("review_count").alias("reviews"), F.count("*").alias("topics"),
        F.min_by(F.struct("topic", "impact_score"), "impact_rank").alias("top"),
    )
    return whole.select(
        F.concat(
            F.lit("Analyzed "), F.format_string("%,d", "reviews"), F.lit(" reviews across "), F.col("topics").cast("string"),
            F.lit(" topics. "), F.col("top.topic"), F.lit(" ranks first within this dataset with an Impact Score of "),
            fixed_decimals(F.col("top.impact_score"), 2),
            F.lit("/10. This is a relative investigation priority, not a claim of high absolute impact. "
                  "Recommendations are evidence-linked hypotheses for validation."),
        ).alias("summary"),
        F.lit(method).alias("method"),
    )


def brief_fingerprint(summary: DataFrame, insights: DataFrame) -> DataFrame:
    """SHA-256 of the whole brief as ordered JSON; equal briefs hash alike."""
    listed = insights.agg(F.sort_array(F.collect_list(F.struct("insight_id", *[
        c for c in sorted(insights.columns) if c != "insight_id"]))).alias("insights"))
    return summary.select(F.sha2(F.to_json(F.struct(
        listed.select("insights").scalar().alias("insights"), "method", "summary")), 256).alias("brief_sha256"))
