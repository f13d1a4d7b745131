"""Reviews that support a topic, and the document a writer may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions.numbers import round_exact
from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise


def supporting_rows(reviews: DataFrame, size: int = fixed.BRIEF_ROWS_PER_KIND) -> DataFrame:
    """(topic_id, kind, position, review_id): first negative and first commercial rows.

    Both kinds share one pass and one ranking; the rank limit runs before the
    shuffle, so a topic holding most rows still sends only ``size`` per task.
    Needs topic_id, row_no, review_id, sentiment_label and cites_commerce.
    """
    kinds = F.array_compact(F.array(
        F.when(F.col("sentiment_label") == "Negative", F.lit("negative")),
        F.when(F.col("cites_commerce"), F.lit("commercial")),
    ))
    first = Window.partitionBy("topic_id", "kind").orderBy("row_no")
    rows = reviews.select("topic_id", "row_no", "review_id", F.explode(kinds).alias("kind"))
    return rows.withColumn("position", F.row_number().over(first)).where(F.col("position") <= size).drop("row_no")


def ids_by_kind(topics: DataFrame, supporting: DataFrame) -> DataFrame:
    """(topic_id, representative, negative, commercial): id lists in order."""
    def listed(kind: str) -> Column:
        chosen = F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "review_id")))
        return F.transform(F.sort_array(chosen), lambda x: x["review_id"]).alias(kind)

    lists = supporting.groupBy("topic_id").agg(listed("negative"), listed("commercial"))
    none = F.array().cast("array<string>")
    return topics.select("topic_id", F.col("representative_ids").alias("representative")).join(lists, "topic_id", "left").select(
        "topic_id", "representative", F.coalesce("negative", none).alias("negative"), F.coalesce("commercial", none).alias("commercial"),
    )


def own_ids(ids: DataFrame, reviews: DataFrame) -> DataFrame:
    """The id lists without reviews of other topics, or of none.

    Supporting rows come from the topic itself, so only the listed representatives, a few a
    topic, are looked up: one narrow scan past a broadcast of counted ids.
    """
    listed = materialise(ids.select("topic_id", F.posexplode("representative").alias("position", "review_id")), "listed")
    found = reviews.select("topic_id", "review_id").join(counted_broadcast(listed), ["topic_id", "review_id"])
    kept = found.groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "review_id"))), lambda x: x["review_id"]).alias("_own"))
    none = F.array().cast("array<string>")
    return ids.join(kept, "topic_id", "left").withColumn("representative", F.coalesce("_own", none)).drop("_own")


def evidence_pool(ids: DataFrame, size: int = fixed.EVIDENCE_POOL_SIZE, per_kind: int = fixed.POOL_ROWS_PER_KIND) -> DataFrame:
    """(topic_id, review_ids): representatives, then negatives, then commercial, without repeats."""
    joined = F.concat("representative", F.slice("negative", 1, per_kind), F.slice("commercial", 1, per_kind))
    return ids.select("topic_id", F.slice(F.array_distinct(joined), 1, size).alias("review_ids"))


def cited_reviews(cites: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """(key, position, review_id, ...) for id lists; an unknown id fails the job.

    ``reviews`` may be the full table: it is scanned once past the broadcast
    ids, never shuffled. What is missing is then found among the few matches.
    """
    wanted = materialise(cites.select(key, F.posexplode("review_ids").alias("position", "review_id")), "cited")
    known = reviews.select("review_id", "review_text", "source", "sentiment_label", F.lit(True).alias("_known"))
    found = known.join(counted_broadcast(wanted.select("review_id").distinct()), "review_id")
    unknown = F.raise_error(F.concat(F.lit("Cited review not found: "), F.col("review_id"))).cast("boolean")
    return (
        wanted.join(found, "review_id", "left")
        .where(F.when(F.col("_known"), F.lit(True)).otherwise(unknown))
        .drop("_known")
    )


def _rounded(name: str, alias: str) -> Column:
    return round_exact(F.col(name), 4).alias(alias)


def structured_evidence(scores: DataFrame, pool: DataFrame, reviews: DataFrame) -> DataFrame:
    """One nested row per topic: rounded metrics and its evidence reviews."""
    row = F.struct(
        "position", "review_id", "review_text",
        F.coalesce("source", F.lit(fixed.UNAVAILABLE)).alias("source"), F.col("sentiment_label").alias("sentiment"),
    )
    quoted = cited_reviews(pool, reviews, "topic_id").groupBy("topic_id").agg(
        F.transform(
            F.sort_array(F.collect_list(row)),
            lambda x: F.struct(x["review_id"].alias("review_id"), x["review_text"].alias("review_text"),
                               x["source"].alias("source"), x["sentiment"].alias("sentiment")),
        ).alias("evidence_reviews")
    )
    return scores.join(quoted, "topic_id", "left").select(
        "topic_id", F.col("topic").alias("topic_name"), "impact_rank", "review_count",
        _rounded("share_pct", "share_of_voice_pct"),
        F.struct(
            *[_rounded(f"{s.lower()}_pct", f"{s.lower()}_pct") for s in fixed.SENTIMENTS],
            _rounded("average_sentiment", "average_score"), _rounded("sentiment_coverage", "coverage_pct"),
        ).alias("sentiment"),
        F.struct(F.col("trend").alias("direction"), _rounded("change_pp", "change_percentage_points")).alias("trend"),
        F.struct(
            _rounded("purchase_relevance_score", "score_0_to_10"),
            round_exact(F.col("purchase_relevance_score") * 10, 4).alias("matched_review_pct"),
        ).alias("purchase_relevance"),
        F.struct(
            _rounded("impact_score", "score_0_to_10"), _rounded("available_weight", "available_weight"),
            F.struct(
                _rounded("prevalence_score", "prevalence"), _rounded("negative_intensity_score", "negative_intensity"),
                _rounded("purchase_relevance_score", "purchase_relevance"), _rounded("trend_growth_score", "trend_growth"),
            ).alias("components"),
        ).alias("business_impact"),
        F.coalesce("evidence_reviews", F.array().cast(
            "array<struct<review_id:string,review_text:string,source:string,sentiment:string>>")).alias("evidence_reviews"),
    )


def evidence_document(evidence: DataFrame) -> DataFrame:
    """One row: scope and every topic in rank order as one JSON text.

    Size is bounded by topics x pool size, not by the reviews behind them.
    """
    fields = F.struct(*evidence.columns)
    whole = evidence.agg(
        F.sum("review_count").alias("valid_review_count"), F.count("*").alias("topic_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("impact_rank", fields.alias("topic")))), lambda x: x["topic"]).alias("topics"),
    )
    return whole.select(F.to_json(F.struct(
        F.struct(
            "valid_review_count", "topic_count", F.array(*[F.lit(t) for t in fixed.EVIDENCE_LIMITATIONS]).alias("limitations"),
        ).alias("analysis_scope"),
        "topics",
    ), {"ignoreNullFields": "false"}).alias("document"))
