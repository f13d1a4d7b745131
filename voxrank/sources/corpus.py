"""Review tables derived from the generated document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Notations of the untidy upload's dates; those with a clock say ten to four in the afternoon, or the same in another zone.
DATE_NOTATIONS = [
    "yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMMM d, yyyy '3:50 PM'", "MMM d, yyyy '15:50'", "dd-MMM-yy", "yyyy/MM/dd '15:50:00'",
    "yyyyMMdd'T155000'", "yyyy-MM-dd '3:50 PM'", "EEE MMM d '15:50:00' yyyy", "yyyy-MM-dd '10:50:00 EST'", "MMM d yyyy", "d'th' MMMM yyyy",
    "yyyy.MM.dd", "EEE, dd MMM yyyy '15:50:00 GMT'", "dd-MMM-yyyy", "M/d/yyyy '3:50 pm'", "yyyy-MM-dd'T16:50:00.0+01:00'", "d MMM yyyy",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document: rating from its labels, date and topic by rule."""
    labels = table(spark, sf_dir, "labels")
    rating = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 5.0)
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), 3.0)
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), 2.0)
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), 1.0)
    )
    topic = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    step = F.expr("(doc_id div 20) * 37")
    days = F.when(topic <= 4, step % 60).when(topic <= 9, 40 + step % 60).otherwise(step % 100).cast("int")
    date = F.when(F.col("doc_id") % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), days).cast("timestamp"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_no"), F.col("text").alias("review_text"), rating.alias("rating"),
        date.alias("date"), F.col("lang").alias("product"), "source",
        topic.alias("topic_id"), F.col("source").alias("topic"),
    )


def untidy_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents as an untidy upload: text cells, odd headings, faults.

    Blank, noise-only and re-spaced texts, unusable ratings and dates in
    several notations are placed by rule on the document id.
    """
    doc = F.col("doc_id")
    comment = (
        F.when(doc % 29 == 0, F.lit(None))
        .when(doc % 31 == 0, F.lit("   "))
        .when(doc % 37 == 0, F.concat(F.lit("#"), doc.cast("string"), F.lit(" 100%!")))
        .when(doc % 7 == 0, F.concat(F.lit("  "), F.translate("text", _LOWER, _LOWER.upper()), F.lit("  ")))
        .otherwise(F.col("text"))
    )
    stars = (
        F.when(doc % 11 == 0, F.lit("five")).when(doc % 13 == 0, F.lit("9")).when(doc % 5 == 0, F.lit("2.5"))
        .when(doc % 3 == 0, (doc % 5 + 1).cast("string"))
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 300).cast("int"))
    written = F.when(doc % 19 == 0, F.lit("soon"))
    for place, notation in enumerate(DATE_NOTATIONS):
        written = written.when(doc % (len(DATE_NOTATIONS) + 1) == place, F.date_format(day, notation))
    return table(spark, sf_dir, "documents").select(
        doc.alias("row_no"), comment.alias(" Comment "), stars.alias("STARS"),
        written.alias("Review_Date"), F.col("lang").alias("product"),
    )


def letter_rates(spark: SparkSession, sf_dir: str, letters: str) -> DataFrame:
    """(row_no, point): how often each letter stands in each whole text, as a vector."""
    size = F.greatest(F.length("text"), F.lit(1))
    rates = [(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))) / size for c in letters]
    known = table(spark, sf_dir, "documents").where("text is not null")
    return known.select(F.col("doc_id").alias("row_no"), F.array(*rates).alias("point"))
