"""Topic shares in two halves of the dated period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed


def period_bounds(reviews: DataFrame) -> DataFrame:
    """One row: dated rows, first and last instant, midpoint, and whether a trend exists."""
    first, last = F.unix_micros(F.min("date")), F.unix_micros(F.max("date"))
    return reviews.agg(
        F.count("date").alias("dated_reviews"), first.alias("first"), last.alias("last"),
    ).select(
        "dated_reviews",
        F.timestamp_micros(F.shiftright(F.col("first") + F.col("last"), 1)).alias("split"),
        F.coalesce(
            (F.col("dated_reviews") >= fixed.TREND_MINIMUM_ROWS) & (F.col("first") < F.col("last")), F.lit(False)
        ).alias("available"),
    )


def _halves(reviews: DataFrame, bounds: DataFrame) -> DataFrame:
    """Dated rows per topic in each half; topics without dates count zero.

    The midpoint is a scalar subquery, so only (topic, date) is scanned and
    partial counts are all that is shuffled.
    """
    earlier = F.col("date") <= bounds.select("split").scalar()
    return reviews.select("topic_id", earlier.alias("earlier")).groupBy("topic_id").agg(
        F.count_if("earlier").alias("earlier_n"), F.count_if(~F.col("earlier")).alias("later_n"),
    )


def trend_label(change: Column, threshold: float = fixed.TREND_THRESHOLD_POINTS) -> Column:
    return F.when(change >= threshold, "Emerging").when(change <= -threshold, "Declining").otherwise("Stable")


def iso_instant(moment: Column) -> Column:
    """ISO text of an instant in UTC, whatever the session's zone: built from its microseconds since 1970."""
    total = F.unix_micros(moment)
    micros = F.pmod(total, F.lit(1000000))
    second = F.floor(total / 1000000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    in_day = F.pmod(second, F.lit(86400)).cast("int")
    clock = F.format_string("T%02d:%02d:%02d", F.floor(in_day / 3600), F.floor(in_day % 3600 / 60), in_day % 60)
    fraction = F.when(micros != 0, F.format_string(".%06d", micros)).otherwise("")
    return F.concat(day.cast("string"), clock, fraction, F.lit("+00:00"))


def analyze_trends(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per topic, one row of metadata); no rows when unavailable."""
    bounds = period_bounds(reviews)
    halves = _halves(reviews, bounds)
    everything = Window.partitionBy()  # over the topic table: one row per topic

    def share(count: str) -> Column:
        return F.col(count) / F.sum(count).over(everything) * 100

    trends = (
        halves.where(bounds.select("available").scalar())
        .select("topic_id", share("earlier_n").alias("earlier_share"), share("later_n").alias("later_share"))
        .withColumn("change_pp", F.col("later_share") - F.col("earlier_share"))
        .withColumn("trend", trend_label(F.col("change_pp")))
    )
    totals = halves.agg(F.sum("earlier_n").alias("earlier_n"), F.sum("later_n").alias("later_n"))
    available = F.col("available")
    meta = bounds.withColumns({n: totals.select(n).scalar() for n in totals.columns}).select(
        "available",
        F.when(~available, fixed.TREND_UNAVAILABLE_REASON).alias("reason"),
        F.when(available, F.col("dated_reviews")).alias("dated_reviews"),
        F.when(available, F.col("earlier_n")).alias("earlier_n"),
        F.when(available, F.col("later_n")).alias("later_n"),
        F.when(available, iso_instant(F.col("split"))).alias("split"),
        F.when(available, F.least("earlier_n", "later_n") < fixed.LOW_SAMPLE_ROWS).alias("low_sample"),
    )
    return trends, meta
