from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxrank.operators import clean
from voxrank.operators.trends import iso_instant
from voxrank.sources.exports import table_fingerprint


def upload(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_no long, {schema}")


def run(frame):
    prepared = clean.prepare(frame)
    report = clean.quality_report(prepared, clean.uploaded_columns(frame)).first()
    return clean.clean(prepared), report


def test_cleaning_example(spark):
    rows = [(" Good! ", "5"), ("good!", "5"), (None, "3"), ("123", "2"), ("No", "9")]
    kept, report = run(upload(spark, rows, "` Comment ` string, STARS string"))
    assert sorted(r.review_id for r in kept.collect()) == ["R000001", "R000005"]
    assert (report.uploaded, report.valid, report.duplicates_removed, report.invalid_ratings) == (5, 2, 1, 1)
    assert (report.missing_removed, report.noise_removed) == (1, 1)
    assert report.missing_values == {"review_text": 1, "rating": 0}
    assert {"rating", "date", "product", "source"} <= set(kept.columns)


def test_first_row_of_a_repeat_wins_whatever_the_partitions(spark):
    rows = [(f"Text {i % 7}", str(i % 5 + 1)) for i in range(300)] + [("same", "1")] * 200
    frame = upload(spark, rows, "text string, rating string")
    seen = None
    for parts in (1, 7):
        kept, report = run(frame.repartition(parts))
        now = sorted((r.row_no, r.review_text, r.rating) for r in kept.collect())
        assert [r[0] for r in now] == [0, 1, 2, 3, 4, 5, 6, 300]
        assert report.duplicates_removed == 492
        assert seen is None or now == seen
        seen = now


def test_case_folding_joins_sharp_s(spark):
    kept, _ = run(upload(spark, [("Straße",), ("STRASSE",), ("strasse ",)], "text string"))
    assert kept.count() == 1


def test_ratings(spark):
    texts = ["1", "5.0", "2.5", " 3 ", "0.99", "6", "five", "NaN", "inf", "5d", "1e0", None]
    frame = upload(spark, [(f"Row {chr(97 + i)}", t) for i, t in enumerate(texts)], "text string, rating string")
    kept, report = run(frame)
    assert [r.rating for r in kept.orderBy("row_no").collect()] == [1.0, 5.0, 2.5, 3.0, None, None, None, None, None, None, 1.0, None]
    assert report.invalid_ratings == 6
    numeric = upload(spark, [("a", 4.0), ("b", float("nan")), ("c", 7.0)], "text string, rating double")
    kept, report = run(numeric)
    assert [r.rating for r in kept.orderBy("row_no").collect()] == [4.0, None, None]
    assert (report.invalid_ratings, report.missing_values["rating"]) == (1, 1)


def test_dates(spark):
    texts = {
        "2026-01-12": datetime(2026, 1, 12), "2026-01-12T10:30:00Z": datetime(2026, 1, 12, 10, 30),
        "2026-01-12 10:30:00+02:00": datetime(2026, 1, 12, 8, 30), "01/31/2026": datetime(2026, 1, 31),
        "31/01/2026": datetime(2026, 1, 31), "2026/1/5": datetime(2026, 1, 5), "20260105": datetime(2026, 1, 5),
        "Jan 5, 2026": datetime(2026, 1, 5), "5 January 2026": datetime(2026, 1, 5), "soon": None, "2026-13-45": None,
    }
    frame = upload(spark, [(f"Row {chr(97 + i)}", t) for i, t in enumerate(texts)], "text string, date string")
    kept, report = run(frame)
    assert [r.date for r in kept.orderBy("row_no").collect()] == list(texts.values())
    assert (report.invalid_dates, report.dated_reviews) == (2, 9)


def test_ids_past_a_million(spark):
    frame = spark.createDataFrame([(999_998, "a"), (999_999, "b"), (1_234_567, "c")], "row_no long, text string")
    assert sorted(r.review_id for r in clean.clean(clean.prepare(frame)).collect()) == ["R1000000", "R1234568", "R999999"]


def test_only_named_columns_are_shuffled(spark):
    frame = upload(spark, [("One",), ("one",)], "text string")
    narrow = clean.clean(clean.prepare(frame), ["row_no", "review_id"])
    assert "review_text" not in narrow.columns and narrow.count() == 1
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_column_errors(spark):
    with pytest.raises(ValueError, match="review_text"):
        clean.prepare(upload(spark, [("hi",)], "wrong string"))
    with pytest.raises(ValueError, match="unique"):
        clean.prepare(spark.range(1).select(F.lit(0).alias("row_no"), F.lit("a").alias("Text "), F.lit("b").alias("text2")).toDF("row_no", "Text ", " text"))


def test_empty_upload(spark):
    kept, report = run(spark.createDataFrame([], "row_no long, text string"))
    assert kept.count() == 0
    assert (report.uploaded, report.valid, report.average_length) == (0, 0, 0.0)


NOTATIONS = {
    "1/5/24": "2024-01-05T00:00:00+00:00", "Jan 5 2024": "2024-01-05T00:00:00+00:00", "2024.01.05": "2024-01-05T00:00:00+00:00",
    "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05T10:00:00+00:00", "05-Jan-2024": "2024-01-05T00:00:00+00:00",
    "1/5/2024 3:04 PM": "2024-01-05T15:04:00+00:00", "2024-01-05": "2024-01-05T00:00:00+00:00", "2024-01": "2024-01-01T00:00:00+00:00",
    "2024": "2024-01-01T00:00:00+00:00", "2024-01-05 10:00": "2024-01-05T10:00:00+00:00",
    "2024-01-05T10:00:00.5+02:00": "2024-01-05T08:00:00.500000+00:00", "13/1/2024": "2024-01-13T00:00:00+00:00",
    "January 5, 2024 3:04 PM": "2024-01-05T15:04:00+00:00", "Jan 5, 2024 10:00": "2024-01-05T10:00:00+00:00",
    "05-Jan-24": "2024-01-05T00:00:00+00:00", "2024/01/05 10:00:00": "2024-01-05T10:00:00+00:00",
    "20240105T100000": "2024-01-05T10:00:00+00:00", "2024-01-05 3:04 PM": "2024-01-05T15:04:00+00:00",
    "Fri Jan  5 10:00:00 2024": "2024-01-05T10:00:00+00:00", "2024-01-05 10:00:00 EST": "2024-01-05T15:00:00+00:00",
    "jan 5 2024": "2024-01-05T00:00:00+00:00", "5th January 2024": "2024-01-05T00:00:00+00:00", "1/5/99": "1999-01-05T00:00:00+00:00",
    "Fri, 05 Jan 2024 10:00:00 +0130": "2024-01-05T08:30:00+00:00", "12/31/2024 12:05 am": "2024-12-31T00:05:00+00:00",
    "2024-01-05 10:00:00 Europe/Paris": "2024-01-05T09:00:00+00:00", "2024-01-05T10:00-8": "2024-01-05T18:00:00+00:00",
    "2024-02-30": None, "5 Janvier 2024": None, "13:00": None, "2024-01-05 25:00": None, "99/99/2024": None, "": None, "2024-01-05 13:00 pm": None,
    "2024-03-10 02:30:00": "2024-03-10T02:30:00+00:00", "1969-12-31 23:59:59.25": "1969-12-31T23:59:59.250000+00:00", "soon": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    frame = other.createDataFrame([(text,) for text in NOTATIONS], "date string")
    rows = frame.select("date", iso_instant(clean.parsed_date(F.col("date"))).alias("iso")).collect()
    assert {r.date: r.iso for r in rows} == NOTATIONS


def test_snapshot_fingerprint_does_not_depend_on_the_session_zone(spark):
    prints = set()
    for zone in ("UTC", "America/New_York"):
        other = spark.newSession()
        other.conf.set("spark.sql.session.timeZone", zone)
        frame = other.range(3).select(F.timestamp_seconds(F.col("id") * 1000).alias("at"), F.lit(None).cast("string").alias("x"))
        prints.add(tuple(table_fingerprint(frame).first()))
    assert len(prints) == 1
