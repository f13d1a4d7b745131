"""Standardise an upload, drop unusable rows and report on its quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions import text as tx
from voxrank.operators import late

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
# hours, minutes, seconds and fraction, half of the day, zone; or T and digits without signs
_CLOCK = (
    r"(?i)(?:[ ,T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\.?)?"
    r"|(?<=\d{8})T(\d{2})(\d{2})(\d{2})?)"
    r"\s*(Z|UTC|GMT|[ECMP][SD]T|[+-]\d{1,2}(?::?\d{2})?|[A-Z][a-z]+/[A-Z]\w+(?:/\w+)?)?(?=\s+\d{4}$|\s*$)"
)
_FORMS = "^(?:" + "|".join(fixed.DATE_FORMS) + ")$"

ROW_CHECKS = ["status", "dedup_key", "invalid_rating", "invalid_date", "missing_flags"]


def standardise_columns(df: DataFrame, aliases: dict[str, list[str]] = fixed.COLUMN_ALIASES) -> DataFrame:
    """Trim and lower-case names, apply aliases, require the review text."""
    names = [n.strip().lower() for n in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("Column names must be unique after trimming and lowercasing.")
    df = df.toDF(*names)
    for canonical, options in aliases.items():
        if canonical not in df.columns:
            found = next((o for o in options if o in df.columns), None)
            if found:
                df = df.withColumnRenamed(found, canonical)
    if "review_text" not in df.columns:
        raise ValueError("Add a review_text column (or review, text, comment, content).")
    return df


def is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if dict(df.dtypes)[name] in ("double", "float") else column.isNull()


def usable_rating(df: DataFrame, name: str) -> Column:
    """A number in the accepted range, else null."""
    number = F.col(name)
    if dict(df.dtypes)[name] == "string":
        number = F.when(number.rlike(_NUMBER), number.try_cast("double"))
    number = number.cast("double")
    return F.when(number.between(fixed.LOWEST_RATING, fixed.HIGHEST_RATING), number)


def parsed_date(date: Column) -> Column:
    """Mixed notations to a timestamp; month comes first where both orders fit.

    The text is taken apart once: weekday, clock, half of the day and zone are cut off, what is
    left is checked against the known forms and split into its three fields, whose order
    follows from their shapes. One instant in one notation is then parsed. Text without a zone is
    read in UTC, whatever the session's zone; years of two digits are 1969 to 2068; a
    missing month or day is the first.
    """
    if_date = F.regexp_replace(F.trim(date.cast("string")), _WEEKDAY, "")

    def read(text: Column) -> Column:
        bare = F.lower(F.regexp_replace(text, _CLOCK, ""))
        bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<=\d)(st|nd|rd|th)\b", ""), r"[,\s]+", " "))
        return F.when(bare.rlike(_FORMS), F.split(F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), "[-/. ]"))

    def month(name: Column) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in fixed.MONTHS]), F.left(name, F.lit(3)))

    def fields(parts: Column) -> Column:
        """(year, month, day) as numbers."""
        one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
        first, second = one.try_cast("int"), two.try_cast("int")
        year = three.try_cast("int")
        year = F.when(F.length(three) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)
        in_order = F.struct(first.alias("y"), F.coalesce(second, F.lit(1)).alias("m"), F.coalesce(three.try_cast("int"), F.lit(1)).alias("d"))
        named_first = F.struct(year.alias("y"), month(one).cast("int").alias("m"), second.alias("d"))
        named_second = F.struct(year.alias("y"), month(two).cast("int").alias("m"), first.alias("d"))
        swapped = first > 12
        numbers = F.struct(year.alias("y"), F.when(swapped, second).otherwise(first).alias("m"), F.when(swapped, first).otherwise(second).alias("d"))
        return F.when(F.length(one) == 4, F.when(first.isNotNull(), in_order).otherwise(named_first)).when(first.isNull(), named_first).when(
            second.isNull(), named_second).otherwise(numbers)

    def instant(text: Column) -> Column:
        def part(number: int, plain: int | None = None) -> Column:
            found = F.regexp_extract(text, _CLOCK, number)
            return F.concat(found, F.regexp_extract(text, _CLOCK, plain)) if plain else found

        hour = part(1, 6).try_cast("int")
        half = F.lower(part(5))
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        clocked = F.concat(
            F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2, 7), F.lit(":"), F.rpad(part(3, 8), 2, "0"),
            F.lit("."), F.rpad(part(4), 6, "0"))
        zone = F.lower(part(9))
        shifted = F.lit(None).cast("string")
        for name, offset in fixed.ZONE_HOURS.items():
            shifted = F.when(zone == name, offset).otherwise(shifted)
        offset = F.regexp_replace(F.regexp_replace(zone, r"^([+-])(\d)(:?\d\d)?$", "$10$2$3"), r"^([+-]\d\d)$", "$1:00")
        offset = F.regexp_replace(offset, r"^([+-]\d\d)(\d\d)$", "$1:$2")
        shifted = F.coalesce(shifted, F.when(zone.isin("", "z", "utc", "gmt"), F.lit("Z")).when(zone.rlike("^[+-]"), offset).otherwise(
            F.concat(F.lit(" "), part(9))))
        no_clock = part(2, 7) == ""
        day = tx.bind(read(text), lambda parts: tx.bind(fields(parts), lambda f: F.concat(
            F.lpad(f["y"].cast("string"), 4, "0"), F.lit("-"), F.lpad(f["m"].cast("string"), 2, "0"), F.lit("-"), F.lpad(f["d"].cast("string"), 2, "0"))))
        return F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(no_clock, F.lit("00:00:00Z")).otherwise(F.concat(clocked, shifted))))

    return F.when(F.typeof(date) == "timestamp", date.try_cast("timestamp")).otherwise(tx.bind(if_date, instant))


def review_id(row_no: Column) -> Column:
    return F.format_string("R%06d", row_no + 1)


def prepare(upload: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Canonical columns plus one status per row; no row is dropped yet.

    ``row_no`` is the 0-based source position (``sources.files.with_row_numbers``).
    The work is row-local, so nothing is shuffled here.
    """
    df = standardise_columns(upload)
    uploaded = [c for c in df.columns if c != row_no]
    missing = F.array(*[is_missing(df, c).cast("int") for c in uploaded])
    for name in fixed.OPTIONAL_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    rating = usable_rating(df, "rating")
    date = F.col("date") if dict(df.dtypes)["date"] == "timestamp" else parsed_date(F.col("date"))
    df = df.withColumns({"missing_flags": missing, "_rating": rating, "_date": date, "_raw": F.col("review_text")})
    df = tx.with_normalised(df, "_raw", "review_text", "_folded")
    blank, noise = F.col("review_text") == "", ~tx.has_letter(F.col("review_text"))
    return df.withColumns({
        "review_id": review_id(F.col(row_no)),
        "status": F.when(blank, "blank").when(noise, "noise").otherwise("usable"),
        "dedup_key": F.unhex(F.sha2("_folded", 256)),
        "review_length": tx.word_count(F.col("review_text")),
        "invalid_rating": ~is_missing(df, "rating") & F.col("_rating").isNull(),
        "invalid_date": F.col("date").isNotNull() & F.col("_date").isNull(),
        "rating": F.col("_rating"),
        "date": F.col("_date"),
    }).drop("_folded", "_rating", "_date")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in source order.

    The rank limit also runs before the shuffle, so each task sends at most one
    row of any key, however often that key repeats.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def clean(prepared: DataFrame, columns: Sequence[str] | None = None, row_no: str = "row_no") -> DataFrame:
    """Usable rows without repeats.

    The repeat key is a 32-byte hash; name the ``columns`` wanted to rank only
    those. Without it the rows are stored once, the first row of each key is found on
    (row number, key, status), and the stored rows are read again past the bits of the
    rows to drop: their text never meets a shuffle, nor does a hot key.
    """
    if columns is None:
        rows = late.stored(prepared, "prepared")
        first = F.min(F.struct(row_no, late.PLACE))[late.PLACE].alias(late.PLACE)
        # the status is no part of the key: equal texts have equal status
        kept = rows.where("status = 'usable'").groupBy("dedup_key").agg(first).select(late.PLACE)
        return late.keep(rows, kept).drop(late.PLACE, *ROW_CHECKS)
    rows = prepared.select(*dict.fromkeys([row_no, "dedup_key", "status", *columns]))
    # The status is tested after the ranking on purpose: before it, the test
    # would be pushed under the projection and evaluate every text twice. Blank
    # rows share one key, so they shrink to one row per task anyway.
    kept = keep_first(rows, ["dedup_key"], [row_no]).where("status = 'usable'")
    return kept.drop(*ROW_CHECKS)


def quality_report(prepared: DataFrame, uploaded: Sequence[str], row_no: str = "row_no") -> DataFrame:
    """One row of counts, from one narrow grouping by repeat key.

    Groups hold only counters and the first row's flags, all of fixed width, so
    the grouping runs as a hash aggregate with partial sums before the shuffle.
    Rating and date faults are counted on the rows that survive.
    """
    counted = prepared.select(
        F.when(F.col("status") == "usable", F.col("dedup_key")).alias("key"),
        "status", row_no, "review_length", "invalid_rating", "invalid_date",
        F.col("date").isNotNull().alias("dated"),
        *[F.get("missing_flags", F.lit(i)).alias(f"missing_{i}") for i in range(len(uploaded))],
    )

    def first(name: str) -> Column:
        return F.min_by(name, row_no).alias(name)

    groups = counted.groupBy("key").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("status") == "blank").alias("blank"),
        F.count_if(F.col("status") == "noise").alias("noise"),
        first("review_length"), first("invalid_rating"), first("invalid_date"), first("dated"),
        *[F.sum(f"missing_{i}").alias(f"missing_{i}") for i in range(len(uploaded))],
    )
    kept = F.col("key").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return groups.agg(
        total(F.col("rows")).alias("uploaded"),
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in uploaded]),
            F.array(*[total(F.col(f"missing_{i}")) for i in range(len(uploaded))]),
        ).alias("missing_values"),
        total(F.col("blank")).alias("missing_removed"),
        total(F.col("noise")).alias("noise_removed"),
        total(F.when(kept, F.col("rows") - 1)).alias("duplicates_removed"),
        F.count_if(kept & F.col("invalid_rating")).alias("invalid_ratings"),
        F.count_if(kept & F.col("invalid_date")).alias("invalid_dates"),
        F.count_if(kept).alias("valid"),
        F.coalesce(F.avg(F.when(kept, F.col("review_length"))), F.lit(0.0)).alias("average_length"),
        F.count_if(kept & F.col("dated")).alias("dated_reviews"),
    )


def uploaded_columns(upload: DataFrame, row_no: str = "row_no") -> list[str]:
    return [c for c in standardise_columns(upload).columns if c != row_no]
