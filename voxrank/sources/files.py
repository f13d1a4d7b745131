"""Reading review files and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise
from voxrank.sources.records import read_records

_MOST_BLOCKS = 1_000_000  # input blocks whose offsets are broadcast; 100 TB has about 800,000


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text; quotes doubled inside quoted fields.

    ``multi_line`` allows line breaks inside quotes but makes each file one
    task; ``records.read_records`` reads such files in parallel.
    """
    return spark.read.csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def missing_as_null(df: DataFrame, tokens: Sequence[str] = fixed.MISSING_TOKENS) -> DataFrame:
    """Turn the usual spellings of a missing value into null, in text columns."""
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[
        F.when(~F.col(f"`{n}`").isin(list(tokens)), F.col(f"`{n}`")).alias(n) if n in texts else F.col(f"`{n}`")
        for n in df.columns
    ])


def blanks_kept(df: DataFrame) -> DataFrame:
    """Empty fields as empty text, the way label files are read."""
    return df.na.fill("")


def with_row_numbers(scan: DataFrame, name: str = "row_no") -> DataFrame:
    """Add 0-based row numbers in (file path, position) order to a file scan.

    The scan is written once with each row's file, block and place, because a
    second scan may cut the files into other blocks. Only one row per input
    block passes through a single task: blocks are counted, the counts become
    running offsets, and each row adds its position inside its block. The
    offsets are broadcast up to a counted size, so the rows themselves are not
    shuffled; a row without an offset fails the job. Must be applied directly
    to a scan.
    """
    return _numbered(materialise(scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    ), "upload"), name)


def _numbered(located: DataFrame, name: str) -> DataFrame:
    blocks = located.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_seen").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    lost = F.raise_error(F.concat(F.lit("No row offset for a block of "), F.col("_file"))).cast("long")
    return (
        located.join(counted_broadcast(materialise(offsets, "blocks"), _MOST_BLOCKS), ["_file", "_block"], "left")
        .withColumn(name, F.coalesce("_offset", lost) + F.col("_seen") - F.col("_first"))
        .drop("_file", "_block", "_seen", "_first", "_offset")
    )


def _read_numbered(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    if multi_line:
        return _numbered(materialise(read_records(spark, path), "upload"), "row_no")
    return with_row_numbers(read_csv(spark, path, multi_line=False))


def read_reviews(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A review upload: text columns, missing tokens as null, rows numbered.

    With ``multi_line`` (line breaks inside quotes) large files still are read by many tasks.
    """
    return missing_as_null(_read_numbered(spark, path, multi_line))


def read_validation(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A hand-labelled sample: blanks stay blanks."""
    return blanks_kept(_read_numbered(spark, path, multi_line))


def label_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """(label, display) rows of a label map held by the caller."""
    return spark.createDataFrame(list(mapping.items()), "label string, display string")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, display) rows of a JSON object file."""
    content = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,string>"))
    return content.select(pairs.alias("label", "display"))
