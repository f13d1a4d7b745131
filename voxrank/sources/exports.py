"""Exports, saved analyses and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrank import fixed_values as fixed
from voxrank.functions.text import spreadsheet_safe

_MANIFEST = "manifest"


def export_safe(df: DataFrame) -> DataFrame:
    """Every text column made safe for spreadsheets; other columns unchanged."""
    return df.select(*[
        spreadsheet_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = True, mode: str = "errorifexists") -> None:
    """Spreadsheet-safe CSV parts; the mark is carried by each part's header."""
    safe = export_safe(df)
    if byte_order_mark:
        safe = safe.withColumnRenamed(safe.columns[0], "﻿" + safe.columns[0])
    safe.write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode=mode,
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, nulls included, text as it is."""
    df.write.json(path, mode=mode, ignoreNullFields=False)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes, for uploads that fit one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table of any size, in one aggregate.

    Row count and the sum of the leading 60 bits of each row's SHA-256; a
    column's presence marker keeps null and empty text apart.
    """
    kinds = dict(df.dtypes)

    def plain(name: str):
        # an instant is hashed as its microseconds: its text depends on the session's zone
        value = F.col(f"`{name}`")
        return F.unix_micros(value) if kinds[name] == "timestamp" else value

    cells = [F.coalesce(F.concat(F.lit("="), plain(c).cast("string")), F.lit("-")) for c in sorted(df.columns)]
    digest = F.sha2(F.concat_ws("\x1f", *cells), 256)
    leading = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(leading), F.lit(0)).cast("string").alias("hash_sum"))


def save_snapshot(folder: str, tables: dict[str, DataFrame], source: DataFrame) -> None:
    """One Parquet table per result plus a manifest tying it to its input.

    The manifest is written last: a folder without one is an unfinished save.
    """
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    manifest = table_fingerprint(source).select(
        F.lit(fixed.SNAPSHOT_VERSION).alias("schema_version"),
        F.concat_ws(":", "rows", "hash_sum").alias("input_fingerprint"),
        F.array(*[F.lit(n) for n in sorted(tables)]).alias("tables"),
    )
    manifest.write.parquet(f"{folder}/{_MANIFEST}")


def load_snapshot(spark: SparkSession, folder: str, source: DataFrame) -> dict[str, DataFrame]:
    """The saved tables, or an error if they belong to another version or input."""
    saved = spark.read.parquet(f"{folder}/{_MANIFEST}").first()
    now = table_fingerprint(source).first()
    if saved.schema_version != fixed.SNAPSHOT_VERSION or saved.input_fingerprint != f"{now['rows']}:{now['hash_sum']}":
        raise ValueError("Saved analysis does not match its input; rebuild it.")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in saved.tables}


def recommendation_export(
    brief: DataFrame, insights: DataFrame, cited: DataFrame, dataset: str, synthetic: Column | bool
) -> DataFrame:
    """One spreadsheet-safe row per recommendation with its cited reviews.

    ``cited`` holds (insight_id, position, review_id, review_text, source) in
    citation order, from ``evidence.cited_reviews``.
    """
    quoted = F.struct(
        "position", "review_id",
        F.concat_ws(": ", "review_id", "review_text").alias("quote"),
        F.coalesce("source", F.lit(fixed.UNAVAILABLE)).alias("origin"),
    )
    per_insight = cited.groupBy("insight_id").agg(F.sort_array(F.collect_list(quoted)).alias("cites"))

    def joined(field: str) -> Column:
        return F.array_join(F.col(f"cites.{field}"), fixed.LIST_SEPARATOR)

    rows = insights.join(per_insight, "insight_id").withColumns({
        "generation_method": brief.select("method").scalar(),
        "executive_summary": brief.select("summary").scalar(),
    })
    synthetic = F.lit(synthetic) if isinstance(synthetic, bool) else synthetic
    return export_safe(rows.select(
        F.lit(dataset).alias("dataset"), synthetic.alias("synthetic_data"), "generation_method", "executive_summary",
        "category", "finding", "evidence", F.col("implication").alias("business_implication"),
        F.col("action").alias("recommended_action"), joined("review_id").alias("review_ids"),
        joined("quote").alias("supporting_reviews"), joined("origin").alias("sources"),
    ))
