"""The training-data pipeline: documents through five operators, each stage written before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. The
first four return rows with the columns of documents; the last returns the encoded
documents. Stages may be run one by one, as each depends on its input tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxrank.llm import chosen_path, latent_decontam, line_suffixes, piece_lattice, quality_rules
from voxrank.session import import_on_workers, materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the admitted cutoffs keep."""
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one may be left empty."""
    return line_suffixes.dedup_lines(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return chosen_path.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return latent_decontam.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, score and further segmentations, with the text decoded from the ids."""
    return piece_lattice.round_trip(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]

#: The stages' choices (binomial cutoffs, sampled splits, a latent space, a lattice) are not SQL;
#: tests/llm checks ids, columns and unchanged rows of each stage, not which rows are kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs, f"pipeline-{number}")
    return docs
