"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrank.llm import (
    chat_format, chosen_path, hard_negatives, importance_sampling, kd_shards, latent_decontam, line_suffixes,
    piece_lattice, quality_rules, source_audit, source_mixing, string_kernel, token_rollup,
)
from voxrank.llm.check_sql import CHECKS  # noqa: F401
from voxrank.session import import_on_workers, scratch_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    import_on_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return string_kernel.score(docs, string_kernel.train(docs, _table(spark, folder, "labels")))


def op2_importance_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_sampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_latent_decontam(spark: SparkSession, folder: str) -> DataFrame:
    return latent_decontam.scan(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_piece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, folder, "documents").select(
        "doc_id", "text", F.crc32(text.cast("binary")).alias("text_crc32"), F.length(text).alias("chars"))
    kept = ("doc_id", "text_crc32", "chars")
    encoded = piece_lattice.encode(docs, keep=kept)
    more = (
        F.size("ids").alias("n_pieces"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.round("score", 6).alias("score"),
        F.transform("nbest", lambda x: F.round(x["score"], 6)).alias("other_scores"),
    )
    ready = encoded.select(*kept, "ids", *more)
    back = piece_lattice.decode(ready, keep=(*kept, "n_pieces", "ids_crc32", "score", "other_scores"))
    same = F.crc32(text.cast("binary")).eqNullSafe(F.col("text_crc32")) & F.length(text).eqNullSafe(F.col("chars"))
    return back.select("doc_id", "n_pieces", "ids_crc32", "score", "other_scores", same.alias("round_trip"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels")).drop("stratum")


def op6_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.join(_table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_text_links")


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = chat_format.format_chats(turns)
    back = chats.select(
        "conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = kd_shards.assign_shards(_table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"), "split_group",
    )


def op9_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents go in; later copies of equal texts go out; texts in other languages move to a second tokenizer."""
    docs = _table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.TokenRollup(spark, f"{scratch_folder(spark)}/voxrank/rollup-{uuid.uuid4().hex}")
    first, second = token_rollup.VERSIONS
    rollup.apply("all", docs.withColumn("op", F.lit("insert")), first)
    states = rollup.states()
    kept = states.groupBy("text_hash").agg(F.min("doc_id").alias("kept"))
    copies = states.join(kept, "text_hash").where("doc_id > kept").select(
        "doc_id", F.lit("delete").alias("op"), "source", "lang", F.lit(None).cast("string").alias("text"))
    rollup.apply("copies", copies, first)
    rollup.apply("other-languages", docs.where("lang <> 'en'").withColumn("op", F.lit("revise")), second)
    rollup.apply("copies", copies, first)  # sent again: no effect
    return rollup.totals().select(
        "source", "lang", F.col("version").alias("tokenizer_version"), F.col("documents").alias("n_docs"),
        F.col("tokens").alias("n_tokens"))


def op10_line_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_suffixes.dedup_lines(_table(spark, folder, "documents"))
    return kept.select(
        "doc_id", F.col("removed_lines").cast("long").alias("removed_lines"),
        F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mixing.balance(_table(spark, folder, "documents"))


def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    moved = rows.withColumn("label", hard_negatives.relabelled(F.col("label"), F.col("vec_id")))
    return hard_negatives.Miner(hard_negatives.whole_vectors(moved)).mine()


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # a file of the repository's top, beside the package

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_string_kernel": op1_string_kernel, "op2_importance_sampling": op2_importance_sampling, "op3_latent_decontam": op3_latent_decontam,
    "op4_piece_lattice": op4_piece_lattice, "op5_quality_rules": op5_quality_rules, "op6_chosen_path": op6_chosen_path,
    "op7_chat_format": op7_chat_format, "op8_kd_shards": op8_kd_shards,
    "op9_token_rollup": op9_token_rollup, "op10_line_suffixes": op10_line_suffixes,
    "op11_entropy_mix": op11_entropy_mix, "op12_source_audit": op12_source_audit, "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}
