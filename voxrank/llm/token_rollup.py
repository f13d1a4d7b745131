"""Token counts kept as additive rollups under inserts, deletes and revised counts.

A rollup folder holds, for each batch, the new states of the documents it changed (the
ledger) and the signed differences they make to the totals by source, language and
tokenizer version. The totals are the sum of all committed differences, so a batch
costs its own size and a lookup of its documents in the ledger, never a recount.

A batch takes effect through its commit file, written last. A batch id that is already
committed changes nothing, and an attempt that broke off leaves only folders without a
commit file, which readers skip and the next attempt overwrites. One writer at a time.

Changes have op, doc_id, source, lang and text. ``insert`` adds a document or replaces
the one of that id; ``revise`` replaces it and ``delete`` removes it, both without
effect on an unknown id. Defined cases: if a batch names an id several times, the
greatest of (op, source, lang, text hash) counts, so repeated rows count once; a null
id is one document; a null text has no tokens; null sources and languages are groups;
unknown ops and further columns are ignored; an empty batch commits with no effect.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("source", "lang", "version")
#: Tokenizer versions: the file of byte-pair ranks of each.
VERSIONS = {
    "byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken",
    "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken",
}
#: Fixed value: the public pattern that cuts a text before byte-pair merges in these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STATE = "doc_id long, live boolean, source string, lang string, version string, tokens long, text_hash long"
_encoders: dict[str, object] = {}


def count_tokens(docs: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """``docs`` with ``tokens`` in place of ``text``; the vocabulary travels with the tasks."""
    with open(path or VERSIONS[version], "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("tokens", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if version not in _encoders:  # once in a worker
            import tiktoken

            _encoders[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        encode = _encoders[version].encode_ordinary
        for frame in frames:
            frame["tokens"] = [len(encode(t)) if t else 0 for t in frame.pop("text")]
            yield frame

    return docs.mapInPandas(run, schema)


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        """Ids of the batches in effect, in the order of their commits."""
        files, path = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return [n.split("-", 1)[1] for n in sorted(n for n in names if not n.startswith((".", "_")))]

    def _read(self, table: str, schema: str) -> DataFrame:
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/{batch}").withColumn("batch", F.lit(number))
            for number, batch in enumerate(self.committed())
        ]
        empty = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        for part in parts:
            empty = empty.unionByName(part)
        return empty

    def states(self) -> DataFrame:
        """The documents in effect with their counts."""
        latest = F.max_by(F.struct("live", *KEYS, "tokens", "text_hash"), "batch").alias("s")
        return self._read("ledger", _STATE).groupBy("doc_id").agg(latest).select("doc_id", "s.*").where("live")

    def totals(self) -> DataFrame:
        """documents and tokens by source, language and tokenizer version."""
        sums = self._read("totals", "source string, lang string, version string, documents long, tokens long")
        sums = sums.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def apply(self, batch: str, changes: DataFrame, version: str, path: str | None = None) -> bool:
        """Put a batch into effect; False if it already was."""
        done = self.committed()
        if batch in done:
            return False
        rows = changes.where(F.col("op").isin("insert", "delete", "revise")).select(
            F.col("doc_id").cast("long").alias("doc_id"), "op", "source", "lang",
            F.when(F.col("op") != "delete", F.col("text")).alias("text"))
        # texts are counted where they lie; only the counts are shuffled
        counted = count_tokens(rows.withColumn("text_hash", F.xxhash64("text")), version, path)
        last = counted.groupBy("doc_id").agg(F.max(F.struct("op", "source", "lang", "text_hash", "tokens")).alias("c"))
        old = self.states().select("doc_id", F.struct(*KEYS, "tokens").alias("old")) if done else None
        known = last.select("doc_id", "c.*")
        if old is None:
            known = known.withColumn("old", F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>"))
        else:
            known = known.withColumnRenamed("doc_id", "id").join(old, F.col("id").eqNullSafe(old["doc_id"]), "left").drop("doc_id")
            known = known.withColumnRenamed("id", "doc_id")
        live = F.col("op") != "delete"
        ledger = known.where((F.col("op") == "insert") | F.col("old").isNotNull()).select(
            "doc_id", live.alias("live"), "source", "lang", F.lit(version).alias("version"),
            F.when(live, F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("tokens"), "text_hash", "old")
        ledger.write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch}")
        written = self.spark.read.schema(ledger.schema).parquet(f"{self.folder}/ledger/{batch}")
        gone = written.where("old is not null").select("old.*", F.lit(-1).alias("sign"))
        come = written.where("live").select(*KEYS, "tokens", F.lit(1).alias("sign"))
        signed = gone.unionByName(come).groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        signed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals/{batch}")
        files, path_of = self._files()
        name = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{len(done):09d}-{batch}")
        files.create(name, False).close()
        return True
