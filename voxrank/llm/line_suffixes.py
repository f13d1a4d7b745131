"""Line dedup: repeated runs of lines found by a suffix array over line ids.

The corpus is a sequence of lines (lines without a word are passed over and always
kept). Suffixes end with their document. A run of lines that also occurs earlier, in
the order of doc_id and line, and has at least ``MIN_WORDS`` words is a later copy and
is deleted; the first copy of everything stays.

1. Only documents with a stretch of at least ``MIN_WORDS`` words that occurs twice can
   hold such a run; a hash of the shortest stretch from each line on finds them.
2. Prefix doubling: a line's rank is the number of suffixes that sort before its group,
   suffixes with the same first 2**k lines. The ranks of a line and of the one 2**k
   lines on give its rank for 2**(k+1) lines. Groups are counted as (rank, next rank)
   pairs before they are ordered, so a frequent line is a few counted rows. Groups of
   one, and groups that end with their documents, are final and no longer touched.
3. Neighbours in the suffix array that share a stretch get their longest common prefix
   from their documents' line ids. In these chains the longest-common-prefix intervals
   give for each suffix the longest prefix it shares with an earlier one. Equal
   suffixes stand as one, by their first.
4. The lines so covered are cut out of the texts.

Defined cases: a null text stays null, an empty one empty; rows repeated whole (id and
text) are one document and get the same result; a null doc_id comes first; documents
that share an id are ordered by the hash of their text; other columns pass through,
with ``n_chars`` counted anew; an empty table gives an empty result. One chain holds
the different continuations of one repeated stretch, 40 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrank.llm import textbytes as tb
from voxrank.llm.chosen_path import bloom, groups, in_bloom
from voxrank.session import materialise

MIN_WORDS = 50
_PLACE = ["doc_id", "text_hash", "line"]


def _doc_key() -> Column:
    return F.xxhash64("doc_id", F.xxhash64("text"))


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """doc (a key of id and text), doc_id, text_hash, line (from 0), id, lines (of the text) and stretch.

    ``stretch`` is a hash of the shortest run of min_words from the line on, null if the text ends before.
    """
    rows = docs.where("text is not null").select(_doc_key().alias("doc"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = f"doc long, doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, line int, id long, lines int, stretch long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tb.chunks(batches):
            starts, ends, _ = tb.tokens(data, offsets, tb.NEWLINE)
            words = tb.tokens(data, offsets)[0]
            count = np.searchsorted(words, ends) - np.searchsorted(words, starts)
            some = count > 0
            starts, ends, count = starts[some], ends[some], count[some]
            ids = tb.token_hashes(data, starts, ends)
            bounds = np.searchsorted(starts, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            total = np.concatenate([[0], np.cumsum(count)])
            stop = np.searchsorted(total, total[:-1] + min_words)
            inside = stop <= bounds[1:][row]
            stretch = np.zeros(len(ids), np.int64)
            at = np.flatnonzero(inside)
            stretch[at] = tb.range_hashes(ids, at, stop[at]).view(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(take), part.column("doc_id").take(take), part.column("text_hash").take(take),
                 pa.array((np.arange(len(ids)) - bounds[:-1][row]).astype(np.int32)), pa.array(ids.view(np.int64)),
                 pa.array(np.diff(bounds)[row].astype(np.int32)), pa.array(stretch, mask=~inside)],
                names=["doc", "doc_id", "text_hash", "line", "id", "lines", "stretch"])

    return rows.mapInArrow(run, schema)


def suffix_ranks(lines: DataFrame) -> DataFrame:
    """doc, line and rank: the number of suffixes that sort before those equal to the line's. ``lines``: doc, line, id."""
    sizes = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.shiftright("id", 52))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # 4,096 rows at most
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    first = sizes.withColumn("inside", before(Window.partitionBy("part").orderBy("id"))).join(F.broadcast(parts), "part")
    first = first.select("id", (F.col("base") + F.col("inside")).alias("rank"), (F.col("n") > 1).alias("open"))
    now = materialise(lines.join(first, "id").select("doc", "line", "rank", "open", (~F.col("open")).alias("closes")), "suffix-ranks")
    closed, step = [], 1
    while True:
        closed.append(now.where("closes").select("doc", "line", "rank"))
        if now.where("open").isEmpty():
            break
        whole = Window.partitionBy("doc")
        paired = now.select("doc", "line", "rank", "open").withColumns({
            "next": F.coalesce(F.max("rank").over(whole.orderBy("line").rangeBetween(step, step)), F.lit(-1).cast("long")),
            "alive": F.max("open").over(whole)}).where("alive")  # a document without open lines is done
        pairs = paired.where("open").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))
        pairs = pairs.withColumn("smaller", before(Window.partitionBy("rank").orderBy("next"))).select(
            "rank", "next", (F.col("rank") + F.col("smaller")).alias("new_rank"),
            ((F.col("n") > 1) & (F.col("next") >= 0)).alias("still"))
        moved = paired.where("open").join(pairs, ["rank", "next"]).select(
            "doc", "line", F.col("new_rank").alias("rank"), F.col("still").alias("open"), (~F.col("still")).alias("closes"))
        fixed = paired.where("not open").select("doc", "line", "rank", "open", F.lit(False).alias("closes"))
        now, step = materialise(moved.unionByName(fixed), "suffix-ranks"), step * 2
    ranks = closed[0]
    for part in closed[1:]:
        ranks = ranks.unionByName(part)
    return ranks


def _prefix_lengths(a: np.ndarray, b: np.ndarray, pairs: list) -> list[int]:
    """Common prefix lengths of the suffixes of two line sequences; on one diagonal each line is compared once."""
    out, order = [0] * len(pairs), sorted(range(len(pairs)), key=lambda k: (pairs[k][0] - pairs[k][1], pairs[k][0]))
    diagonal, end = None, -1
    for k in order:
        i, j = pairs[k]
        if diagonal != i - j or end < i:
            diagonal, end = i - j, i
        size = min(len(a) - end, len(b) - (end - diagonal))
        while size > 0:
            block = min(size, 256)
            differ = np.flatnonzero(a[end : end + block] != b[end - diagonal : end - diagonal + block])
            if len(differ):
                end += int(differ[0])
                break
            end += block
            size -= block
        out[k] = end - i
    return out


def _longest_earlier(places: list[tuple], common: list[int]) -> list[int]:
    """For suffixes in sorted order, with common[k] lines shared by k-1 and k, the longest prefix each shares with an earlier place."""
    out, stack = [0] * len(places), []
    for k in range(len(places) + 1):
        shared = common[k] if 0 < k < len(places) else 0
        # stack: (place, lines shared with the suffix below it), places rising
        while stack and (k == len(places) or places[stack[-1][0]] > places[k]):
            at, below = stack.pop()
            out[at] = max(below, shared)
            shared = min(below, shared)
        if k < len(places):
            stack.append((k, shared))
    return out


def repeated_runs(lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc, low and high: line ranges that also occur earlier, with a repeated stretch."""
    place = F.struct(*_PLACE)
    twice = lines.where("stretch is not null").drop("id")
    often = twice.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stretch")
    twice = twice.join(often, "stretch", "left_semi").join(ranks, ["doc", "line"])
    twice = materialise(twice, "suffixes")
    classes = twice.groupBy("stretch", "rank").agg(F.min(F.struct(*_PLACE, "doc")).alias("p"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.select("stretch", "rank", "p.*", "n"), "suffix-classes")
    # equal suffixes: all but the first are copies to the end of their documents
    firsts = classes.where("n > 1").select("rank", "stretch", F.col("doc").alias("d"), F.col("line").alias("l"))
    copies = twice.join(firsts, ["rank", "stretch"]).where("doc <> d or line <> l").select(
        "doc", F.col("line").alias("low"), F.col("lines").alias("high"))
    chain = Window.partitionBy("stretch").orderBy("rank")
    near = classes.drop("n").withColumn("prev", F.lag(F.struct("doc", "line")).over(chain))
    near = materialise(near, "suffix-neighbours")
    by_docs = near.where("prev is not null").groupBy("doc", F.col("prev.doc").alias("other")).agg(
        F.collect_list(F.struct("line", F.col("prev.line").alias("prev_line"), "stretch", "rank")).alias("pairs"))
    ids = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "id"))).alias("s")).select(
        "doc", F.transform("s", lambda x: x["id"]).alias("ids"))
    both = by_docs.join(ids, "doc").join(ids.toDF("other", "other_ids"), "other")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretch, rank, common = [], [], []
            for k in range(batch.num_rows):
                pairs = batch.column("pairs")[k].as_py()
                a, b = (np.asarray(batch.column(c)[k].values) for c in ("ids", "other_ids"))
                stretch += [p["stretch"] for p in pairs]
                rank += [p["rank"] for p in pairs]
                common += _prefix_lengths(a, b, [(p["line"], p["prev_line"]) for p in pairs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(stretch, pa.int64()), pa.array(rank, pa.int64()), pa.array(common, pa.int32())],
                names=["stretch", "rank", "common"])

    common = both.select("pairs", "ids", "other_ids").mapInArrow(measure, "stretch long, rank long, common int")
    chained = near.drop("prev").join(common, ["stretch", "rank"], "left")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["stretch"]):
            key = np.asarray(batch.column("stretch"))
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            doc, hashed, line = (batch.column(c).to_pylist() for c in _PLACE)
            places = [(d is not None, d if d is not None else 0, h, at) for d, h, at in zip(doc, hashed, line, strict=True)]
            shared = [c or 0 for c in batch.column("common").to_pylist()]
            longest = np.concatenate([_longest_earlier(places[a:b], shared[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            at = pa.array(np.flatnonzero(longest))
            low = np.asarray(batch.column("line"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(at), pa.array(low).take(at), pa.array((low + longest).astype(np.int32)).take(at)],
                names=["doc", "low", "high"])

    runs = chained.repartition("stretch").sortWithinPartitions("stretch", "rank").mapInArrow(
        intervals, "doc long, low int, high int")
    return runs.unionByName(copies)


def _without(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """The texts without the lines in their runs, with the numbers of their lines and of those removed."""
    out = []
    for t, some in zip(text, runs, strict=True):
        if t is None or some is None:
            out.append((None, None, None))
            continue
        kept, at, removed = [], 0, 0
        ends = sorted((r["low"], r["high"]) for r in some)
        cut, k = 0, 0  # lines below cut are in a run
        for line in t.split("\n"):
            if not line.strip(" \t\n\v\f\r"):
                kept.append(line)
                continue
            while k < len(ends) and ends[k][0] <= at:
                cut, k = max(cut, ends[k][1]), k + 1
            if at < cut:
                removed += 1
            else:
                kept.append(line)
            at += 1
        out.append(("\n".join(kept), at, removed))
    return pd.DataFrame(out, columns=["text", "lines", "removed"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies of repeated line runs, with ``removed_lines``."""
    lines = materialise(line_table(docs, min_words), "lines")
    often = lines.where("stretch is not null").groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stretch")
    holders = lines.select("doc", "stretch").join(often, "stretch", "left_semi").select("doc").distinct()
    mine = materialise(lines.join(holders, "doc", "left_semi").dropDuplicates(["doc", "line"]), "shared-lines")
    runs = repeated_runs(mine, suffix_ranks(mine.select("doc", "line", "id"))).groupBy("doc").agg(
        F.collect_set(F.struct("low", "high")).alias("_runs"))
    runs = materialise(runs.withColumnRenamed("doc", "_doc"), "line-runs")
    # only texts that pass a bit set of bounded size are shuffled to the runs
    table, words = bloom(runs.select("_doc"))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_have_runs(doc: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(doc.to_numpy(np.int64), sent.value, words))

    rows = docs.withColumn("_doc", _doc_key())
    rows = rows.withColumn("_may", may_have_runs("_doc"))
    found = rows.where("_may").join(runs, "_doc", "left")
    without = F.pandas_udf(_without, "struct<text:string,lines:int,removed:int>")
    found = found.withColumn("_new", without(F.when(F.col("_runs").isNotNull(), F.col("text")), "_runs"))
    text = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.col("_new.text"))
    columns = {"text": text, "removed_lines": F.coalesce("_new.removed", F.lit(0))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_runs").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    found = found.withColumns(columns).select(*docs.columns, "removed_lines")
    rest = rows.where("not _may").withColumn("removed_lines", F.lit(0)).select(*docs.columns, "removed_lines")
    return found.unionByName(rest)
