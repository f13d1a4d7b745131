"""CSV with line breaks inside quotes, read by many tasks per file.

Whether a line starts inside quotes depends on all lines before it. Seen from a block of
lines there are two cases, so each block is first scanned for both: where it would end if it began
outside, and where if it began inside quotes. Such a block either ends alike in both cases, or
keeps its case, or turns it; running over the blocks of a file (one row each) gives the true
case of every block. A second scan then cuts the blocks into records, and only the records
that cross a block border are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise

MOST_BLOCKS = 1_000_000  # input blocks whose cases are broadcast; 100 TB has about 800,000
_IN_QUOTES = re.compile(r'(?:[^"]|"")*+')
_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line break after ``line`` stands inside quotes, given whether the one before did.

    A field is quoted if it opens with a quote. A single quote ends it, even if other
    characters than a comma follow; a quote inside an unquoted field means nothing.
    """
    at = 0
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            at = _IN_QUOTES.match(line, at).end()
            if at == len(line):
                return True
            at, inside = at + 1, False
        at = line.find(",", at) + 1
        if at == 0:
            return False
        if line.startswith('"', at):
            inside, at = True, at + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    scan = spark.read.text(path, lineSep="\n")
    return scan.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of a batch that come from one block."""
    names, blocks = batch.column("_file"), batch.column("_block").to_pylist()
    at = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or blocks[i] != blocks[at] or names[i] != names[at]:
            yield names[at].as_py(), blocks[at], batch.slice(at, i - at)
            at = i


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its end if it began outside quotes, and if it began inside; whether its first line ends in ``\\r``."""
    here, ends, returns = None, (False, True), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "_file": [here[0]], "_block": [here[1]], "outside": [ends[0]], "inside": [ends[1]], "returns": [returns]})

    for batch in batches:
        for name, block, part in _runs(batch):
            if here != (name, block):
                if here is not None:
                    yield row()
                here, ends = (name, block), (False, True)
                returns = part.column("value")[0].as_py().endswith("\r")
            quoted = part.filter(pc.match_substring(part.column("value"), '"'))
            for line in quoted.column("value").to_pylist():
                ends = (ends_inside(line, ends[0]), ends_inside(line, ends[1]))
    if here is not None:
        yield row()


def block_cases(blocks: DataFrame) -> DataFrame:
    """(_file, _block, starts_inside, returns) from each block's two ends, by one running pass a file.

    ``returns`` tells whether the lines of the file end in ``\\r\\n``, as its first one does.
    """
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(
        Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    settled = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("end"), F.col("turns").alias("turns")))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("settled", ignorenulls=True).over(before)
    earlier = F.coalesce(F.lag("turns").over(Window.partitionBy("_file").orderBy("_block")), F.lit(0))
    rows = blocks.withColumn("turns", turns).withColumn("settled", settled).withColumns({"known": known, "earlier": earlier})
    starts = (F.coalesce(F.col("known.end"), F.lit(0)) + F.col("earlier") - F.coalesce(F.col("known.turns"), F.lit(0))) % 2 == 1
    returns = F.max(F.col("returns") & (F.col("_block") == 0)).over(Window.partitionBy("_file"))
    return rows.select("_file", "_block", starts.alias("starts_inside"), returns.alias("returns"))


_PIECE = "_file string, _block long, place long, kind string, record string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block: whole ones, and the parts of those that cross its borders.

    ``place`` numbers the records that start in the block; the first record of a file is its
    heading, and empty lines between records are none. A line's ``\\r`` goes with its ``\\n`` at the
    end of a record, and everywhere in a file whose lines end so.
    """
    here, held, state, place, returns = None, [], "", 0, False
    out: list[tuple] = []

    def close(kind: str) -> None:
        nonlocal place
        text = "\n".join(held)
        held.clear()
        if kind in ("whole", "head"):
            text = text.removesuffix("\r") if kind == "whole" else text
            if kind == "whole" and not text:
                return
            if here[1] == 0 and place == 0:
                place = 1
                if kind == "head":
                    out.append((*here, 0, "heading", text))
                return
            out.append((*here, place, kind, text))
            place += 1
        else:
            out.append((*here, 0, kind, text.removesuffix("\r") if kind == "tail" else text))

    def end_block() -> None:
        if held:
            close("head" if state == "open" else "middle")

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("_file", "_block", "place", "kind", "record")
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for name, block, part in _runs(batch):
            if here != (name, block):
                if here is not None:
                    end_block()
                starts = part.column("starts_inside")[0].as_py()
                if starts is None:
                    raise ValueError(f"No case for a block of {name}: the file changed while it was read.")
                here, place, state = (name, block), 0, "carried" if starts else "closed"
                returns = part.column("returns")[0].as_py()
            for line in part.column("value").to_pylist():
                inside = ends_inside(line, state != "closed") if '"' in line else state != "closed"
                held.append(line.removesuffix("\r") if returns else line)
                if inside:
                    state = "open" if state == "closed" else state
                else:
                    close("tail" if state == "carried" else "whole")
                    state = "closed"
        yield rows()
    if here is not None:
        end_block()
        yield rows()


def _put_together(pieces: DataFrame) -> DataFrame:
    """The records that cross blocks: at most two parts a block are gathered by file."""
    order = Window.partitionBy("_file").orderBy("_block", F.col("kind") != "tail")
    numbered = pieces.withColumn("number", F.sum(F.col("kind").isin("head", "heading").cast("long")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("kind").isin("head", "heading"), F.struct("_block", "place", "kind")))
    texts = F.sort_array(F.collect_list(F.struct("_block", "record")))
    whole = numbered.groupBy("_file", "number").agg(first.alias("start"), F.array_join(F.transform(texts, lambda x: x["record"]), "\n").alias("record"))
    return whole.where("start.kind = 'head'").select("_file", "start._block", "start.place", "record")


def _value(record: Column, names: list[str]) -> Column:
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    return F.from_csv(record, fields, {k: v for k, v in _OPTIONS.items() if k != "header"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a heading each, all columns as text, with ``_file``, ``_block`` and ``_seen``.

    ``_seen`` counts the rows that start in a block. Lines end in ``\\n`` or ``\\r\\n``. The text is
    scanned twice and never shuffled, but for the parts of records that cross a block border.
    """
    names = spark.read.csv(path, **_OPTIONS).columns  # reads the first record only
    lines = _lines(spark, path)
    blocks = materialise(lines.mapInArrow(_scan, "_file string, _block long, outside boolean, inside boolean, returns boolean"), "csv-blocks")
    cases = materialise(block_cases(blocks), "csv-cases")
    cased = lines.join(counted_broadcast(cases, MOST_BLOCKS), ["_file", "_block"], "left").select("_file", "_block", "value", "starts_inside", "returns")
    pieces = materialise(cased.mapInArrow(_cut, _PIECE), "csv-records")
    whole = pieces.where("kind = 'whole'").select("_file", "_block", "place", "record")
    crossing = _put_together(pieces.where("kind <> 'whole'"))
    rows = whole.unionByName(crossing)
    # a byte order mark stands in the heading, which is not among the rows
    parsed = rows.withColumn("_row", _value(F.col("record"), names))
    named = [F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)]
    return parsed.select(*named, "_file", "_block", F.col("place").alias("_seen"))
