"""Column expressions over review text.

Word characters and white space follow Python's Unicode rules, spelled as
explicit character classes because the JVM's own shorthands differ.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrank import fixed_values as fixed

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

_BYTES_AT_ONCE = 1 << 22  # text in which words are looked for at once
# Code points from here on (rare ideographs) are left to Python.
_TABLE_LIMIT = 0x20000
# Blocks whose signs are spelled out in the JVM: Latin-1, punctuation, letterlike signs, number forms, ligatures.
_SPELLED_BLOCKS = [(0x80, 0x100), (0x2000, 0x2070), (0x2100, 0x2150), (0x2150, 0x2190), (0xFB00, 0xFB07)]


@dataclass(frozen=True)
class CharacterTables:
    """What NFKC and case folding do to single characters.

    ``single`` characters become one other character each, ``spelled`` ones several. ``left``
    are those that need their neighbours (marks and everything that may join what stands
    before it), fold unlike lower case, or become something of that kind.
    """

    single: dict[str, str]
    spelled: dict[str, str]
    left: str


@functools.cache
def character_tables() -> CharacterTables:
    """Worked out from this Python's character database, once a process."""
    joining = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of Hangul syllables
    points = [c for c in range(0x80, _TABLE_LIMIT) if not 0xD800 <= c <= 0xDFFF]
    for c in points:
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joining.add(int(parts[1], 16))

    def alone(c: str) -> bool:
        return (
            not unicodedata.combining(c) and ord(c) not in joining and ord(c) < _TABLE_LIMIT
            and c not in "Σ" and (c.casefold() == c.lower() or c == "ß")  # the final sigma depends on its word
        )

    single, spelled, left = {}, {}, []
    for c in map(chr, points):
        new = unicodedata.normalize("NFKC", c)
        if not all(alone(x) for x in new) or not alone(c) and c == new:
            left.append(c)
        elif new != c and len(new) == 1:
            single[c] = new
        elif new != c:
            if any(low <= ord(c) < high for low, high in _SPELLED_BLOCKS):
                spelled[c] = new
            else:
                left.append(c)
    return CharacterTables(single, spelled, "".join(left))


_NORMALISED = T.StructType([T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


@F.pandas_udf(_NORMALISED)
def _normalise_in_python(texts: pd.Series) -> pd.DataFrame:
    def clean(value):
        return None if value is None else " ".join(unicodedata.normalize("NFKC", value).split())

    cleaned = texts.map(clean, na_action="ignore")
    return pd.DataFrame({"text": cleaned, "key": cleaned.map(str.casefold, na_action="ignore")}, dtype=object)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def fold_case(text: Column) -> Column:
    """Case folding, exact for text that needs no Python (checked by a test)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _has_any(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")) != F.length(text)


def is_special(text: Column) -> Column:
    """Whether NFKC or case folding of ``text`` may need Python.

    Pure ASCII is recognised by its byte count; other texts are checked against the table of
    characters that need more than a look at themselves.
    """
    beyond = text.rlike(r"[\x{20000}-\x{10ffff}\p{Cn}]")  # rare ideographs, and what a newer table may know
    return (F.length(text) != F.octet_length(text)) & (_has_any(text, character_tables().left) | beyond)


def with_normalised(df: DataFrame, source: str, text: str, key: str) -> DataFrame:
    """Add normalised ``text`` and its case-folded duplicate ``key``.

    Spark has no NFKC. Every text goes to Python through Arrow once: mapping characters in
    the JVM from tables takes several times as long.
    """
    raw = F.coalesce(F.col(source).cast("string"), F.lit(""))
    staged = df.withColumn("_python", _normalise_in_python(raw)).drop(source)
    return staged.withColumns({text: F.col("_python.text"), key: F.col("_python.key")}).drop("_python")


def word_count(normalised: Column) -> Column:
    return F.when(normalised == "", F.lit(0)).otherwise(F.size(F.split(normalised, " ")))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def whole_words(patterns: Sequence[str], ignore_case: bool = True) -> str:
    flags = "(?iu)" if ignore_case else ""
    return f"{flags}(?<!{WORD})(?:{'|'.join(patterns)})(?!{WORD})"


def mentions(text: Column, terms: Sequence[str] = fixed.COMMERCIAL_TERMS, ignore_case: bool = True) -> Column:
    """Whether any of ``terms`` occurs as a whole word."""
    return text.rlike(whole_words([re.escape(t) for t in terms], ignore_case))


def makes_forbidden_claim(text: Column) -> Column:
    signs = "".join(re.escape(s) for s in fixed.FORBIDDEN_SIGNS)
    return text.rlike(rf"[\p{{Nd}}{signs}]") | text.rlike(whole_words(fixed.FORBIDDEN_WORDS))


def topic_text(text: Column, sentences: Sequence[str] = fixed.CONTEXT_SENTENCES) -> Column:
    """Text with known context sentences removed; untouched when none occurs.

    One combined test guards the chain of replacements, so the usual row costs
    a single pass of the regex engine.
    """
    if not sentences:
        return text
    stripped = text
    for sentence in sentences:
        stripped = F.regexp_replace(stripped, f"(?iU){sentence}", " ")
    stripped = F.btrim(F.regexp_replace(stripped, SPACE + "+", " "), F.lit(fixed.EDGE_CHARACTERS))
    known = text.rlike("(?iU)" + "|".join(f"(?:{s})" for s in sentences))
    some = bind(stripped, lambda s: F.when(s != "", s))  # worked out once
    return F.when(known, F.coalesce(some, text)).otherwise(text)


def words(text: Column, shortest: int = 2) -> Column:
    """Lower-cased runs of at least ``shortest`` word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}{{{shortest},}})"), F.lit(0))


@functools.cache
def _word_characters(spark: SparkSession) -> bytes:
    """Whether each code point is a word character for the JVM's ``WORD``, as packed bits."""
    points = spark.range(0x110000).where("id < 55296 or id > 57343")
    spelled = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = np.zeros(0x110000, bool)
    known[points.where(spelled.rlike(WORD)).toArrow().column("id").to_numpy()] = True
    return np.packbits(known).tobytes()


def _inside_words(data: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8 text, whether it is part of a word character and whether it opens a character."""
    inside, opens = known[:256][data], (data & 0xC0) != 0x80
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        inside[data >= 0x80] = False
        for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
            at = lead[(data[lead] >= low) & (data[lead] < high)]
            point = (data[at] & (0xFF >> (size + 1))).astype(np.int64)
            for k in range(1, size):
                point = point << 6 | data[at + k] & 0x3F
            at = at[known[point]]
            for k in range(size):
                inside[at + k] = True
    return inside, opens


def _found_words(texts: pa.Array, known: np.ndarray, shortest: int, stops: pa.Array) -> pa.Array:
    """The words of each of the lower-cased ``texts``, joined by spaces; null where a text is null."""
    full = pc.fill_null(texts, "").cast(pa.large_string())
    _, bounds, data = full.buffers()
    bounds = np.frombuffer(bounds, np.int64)[full.offset : full.offset + len(full) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside, opens = _inside_words(data, known)
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[firsts] = False
    after[firsts[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if shortest > 1:
        characters = np.concatenate([[0], np.cumsum(opens)])
        long = characters[ends] - characters[starts] >= shortest
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[long]] = 1
        edge[ends[long]] -= 1
        starts, ends, inside = starts[long], ends[long], np.cumsum(edge[:-1], dtype=np.int8) > 0
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).cast(pa.string())
    if len(stops):
        kept = pc.invert(pc.is_in(words, stops))
        words, starts = words.filter(kept), starts[kept.to_numpy(zero_copy_only=False)]
    ends = pa.array(np.searchsorted(starts, bounds), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, words, mask=texts.is_null()), " ")


def with_words(df: DataFrame, text: str, name: str, stop_words: Sequence[str] = (), shortest: int = 2) -> DataFrame:
    """``df`` with ``words`` of ``text``, without the stop words and joined by single spaces, in the place of ``text``.

    Case is settled in the JVM; words are then found in the bytes of some texts at a time. A word holds
    no space, so the joined words stand for their list and take a fraction of its time to store and read.
    """
    known, stops = df.sparkSession.sparkContext.broadcast(_word_characters(df.sparkSession)), list(stop_words)
    carried = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, dropped = np.unpackbits(np.frombuffer(known.value, np.uint8)).astype(bool), pa.array(stops, pa.string())
        for batch in batches:
            texts = batch.column(len(carried))
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES_AT_ONCE, "right")))
                part = batch.slice(at, to - at)
                found = _found_words(part.column(len(carried)), table, shortest, dropped)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*carried, name])
                at = to

    schema = T.StructType([*[df.schema[c] for c in carried], T.StructField(name, T.StringType())])
    return df.select(*carried, F.lower(text).alias("_text")).mapInArrow(run, schema)


def split_words(joined: Column) -> Column:
    """The list of words that ``with_words`` has joined."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def without(tokens: Column, stop_words: Sequence[str]) -> Column:
    stops = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stops)) if stops else tokens


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once.

    A lambda re-evaluates whatever expression it mentions for every element;
    binding the value to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined_neighbours(left: Column, right: Column, offset: int, separator: str) -> Column:
    pairs = F.greatest(F.size(right) - offset, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), pairs),
        F.slice(right, F.lit(1 + offset), pairs),
        lambda a, b: F.concat(a, F.lit(separator), b),
    )


def with_word_pairs(tokens: Column) -> Column:
    """Single words followed by every pair of neighbouring words."""
    return bind(tokens, lambda t: F.concat(t, _joined_neighbours(t, t, 1, " ")))


def flat_text(text: Column) -> Column:
    """Lower-cased text with white-space runs shortened."""
    return F.regexp_replace(F.lower(text), SPACE + SPACE + "+", " ")


def character_runs(text: Column) -> Column:
    """Every run of one to three characters, white-space runs shortened first."""
    single = F.regexp_extract_all(flat_text(text), F.lit("(?s)(.)"), F.lit(0))
    return bind(single, lambda c: bind(
        _joined_neighbours(c, c, 1, ""), lambda p: F.concat(c, p, _joined_neighbours(p, c, 2, ""))
    ))


def term_counts(tokens: Column) -> Column:
    """Row-local term frequencies: array of (term, tf), by sorting and measuring runs.

    Keeps the counting inside the row, so no shuffle is needed to find how
    often a term occurs in its own text.
    """
    def runs(ordered: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(ordered)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(ordered, a).alias("term"), (b - a).alias("tf")))

    def counted(ordered: Column) -> Column:
        positions = F.filter(F.sequence(F.lit(0), F.size(ordered)), lambda i: i < F.size(ordered))
        first = F.filter(positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bind(first, lambda starts: runs(ordered, starts))

    return bind(F.array_sort(tokens), lambda t: F.when(F.size(t) > 0, counted(t)))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of ``term`` as a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def title_case(text: Column) -> Column:
    """Capitalise every letter run, as Python does: ``4k`` becomes ``4K``."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(pieces, F.initcap), "")


def shorten(text: Column, width: int, mark: str = "…") -> Column:
    """Cut at a word end so that text and mark fit in ``width`` characters."""
    flat = collapse_spaces(text)
    room = width - len(mark)
    cut = F.regexp_extract(flat, rf"^(.{{1,{room}}})(?:(?= )|(?<=\p{{L}}{{2}}-)(?=\p{{L}}-?\p{{L}}))", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(cut), F.lit(mark)))


def spreadsheet_safe(text: Column) -> Column:
    """Prefix a quote to text a spreadsheet would read as a formula."""
    starts = "".join(re.escape(s) for s in fixed.FORMULA_STARTS)
    return F.when(text.rlike(f"^{SPACE}*[{starts}]"), F.concat(F.lit("'"), text)).otherwise(text)
