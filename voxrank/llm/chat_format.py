"""Chat formatting: turns to one string per conversation, and back, in Spark expressions only.

A run of adjacent turns of one role becomes one block::

    <|start|>role<|body|>first text<|next|>second text<|end|>

Inside roles and texts ``&``, ``<`` and ``[`` are written as entities, so no control
string of this or of another common template (``<|...|>``, ``</s>``, ``[INST]``)
can appear there, and reading back restores every character.

Defined cases: a null text or role is the empty string; turns are ordered by
(turn, role, text), nulls first, so repeated turn numbers have one order; repeated
rows are all kept; a null conv_id is one conversation; other columns are ignored;
an empty table gives an empty result.

A conversation's turns are collected as structs, sorted (before anything is escaped), cut where the
role changes, and each run of one role is merged by slicing and joining the array. Offsets are
running sums over stretches of the root of the number of turns, so no array is ever grown
element by element. One conversation is one output string and therefore one row of one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|start|>", "<|body|>", "<|next|>", "<|end|>"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, entity in _ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(_ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _parts(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", "\\|"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: lambdas compute whatever they mention for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def _running(values: Column) -> Column:
    """Running sums of a long array: sums inside short stretches, plus the sums of the stretches before."""
    def inside(part: Column) -> Column:
        return F.transform(part, lambda _, i: _sum(F.slice(part, F.lit(1), i + 1)))

    def shifted(parts: Column) -> Column:
        return _bind(F.transform(parts, lambda p: F.element_at(p, -1)), lambda sums: F.flatten(F.zip_with(
            parts, F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i))), lambda p, before: F.transform(p, lambda x: x + before))))

    def whole(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _bind(F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda at: inside(F.slice(v, at + 1, step))), shifted)

    return _bind(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))


def _spans(pieces: Column) -> Column:
    """(start, end) code point offsets of each piece's text; pieces: array of struct(role, text, first), escaped."""
    def before(piece: Column, number: Column) -> Column:
        opening = F.length(piece["role"]) + F.when(number == 0, len(START + BODY)).otherwise(len(END + START + BODY))
        return F.when(piece["first"], opening).otherwise(len(NEXT))

    def spans(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x, i: (before(x, i) + F.length(x["text"])).cast("long")))
        return F.zip_with(p, ends, lambda x, end: F.struct((end - F.length(x["text"])).alias("start"), end.alias("end")))

    return _bind(pieces, spans)


def _in_loss(pieces: Column, spans: Column, role: Column) -> Column:
    """The spans of the pieces of one role, in order."""
    marked = F.zip_with(pieces, spans, lambda p, s: F.when(p["role"] == role, s))
    return F.filter(marked, lambda s: s.isNotNull())


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the (start, end) code point offsets in ``formatted`` of each
    ``loss_role`` text, in order: the positions that a training loss covers.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column, every: Column) -> Column:
        first = (i == 0) | (t["role"] != F.get(every, i - 1)["role"])
        return F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), first.alias("first"))

    pieces = _bind(F.col("turns"), lambda every: F.transform(every, lambda t, i: piece(t, i, every)))
    cut = ordered.select("conv_id", pieces.alias("pieces"))
    # a run ends where the next one starts
    starts = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.get(F.col("pieces"), i)["first"])
    cut = cut.withColumn("starts", starts).withColumn("spans", _spans(F.col("pieces")))

    def block(start: Column, end: Column, every: Column) -> Column:
        texts = F.transform(F.slice(every, start + 1, end - start), lambda p: p["text"])
        return F.concat(F.lit(START), F.get(every, start)["role"], F.lit(BODY), F.array_join(texts, NEXT), F.lit(END))

    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts") - 1), F.array(F.size("pieces")))
    blocks = _bind(F.col("pieces"), lambda every: F.zip_with(F.col("starts"), ends, lambda a, b: block(a, b, every)))
    return cut.select(
        "conv_id", F.array_join(blocks, "").alias("formatted"),
        _in_loss(F.col("pieces"), F.col("spans"), escape(F.lit(loss_role))).alias("loss_spans"),
    )


def _pieces(formatted: Column) -> Column:
    """The texts in a formatted string with their roles, as written: array of struct(role, text, first)."""
    def of_block(block: Column) -> Column:
        return _bind(_parts(block, BODY), lambda halves: F.transform(_parts(halves[1], NEXT), lambda x, i: F.struct(
            F.substring(halves[0], len(START) + 1, 2**31 - 1).alias("role"), x.alias("text"), (i == 0).alias("first"))))

    blocks = _parts(formatted, END)  # the last part is empty
    return _bind(blocks, lambda b: F.flatten(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), of_block)))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted string: array of struct(role, text), unescaped."""
    return F.transform(_pieces(formatted), lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text")))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    The string is cut at its control strings once, and the pieces whose offsets are in the mask are
    joined; both lists rise, so a sorted merge of starts finds them. A mask that does not
    cover whole texts fails the job.
    """
    def covered(pieces: Column) -> Column:
        placed = F.zip_with(pieces, _spans(pieces), lambda p, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), p["text"].alias("text")))
        # spans sort before the piece that starts and ends with them
        marks = F.transform(loss_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("text")))
        return _bind(F.sort_array(F.concat(placed, marks)), lambda both: F.transform(both, lambda x, i: F.when(
            x["text"].isNotNull() & (i > 0), F.when(
                F.get(both, i - 1)["text"].isNull() & (F.get(both, i - 1)["start"] == x["start"]) & (F.get(both, i - 1)["end"] == x["end"]),
                x["text"]))))

    texts = _bind(covered(_pieces(formatted)), lambda found: F.filter(found, lambda t: t.isNotNull()))
    sound = F.size(texts) == F.size(loss_spans)
    return F.when(sound, F.array_join(F.transform(texts, unescape), "")).otherwise(
        F.raise_error(F.lit("The loss mask does not cover whole texts.")).cast("string"))
