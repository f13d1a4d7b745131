"""Check model-written recommendations against the evidence, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions.text import SPACE, bind, makes_forbidden_claim
from voxrank.operators.brief import evidence_sentence
from voxrank.session import materialise

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def without_code_fence(content: Column) -> Column:
    """Drop the first and last line of a fenced block."""
    def inner(lines: Column) -> Column:
        return _strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))

    return bind(_strip(content), lambda bare: F.when(
        F.startswith(bare, F.lit("```")), bind(F.split(bare, _LINE_END), inner)
    ).otherwise(bare))


def strict_json(text: Column) -> Column:
    """The text as a variant, or null unless it is one JSON value and nothing more.

    The parser stops after the first value; wrapping it both as an array and as
    an object leaves no text that could follow it unnoticed.
    """
    def parsed(t: Column) -> Column:
        in_array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        in_object = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))

    return bind(text, parsed)


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _nested(value: Column) -> Column:
    """Whether the value is a JSON array or object."""
    return F.coalesce(_kind(value).rlike("^(ARRAY|OBJECT)"), F.lit(False))


def _text(value: Column) -> Column:
    """The value if it is a JSON string, else null."""
    return bind(value, lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")))


def _list(value: Column) -> Column:
    """The elements if the value is a JSON array, else null."""
    return bind(value, lambda v: F.when(F.startswith(_kind(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")))


def _whole_number(value: Column) -> Column:
    """A JSON whole number (or boolean, which compares as 0 or 1), else null."""
    def whole(v: Column) -> Column:
        number = F.try_variant_get(v, "$", "double")
        return F.when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN)") & (number == F.floor(number)), number.cast("long"))

    return bind(value, whole)


def _item(value: Column) -> Column:
    """One recommendation as typed fields; what has another type is null."""
    def typed(f: Column) -> Column:
        def field(name: str) -> Column:
            return F.element_at(f, F.lit(name))

        return F.struct(
            F.map_keys(f).alias("keys"), _text(field("category")).alias("category"),
            _whole_number(field("topic_id")).alias("topic_id"),
            *[_text(field(name)).alias(name) for name in fixed.PROSE_FIELDS],
            F.transform(_list(field("evidence_review_ids")), _text).alias("review_ids"),
            _nested(field("category")).alias("nested_category"), _nested(field("topic_id")).alias("nested_topic"),
            F.coalesce(F.exists(_list(field("evidence_review_ids")), _nested), F.lit(False)).alias("nested_ids"),
        )

    return bind(_fields(value), typed)


def parse_responses(responses: DataFrame) -> DataFrame:
    """(response_id, missing, valid, keys, summary, items), written once.

    Everything a check needs is typed here in one pass over the contents; the
    checks then read a plain table and never parse again.
    """
    parsed = responses.select(
        "response_id", F.col("content").isNull().alias("missing"),
        strict_json(without_code_fence(F.col("content"))).alias("parsed"),
    ).withColumn("fields", _fields(F.col("parsed")))

    def field(name: str) -> Column:
        return F.element_at("fields", F.lit(name))

    # a bare number, truth value or null, and an array that holds arrays or objects, are not fit for a set of names
    unfit = _kind(F.col("parsed")).rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN|VOID)") | F.coalesce(
        F.exists(_list(F.col("parsed")), _nested), F.lit(False))
    return materialise(parsed.select(
        "response_id", "missing", F.col("parsed").isNotNull().alias("valid"), F.map_keys("fields").alias("keys"), unfit.alias("unfit"),
        _text(field("executive_synthesis")).alias("summary"),
        F.transform(_list(field("recommendations")), _item).alias("items"),
    ), "responses")


def _has_exactly(keys: str, names: list[str]) -> Column:
    return F.coalesce(F.sort_array(F.col(keys)) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def _bounded_prose(name: str, limits: tuple[int, int]) -> Column:
    return F.coalesce(F.length(name).between(*limits) & ~makes_forbidden_claim(F.col(name)), F.lit(False))


def _envelope_reason() -> Column:
    """First fault outside the single recommendations."""
    reasons = fixed.RESPONSE_REASONS
    return (
        F.when(~F.col("valid"), reasons["json"])
        .when(~_has_exactly("keys", fixed.RESPONSE_FIELDS), reasons["fields"])
        .when(~_bounded_prose("summary", fixed.SUMMARY_LENGTH), reasons["summary"])
        .when(F.coalesce(F.size("items"), F.lit(-1)) != fixed.RECOMMENDATION_COUNT, reasons["count"])
    )


def _item_reason() -> Column:
    """First fault of one recommendation, given its topic's allowed ids and the
    categories of all three in order."""
    reasons = fixed.RESPONSE_REASONS
    earlier = F.slice("categories", F.lit(1), F.col("position"))  # positions count from 0
    known = F.coalesce(F.col("category").isin(fixed.BRIEF_CATEGORIES), F.lit(False)) & F.col("allowed").isNotNull()
    repeated = F.coalesce(F.array_contains(earlier, F.col("category")), F.lit(False))
    cites = F.col("review_ids")
    grounded = F.coalesce(
        F.size(cites).between(*fixed.CITATION_COUNT)
        & (F.size(F.array_distinct(cites)) == F.size(cites))
        & (F.size(F.array_except(cites, F.col("allowed"))) == 0),
        F.lit(False),
    )
    reason = F.when(~_has_exactly("keys", fixed.RECOMMENDATION_FIELDS), reasons["item"]).when(~known | repeated, reasons["reference"])
    for name in fixed.PROSE_FIELDS:
        reason = reason.when(~_bounded_prose(name, fixed.PROSE_LENGTH), reasons["claim"] + name)
    return reason.when(~grounded, reasons["citations"])


def _item_error() -> Column:
    """The name of the error that belongs to the fault: nested values where a plain one is looked up are of the wrong type."""
    reasons = fixed.RESPONSE_REASONS
    earlier = F.slice("categories", F.lit(1), F.col("position"))
    category = F.coalesce(F.col("category").isin(fixed.BRIEF_CATEGORIES) & ~F.array_contains(earlier, F.col("category")), F.lit(False))
    looked_up = F.col("nested_category") | (category & F.col("nested_topic"))
    wrong = ((F.col("reason") == reasons["reference"]) & looked_up) | (
        (F.col("reason") == reasons["citations"]) & F.col("nested_ids") & F.size("review_ids").between(*fixed.CITATION_COUNT))
    return F.when(F.col("reason").isNotNull(), F.when(wrong, "TypeError").otherwise("ValueError"))


def checked_recommendations(parsed: DataFrame, pool: DataFrame) -> DataFrame:
    """Every recommendation of the responses that hold three, with its first fault and its error's name, or nulls.

    ``pool`` is (topic_id, review_ids), one row per topic.
    """
    sound = parsed.where(_envelope_reason().isNull()).select(
        "response_id", F.transform("items", lambda i: i["category"]).alias("categories"),
        F.posexplode("items").alias("position", "item"),
    )
    rows = sound.select("response_id", "position", "categories", "item.*")
    allowed = pool.select("topic_id", F.col("review_ids").alias("allowed"))
    return rows.join(allowed, "topic_id", "left").withColumn("reason", _item_reason()).withColumn("error", _item_error())


def validate_responses(parsed: DataFrame, pool: DataFrame) -> DataFrame:
    """(response_id, accepted, reason, error): the first fault found, in reading order, and its error's name."""
    inside = checked_recommendations(parsed, pool).where("reason is not null").groupBy("response_id").agg(
        F.min_by(F.struct("reason", "error"), "position").alias("inner")
    )
    outer = _envelope_reason()
    error = F.when(~F.col("valid"), "JSONDecodeError").when(F.col("unfit"), "TypeError").otherwise("ValueError")
    outside = parsed.select("response_id", outer.alias("outer_reason"), F.when(outer.isNotNull(), error).alias("outer_error"))
    reason, error = F.coalesce("outer_reason", "inner.reason"), F.coalesce("outer_error", "inner.error")
    return outside.join(inside, "response_id", "left").select(
        "response_id", reason.isNull().alias("accepted"), reason.alias("reason"), error.alias("error")
    )


def accepted_insights(parsed: DataFrame, pool: DataFrame, scores: DataFrame) -> DataFrame:
    """The recommendations of accepted responses with measured evidence added."""
    good = validate_responses(parsed, pool).where("accepted").select("response_id")
    topics = scores.agg(F.count("*").alias("n")).scalar()
    return checked_recommendations(parsed, pool).join(good, "response_id").join(scores, "topic_id").select(
        "response_id", F.format_string("L%d", F.col("position") + 1).alias("insight_id"), "category",
        F.col("topic_id").cast("int").alias("topic_id"), "topic",
        F.col("impact_rank").alias("rank"), "finding", evidence_sentence(topics).alias("evidence"),
        F.col("business_implication").alias("implication"), F.col("recommended_action").alias("action"), "review_ids",
    )


def choose_brief(parsed: DataFrame, pool: DataFrame, summary: DataFrame) -> DataFrame:
    """(response_id, summary, method, warning): the response's own, or the fallback."""
    checks = validate_responses(parsed, pool)
    before, after = fixed.FAILED_RESPONSE_WARNING.split("{}")
    warning = (
        F.when(F.col("missing"), fixed.NO_RESPONSE_WARNING)
        .when(~F.col("accepted"), F.concat(F.lit(before), F.col("error"), F.lit(after)))
    )
    return checks.join(parsed.select("response_id", "missing", F.col("summary").alias("written")), "response_id").select(
        "response_id",
        F.when(F.col("accepted"), F.col("written")).otherwise(summary.select("summary").scalar()).alias("summary"),
        F.when(F.col("accepted"), fixed.MODEL_BRIEF_METHOD).otherwise(summary.select("method").scalar()).alias("method"),
        warning.alias("warning"),
    )
