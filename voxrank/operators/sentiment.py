"""Sentiment from a rating, or from a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PythonException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrank import fixed_values as fixed
from voxrank.session import materialise


def rating_label(rating: Column) -> Column:
    return (
        F.when(rating >= 4, "Positive").when(rating <= 2, "Negative").when(rating == 3, "Neutral").otherwise("Unknown")
    )


def from_rating(reviews: DataFrame) -> DataFrame:
    """Ratings as a sentiment proxy; anything between the classes is unknown."""
    label = rating_label(F.col("rating"))
    known = label != "Unknown"
    return reviews.withColumns({
        "sentiment_label": label,
        "sentiment_score": F.when(known, (F.col("rating") - 3) / 2),
        "sentiment_method": F.when(known, "Rating proxy").otherwise("Unavailable"),
    })


def class_positions(class_names: Sequence[str]) -> list[int]:
    """Where negative, neutral and positive sit in a model's output."""
    lowered = [n.lower() for n in class_names]
    named = [fixed.GENERIC_CLASS_NAMES.get(n, n) for n in lowered]
    if not set(fixed.MODEL_CLASSES) <= set(named):
        raise ValueError("Unexpected sentiment labels")
    return [named.index(c) for c in fixed.MODEL_CLASSES]


def from_model(
    reviews: DataFrame, load_model: Callable[[], Callable], class_names: Sequence[str],
    batch_rows: int = fixed.MODEL_BATCH_ROWS,
) -> DataFrame:
    """Class with the highest probability, and P(positive) - P(negative).

    ``load_model`` runs once per Python worker and returns a function from a
    batch of texts to a (rows, classes) array.
    """
    positions = class_positions(class_names)
    predict = predict_batch_udf(load_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_rows)
    scored = reviews.withColumn("_classes", predict("review_text"))
    classes = [F.get("_classes", F.lit(i)) for i in range(len(class_names))]
    negative, _, positive = (classes[i] for i in positions)
    highest = F.greatest(*classes)
    names = [fixed.GENERIC_CLASS_NAMES.get(n.lower(), n.lower()).title() for n in class_names]
    label = F.when(classes[0] == highest, names[0])
    for value, name in zip(classes[1:], names[1:]):
        label = label.when(value == highest, name)
    return scored.withColumns({
        "sentiment_label": label,
        "sentiment_score": positive - negative,
        "sentiment_method": F.lit("Text model"),
    }).drop("_classes")


def analyze_sentiment(
    reviews: DataFrame, load_model: Callable[[], Callable] | None = None,
    class_names: Sequence[str] = tuple(fixed.MODEL_CLASSES),
) -> tuple[DataFrame, dict]:
    """Model sentiment when a model works on the whole table, else ratings.

    Predictions are written once; any failure falls back for every row, so one
    table never mixes the two methods.
    """
    warnings = []
    if load_model is not None:
        try:
            return materialise(from_model(reviews, load_model, class_names), "sentiment"), {
                "method": "Text model", "warnings": warnings,
            }
        except (LookupError, ValueError, PythonException) as error:  # the model's own; a failed job of Spark's is raised
            warnings.append(f"Text sentiment unavailable ({type(error).__name__}); using ratings where valid.")
    return from_rating(reviews), {
        "method": "Rating proxy (missing/ambiguous ratings = Unknown)", "warnings": warnings,
    }
