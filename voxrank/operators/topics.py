"""Group reviews into topics and describe the groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PythonException
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrank import fixed_values as fixed
from voxrank.functions import text as tx
from voxrank.operators import density, late, lexical
from voxrank.operators.clean import review_id
from voxrank.operators.kmeans import fit
from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise


@dataclass
class Topics:
    """Reviews with topic_text, topic_id and topic; one row per topic; how they were found."""

    reviews: DataFrame
    topics: DataFrame
    method: str
    warnings: list[str]


def cluster_count(rows: Column, distinct_texts: Column) -> Column:
    """The number of clusters for so many rows and different texts."""
    size = F.lit(fixed.LARGEST_CLUSTER_COUNT)
    for limit, count in reversed(fixed.CLUSTER_POLICY):
        size = F.when(rows < limit, count).otherwise(size)
    return F.least(size, rows, F.greatest(F.lit(1), distinct_texts))


def unit_length(embedding: str) -> Column:
    vector = F.col(embedding).cast("array<double>")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return tx.bind(length, lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector))


def embed(reviews: DataFrame, load_model: Callable[[], Callable], text: str = "topic_text", batch_rows: int = 32) -> DataFrame:
    """Add a unit-length ``embedding`` from the caller's model, loaded once per worker."""
    predict = predict_batch_udf(load_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_rows)
    return reviews.withColumn("_raw", predict(text)).withColumn("embedding", unit_length("_raw")).drop("_raw")


Placing = Callable[[DataFrame], DataFrame]


def kmeans(
    vectors: DataFrame, k: int, seed: int = fixed.CLUSTER_SEED, restarts: int = fixed.CLUSTER_RESTARTS,
    iterations: int = fixed.CLUSTER_ITERATIONS,
) -> Placing:
    """The cheapest of several seeded runs over ``features``: adds the topic_id of rows with ``features``.

    All runs share their passes over the vectors, which are read from a stored table.
    """
    if k == 1:
        return lambda rows: rows.withColumn("topic_id", F.lit(0))
    return fit(vectors, k, [seed + run for run in range(restarts)], iterations).place


def _sizes(reviews: DataFrame) -> tuple[int, int]:
    """Rows, and the number of clusters that the policy gives them.

    Different texts are counted only as far as the policy needs.
    """
    texts = reviews.select(F.xxhash64("topic_text").alias("h"), F.sha2("topic_text", 256).alias("s")).distinct()
    distinct = texts.limit(fixed.LARGEST_CLUSTER_COUNT).agg(F.count("*").alias("n")).scalar()
    row = reviews.agg(F.count("*").alias("rows")).select("rows", cluster_count(F.col("rows"), distinct).alias("k")).first()
    return row.rows, row.k


def discover_topics(
    reviews: DataFrame, mode: str = "auto", load_embedding_model: Callable[[], Callable] | None = None,
    embedding: str | None = None, stop_words: Sequence[str] | None = None,
    sentences: Sequence[str] = fixed.CONTEXT_SENTENCES, restarts: int = fixed.CLUSTER_RESTARTS,
    clusters: int | None = None, smallest_topic: int | None = None, iterations: int = fixed.CLUSTER_ITERATIONS,
) -> Topics:
    """Topics by density (``auto``), k-means on embeddings, or k-means on words.

    Embeddings come from the caller's model or from a column. Every step down
    is recorded as a warning. Keywords always use the words. ``clusters`` and
    ``smallest_topic`` set the number of k-means topics and the least size of a
    density topic; by default both follow the number of rows.
    """
    spaced = reviews.drop("topic_id", "topic").withColumn("topic_text", tx.topic_text(F.col("review_text"), sentences))
    if embedding is not None and mode != "offline":
        spaced = spaced.withColumn(EMBEDDING, unit_length(embedding))
    spaced = late.stored(spaced, "topic_text")
    rows, policy = _sizes(spaced)
    if rows == 0:
        raise ValueError("No valid reviews remain. Upload reviews containing text.")
    warnings: list[str] = []
    words = lexical.lexical_features(spaced, stop_words)
    embedded = _embedded(spaced, mode, load_embedding_model, warnings)
    narrow = None if embedded is None else embedded.select("row_no", F.col(EMBEDDING).alias("embedding"))
    assigned, method = None, "TF-IDF + KMeans (lexical fallback)"
    if embedded is not None and mode == "auto" and rows >= fixed.DENSITY_MINIMUM_ROWS:
        found = density.density_topics(narrow, smallest_topic or density.minimum_topic_size(rows))
        if found.where("topic_id <> -1").select("topic_id").distinct().limit(2).count() < 2:
            warnings.append("Density topics unavailable or degenerate; using embedding KMeans.")
        else:
            method = "Embeddings + density topics"
            assigned = embedded.select("row_no", late.PLACE).join(found, "row_no")
    if assigned is None:
        vectors = words.vectors
        if embedded is not None:
            vectors = materialise(embedded.select("row_no", late.PLACE, array_to_vector(EMBEDDING).alias("features")), "vectors")
            method = "Embeddings + KMeans"
        assigned = kmeans(vectors, clusters or policy, restarts=restarts, iterations=iterations)(vectors)
    assigned = materialise(assigned.select("row_no", late.PLACE, "topic_id"), "assigned")
    placed = late.with_value(spaced if embedded is None else embedded, assigned.drop("row_no"), "topic_id")
    placed = materialise(placed.drop(late.PLACE, EMBEDDING), "placed")
    described = describe(assigned.drop(late.PLACE), words, narrow)
    labelled = placed.join(counted_broadcast(described.select("topic_id", F.col("label").alias("topic"))), "topic_id", "left")
    return Topics(labelled, described, method, warnings)


EMBEDDING = "_embedding"


def _embedded(spaced, mode, load_model, warnings) -> DataFrame | None:
    """The stored rows with their unit embedding beside the text, or null with a warning."""
    if mode == "offline":
        return None
    try:
        if EMBEDDING in spaced.columns:
            return spaced
        if load_model is None:
            raise LookupError("no embedding model")
        return materialise(embed(spaced, load_model).withColumnRenamed("embedding", EMBEDDING), "embeddings")
    except (LookupError, PythonException) as error:  # the model's own; a failed job of Spark's is raised
        warnings.append(f"Semantic model unavailable ({type(error).__name__}); using lexical TF-IDF.")
        return None


def listed_ids(nearest: DataFrame) -> DataFrame:
    """(topic_id, representative_ids) in order; ids follow from row numbers."""
    row = F.struct("position", review_id(F.col("row_no")).alias("id"))
    return nearest.groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda x: x["id"]).alias("representative_ids")
    )


def describe(
    assigned: DataFrame, words: lexical.LexicalFeatures, embedded: DataFrame | None = None
) -> DataFrame:
    """(topic_id, label, keywords, representative_ids), one row per topic."""
    placed = words.with_topics(assigned)
    sums = lexical.topic_sums(placed)
    if embedded is None:
        nearest = lexical.lexical_representatives(placed, sums=sums)
    else:
        nearest = lexical.embedding_representatives(assigned.join(embedded, "row_no"))
    topics = lexical.topic_keywords(placed, sums=sums).join(listed_ids(nearest), "topic_id")
    return materialise(topics.select("topic_id", "label", "keywords", "representative_ids"), "topics")


def _texts_sum(reviews: DataFrame) -> Column:
    """A sum over (row, text) that does not depend on the order of rows."""
    return reviews.agg(F.coalesce(F.sum(F.xxhash64("row_no", "review_text").cast("decimal(38,0)")), F.lit(0))).scalar()


def text_changes(reviews: DataFrame, source: DataFrame) -> DataFrame:
    """How many modelling texts differ from the review text they came from, and whether the
    review texts are still those of ``source``."""
    return reviews.agg(
        F.count("*").alias("reviews"),
        F.count_if(F.col("topic_text") != F.col("review_text")).alias("reviews_changed"),
        F.coalesce(F.sum(F.xxhash64("row_no", "review_text").cast("decimal(38,0)")), F.lit(0)).alias("_sum"),
    ).withColumn("review_text_preserved", F.col("_sum") == _texts_sum(source)).drop("_sum")
