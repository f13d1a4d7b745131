"""Every operator as a named query over the generated tables.

The document tables stand in for reviews (``sources.corpus``). Term lists,
lexicons and sentences are the corpus's own, because the default ones match
nothing in invented prose.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions import text as tx
from voxrank.operators import (
    brief, clean, density, evaluate, evidence, impact, lexical, naming, neighbours, responses, sentiment,
    topics, trends,
)
from voxrank.plans import analyze, evaluation, views
from voxrank.session import materialise, store
from voxrank.sources import corpus, exports, files

TERMS = ["that", "tion"]
SENTENCES = [r"\sof\s+the\s", r"\sde\s+la\s"]
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "as", "with", "be", "by",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "que", "el", "los", "und", "der", "die", "das",
]
LEXICON = {
    "Sounding": ["tion", "that", "ness"],
    "French": ["eaux", "ment", "de la"],
    "Spanish": ["ción", "ando", "los"],
    "German": ["ung", "sch", "ich"],
}
DISPLAY = {"src0": "Opening", "src1": "Delivery", "src2": "Returns", "src3": "Sizing", "src7": "Comfort & fit"}
AREAS = {"Opening": "Store", "Delivery": "Logistics", "Returns": "Logistics", "src4": "Fabric", "src5": "Fabric"}
CLASS_NAMES = ["LABEL_0", "LABEL_1", "LABEL_2"]
GRID_WIDTH = 0.01
GRID_MINIMUM = 8
GRID_LETTERS = "en"
# Letters whose rates place a document among others of its language and kind.
POINT_LETTERS = "enras"
VECTOR_LETTERS = "etaonirsuldcmgph"
DENSITY_MINIMUM = 8
CUT_DISTANCE = 0.012

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts widened, so that two engines compare equal."""
    def shown(name: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)
        return F.col(name).cast("long").alias(name) if kind == "int" else F.col(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return clean.prepare(corpus.reviews(spark, sf))


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean reviews with text, topic and rating sentiment, written once."""
    return materialise(sentiment.from_rating(clean.clean(_prepared(spark, sf))), "clean")


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = analyze.with_flags(sentiment.from_rating(_prepared(spark, sf)), TERMS)
    return materialise(clean.clean(rows), "flagged")


def _narrow(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.narrow_reviews(corpus.reviews(spark, sf), TERMS)


def _spaced(spark: SparkSession, sf: str) -> DataFrame:
    """Clean reviews with their modelling text: stored once by the cleaning, without what is not asked for here."""
    shown = ["row_no", "review_id", "topic_id", "topic", "review_text"]
    rows = clean.clean(_prepared(spark, sf).select(*shown, "status", "dedup_key"))
    return rows.select(*shown, tx.topic_text(F.col("review_text"), SENTENCES).alias("topic_text"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.score(_narrow(spark, sf))[2]


# --- Cleaning ----------------------------------------------------------------

def _clean_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "row_no", "review_id", "review_text", F.col("review_length").cast("long").alias("review_length"), "rating",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "product", "source",
    )


@query
def clean_reviews(spark, sf):
    return _clean_columns(clean.clean(_prepared(spark, sf)))


@query
def untidy_clean_reviews(spark, sf):
    return _clean_columns(clean.clean(clean.prepare(corpus.untidy_upload(spark, sf))))


def _quality(upload: DataFrame) -> DataFrame:
    names = clean.uploaded_columns(upload)
    report = clean.quality_report(clean.prepare(upload), names)
    return _rounded(report.select(
        "*", *[F.element_at("missing_values", F.lit(n)).alias(f"missing_{n}") for n in names]
    ).drop("missing_values"))


@query
def quality_report(spark, sf):
    return _quality(corpus.reviews(spark, sf).drop("topic_id", "topic"))


@query
def untidy_quality_report(spark, sf):
    return _quality(corpus.untidy_upload(spark, sf))


# --- Text --------------------------------------------------------------------

@query
def topic_text(spark, sf):
    rows = clean.clean(_prepared(spark, sf).withColumn("topic_text", tx.topic_text(F.col("review_text"), SENTENCES)))
    return rows.select("review_id", "topic_text", (F.col("topic_text") != F.col("review_text")).alias("changed"))


@query
def topic_text_changes(spark, sf):
    """Changes of the modelling text, for reviews kept as they were and for some that were not."""
    before = _clean(spark, sf)
    after = before.withColumn("topic_text", tx.topic_text(F.col("review_text"), SENTENCES))
    touched = after.withColumn("review_text", F.when(F.col("row_no") % 97 == 5, F.lower("topic_text")).otherwise(F.col("review_text")))
    return topics.text_changes(after, before).withColumn("kept_as_is", F.lit(True)).unionByName(
        topics.text_changes(touched, before).withColumn("kept_as_is", F.lit(False)))


@query
def commercial_mentions(spark, sf):
    return _narrow(spark, sf).groupBy("topic_id").agg(
        F.count_if("is_commercial").alias("any_case"), F.count_if("cites_commerce").alias("as_written")
    ).select(F.col("topic_id").cast("long").alias("topic_id"), "any_case", "as_written")


@query
def forbidden_claims(spark, sf):
    turns = corpus.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tx.makes_forbidden_claim(F.col("text")).alias("forbidden"))


@query
def shortened_texts(spark, sf):
    return corpus.table(spark, sf, "benchmark").select("item_id", tx.shorten(F.col("text"), 31).alias("short"))


# --- Sentiment ---------------------------------------------------------------

@query
def rating_sentiment(spark, sf):
    felt = sentiment.from_rating(clean.prepare(corpus.untidy_upload(spark, sf)))
    return felt.select("review_id", "rating", "sentiment_label", "sentiment_score", "sentiment_method")


def _letter_counting_model():
    """A stand-in for a caller's model: class weights are the counts of a, e and o."""
    def predict(batch: np.ndarray) -> np.ndarray:
        counts = np.array([[t.count("a") + 1, t.count("e") + 1, t.count("o") + 1] for t in batch], dtype="float64")
        return counts / counts.sum(axis=1, keepdims=True)

    return predict


@query
def model_sentiment(spark, sf):
    felt, _ = sentiment.analyze_sentiment(
        clean.clean(_prepared(spark, sf)), lambda: _letter_counting_model(), CLASS_NAMES
    )
    return _rounded(felt.select("review_id", "sentiment_label", "sentiment_score", "sentiment_method"))


@query
def sentiment_distribution(spark, sf):
    return views.sentiment_distribution(_narrow(spark, sf))


@query
def headline(spark, sf):
    return _rounded(views.headline(_narrow(spark, sf)))


@query
def synthetic_flag(spark, sf):
    named = corpus.reviews(spark, sf).withColumn("product", F.concat("product", F.lit(" Synthetic")))
    return views.is_synthetic(named.where("topic_id = 3")).unionByName(views.is_synthetic(corpus.reviews(spark, sf)))


# --- Trends and scores -------------------------------------------------------

@query
def topic_trends(spark, sf):
    return _rounded(trends.analyze_trends(_narrow(spark, sf))[0])


@query
def trend_summary(spark, sf):
    return trends.analyze_trends(_narrow(spark, sf))[1].select(
        "available", F.coalesce("reason", F.lit("")).alias("reason"), "dated_reviews", "earlier_n", "later_n", "split", "low_sample"
    )


@query
def undated_trend_summary(spark, sf):
    rows = _narrow(spark, sf).withColumn("date", F.when(F.col("row_no") % 100000 == 3, F.col("date")))
    changes, meta = trends.analyze_trends(rows)
    return meta.select("available", "reason").withColumn("trend_rows", changes.agg(F.count("*").alias("n")).scalar())


@query
def impact_scores(spark, sf):
    return _rounded(_scores(spark, sf))


@query
def impact_scores_undated(spark, sf):
    rows = _narrow(spark, sf).withColumn("date", F.lit(None).cast("timestamp"))
    return _rounded(analyze.score(rows)[2].select("topic_id", "impact_score", "available_weight", "trend", "impact_rank"))


@query
def score_recheck(spark, sf):
    narrow = _narrow(spark, sf)
    saved = materialise(analyze.score(narrow)[2], "saved_scores")
    return _rounded(evaluate.largest_score_difference(saved, analyze.score(narrow.repartition(7))[2]))


# --- Lexical features --------------------------------------------------------

@query
def vocabulary(spark, sf):
    listed = materialise(tx.with_words(_spaced(spark, sf).select("topic_text"), "topic_text", "words", STOP_WORDS), "words")
    return _rounded(lexical.word_vocabulary(listed, fixed.WORD_FEATURES))


@query
def character_vocabulary(spark, sf):
    docs = _spaced(spark, sf).select(tx.flat_text(F.col("topic_text")).alias("text"))
    return _rounded(lexical.character_vocabulary(docs, fixed.CHARACTER_FEATURES))


@query
def tfidf_weights(spark, sf):
    return _rounded(lexical.lexical_features(_spaced(spark, sf), STOP_WORDS).entries())


@query
def uncut_weights(spark, sf):
    """Weights over the whole vocabulary, with each term's number in the dictionary."""
    entries, _ = lexical.uncut_weights(_spaced(spark, sf), STOP_WORDS)
    return _rounded(entries.select("term", "row_no", "weight", "index"))


@query
def character_weights(spark, sf):
    """Weights of character runs over the benchmark's whole texts."""
    items = corpus.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_no"), F.col("text").alias("topic_text"))
    return _rounded(lexical.character_features(items).entries())


@query
def topic_keywords(spark, sf):
    found = lexical.topic_keywords(lexical.lexical_features(_spaced(spark, sf), STOP_WORDS))
    return found.select(F.col("topic_id").cast("long").alias("topic_id"), F.array_join("keywords", ", ").alias("keywords"), "label")


def _representatives(spaced: DataFrame) -> DataFrame:
    return lexical.lexical_representatives(lexical.lexical_features(spaced, STOP_WORDS))


@query
def lexical_representatives(spark, sf):
    return _rounded(_representatives(_spaced(spark, sf)))


def _vectors(spark, sf) -> DataFrame:
    return corpus.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_no"), F.col("label").alias("topic_id"), topics.unit_length("embedding").alias("embedding")
    )


def _counting_embeddings():
    """A stand-in for a caller's embedding model: counts of four letters."""
    return lambda batch: np.array([[t.count(c) for c in "aeon"] for t in batch], dtype="float32")


@query
def model_embeddings(spark, sf):
    """Unit vectors of a caller's model for every document."""
    found = topics.embed(_spaced(spark, sf).select("row_no", "topic_text"), _counting_embeddings)
    return _rounded(found.select("row_no", F.posexplode("embedding").alias("place", "value")))


@query
def embedding_representatives(spark, sf):
    return _rounded(lexical.embedding_representatives(_vectors(spark, sf)))


@query
def lexical_cohesion(spark, sf):
    return _rounded(lexical.lexical_cohesion(_spaced(spark, sf)))


@query
def cohesion_summary(spark, sf):
    return _rounded(lexical.cohesion_summary(lexical.lexical_cohesion(_spaced(spark, sf))))


@query
def example_texts(spark, sf):
    found = lexical.example_texts(clean.clean(_prepared(spark, sf)))
    return found.select(F.col("topic_id").cast("long").alias("topic_id"), F.posexplode("examples").alias("place", "review_text")).select(
        "topic_id", F.col("place").cast("long").alias("place"), "review_text"
    )


# --- Topics ------------------------------------------------------------------

@query
def cluster_policy(spark, sf):
    """The number of clusters the policy gives each topic's own reviews."""
    groups = _spaced(spark, sf).groupBy("topic_id").agg(
        F.count("*").alias("reviews"), F.count_distinct("topic_text").alias("texts")
    )
    count = topics.cluster_count(F.col("reviews"), F.col("texts"))
    return _rounded(groups.select("topic_id", "reviews", count.cast("int").alias("clusters")))


@query
def kmeans_word_topics(spark, sf):
    rows = _spaced(spark, sf).drop("topic_id", "topic", "topic_text")
    return _described(topics.discover_topics(rows, "offline", stop_words=STOP_WORDS, sentences=SENTENCES))


def _embedded_documents(spark, sf) -> DataFrame:
    """Every document with the letter rates of its whole text as an embedding."""
    texts = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("row_no"), F.col("text").alias("review_text"))
    vectors = corpus.letter_rates(spark, sf, VECTOR_LETTERS).withColumnRenamed("point", "embedding")
    return materialise(texts.join(vectors, "row_no").withColumn("review_id", clean.review_id(F.col("row_no"))), "embedded")


def _described(found: topics.Topics) -> DataFrame:
    """Topics with their sizes, and how they were found."""
    sizes = found.reviews.groupBy("topic_id").agg(F.count("*").alias("reviews"))
    return found.topics.join(sizes, "topic_id").withColumns({
        "method": F.lit(found.method), "warnings": F.lit(" ".join(found.warnings)),
    })


@query
def kmeans_embedding_topics(spark, sf):
    return _described(topics.discover_topics(_embedded_documents(spark, sf), "kmeans", embedding="embedding", stop_words=STOP_WORDS))


@query
def density_embedding_topics(spark, sf):
    return _described(topics.discover_topics(_embedded_documents(spark, sf), "auto", embedding="embedding", stop_words=STOP_WORDS))


def _document_points(spark, sf) -> DataFrame:
    return corpus.letter_rates(spark, sf, POINT_LETTERS)


@query
def density_core_distances(spark, sf):
    """Each different point's rows and the distance within which it has enough rows."""
    points = materialise(density.distinct_points(_document_points(spark, sf)), "points")
    near = materialise(neighbours.nearest_neighbours(points, fixed.DENSITY_NEIGHBOURS), "near")
    cores = density.core_distances(near, points, DENSITY_MINIMUM)
    return _rounded(points.select(F.col("id").alias("row_no"), F.col("weight").alias("reviews"), "id").join(cores, "id").drop("id"), 9)


@query
def density_cut_topics(spark, sf):
    """The cluster tree of all documents cut at one distance."""
    return _rounded(density.topics_within(_document_points(spark, sf), DENSITY_MINIMUM, CUT_DISTANCE))


@query
def density_grid_topics(spark, sf):
    """Grid topics over two letter rates, which lie between 0 and 1."""
    points = corpus.letter_rates(spark, sf, GRID_LETTERS)
    return _rounded(density.topics_at_width(points, [0.0, 0.0], [1.0, 1.0], GRID_WIDTH, GRID_MINIMUM))


@query
def lexicon_names(spark, sf):
    return _rounded(naming.lexicon_names(_spaced(spark, sf), LEXICON))


def _named(spark, df: DataFrame) -> DataFrame:
    shown = naming.with_display(df, files.label_table(spark, DISPLAY), "topic", "display_topic")
    return naming.with_display(shown, files.label_table(spark, AREAS), "display_topic", "business_topic")


@query
def display_labels(spark, sf):
    return _rounded(_named(spark, _scores(spark, sf).select("topic_id", "topic", "impact_score")))


# --- Evidence and briefs -----------------------------------------------------

def _evidence(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews with flags, scores, id lists), each written once."""
    reviews = _flagged(spark, sf)
    narrow = reviews.select(*analyze.NARROW)
    scores = materialise(analyze.score(narrow)[2], "scores")
    spaced = reviews.select("row_no", "topic_id", F.col("review_text").alias("topic_text"))
    listed = topics.listed_ids(_representatives(spaced))
    ids = materialise(evidence.ids_by_kind(listed, evidence.supporting_rows(narrow)), "ids")
    return reviews, scores, ids


@query
def supporting_rows(spark, sf):
    return _rounded(evidence.supporting_rows(_narrow(spark, sf)))


@query
def evidence_pool(spark, sf):
    _, _, ids = _evidence(spark, sf)
    return _rounded(evidence.evidence_pool(ids).select("topic_id", F.array_join("review_ids", ",").alias("review_ids")))


@query
def own_evidence_pool(spark, sf):
    """Pools when every second topic lists another topic's representatives: only its own reviews count."""
    reviews, _, ids = _evidence(spark, sf)
    beside = ids.select((F.col("topic_id") + 1).alias("topic_id"), F.col("representative").alias("foreign"))
    mixed = ids.join(beside, "topic_id", "left").withColumn("representative", F.when(
        F.col("topic_id") % 2 == 1, F.concat("foreign", F.slice("representative", 1, 1))).otherwise(F.col("representative")))
    pool = evidence.evidence_pool(evidence.own_ids(mixed.drop("foreign"), reviews))
    return _rounded(pool.select("topic_id", F.array_join("review_ids", ",").alias("review_ids")))


@query
def evidence_topics(spark, sf):
    reviews, scores, ids = _evidence(spark, sf)
    rows = evidence.structured_evidence(scores, evidence.evidence_pool(ids), reviews)
    flat = rows.select(
        "topic_id", "topic_name", "impact_rank", "review_count", "share_of_voice_pct", "sentiment.*",
        F.col("trend.direction").alias("direction"), F.col("trend.change_percentage_points").alias("change_points"),
        F.col("purchase_relevance.matched_review_pct").alias("matched_review_pct"),
        F.col("business_impact.score_0_to_10").alias("impact"), "business_impact.components.*",
        F.posexplode("evidence_reviews").alias("place", "review"),
    )
    return _rounded(flat.select("*", "review.*").drop("review"), 4)


@query
def evidence_document(spark, sf):
    reviews, scores, ids = _evidence(spark, sf)
    rows = evidence.structured_evidence(scores, evidence.evidence_pool(ids), reviews)
    document = F.try_parse_json("document")
    return evidence.evidence_document(rows).select(
        F.try_variant_get(document, "$.analysis_scope.valid_review_count", "long").alias("valid_review_count"),
        F.try_variant_get(document, "$.analysis_scope.topic_count", "long").alias("topic_count"),
        F.try_variant_get(document, "$.analysis_scope.limitations[0]", "string").alias("first_limitation"),
        F.try_variant_get(document, "$.topics[0].topic_name", "string").alias("first_topic"),
        F.size(F.try_variant_get(document, "$.topics", "array<variant>")).cast("long").alias("listed_topics"),
    )


def _listed(insights: DataFrame) -> DataFrame:
    return _rounded(insights.withColumn("review_ids", F.array_join("review_ids", ",")))


@query
def brief_insights(spark, sf):
    _, scores, ids = _evidence(spark, sf)
    return _listed(brief.deterministic_insights(scores, ids))


@query
def brief_summary(spark, sf):
    return brief.brief_summary(_scores(spark, sf))


@query
def brief_repeatability(spark, sf):
    """Whether the brief's fingerprint is the same over other partitions, and after one score has changed."""
    _, scores, ids = _evidence(spark, sf)

    def once(s, i):
        return brief.brief_fingerprint(brief.brief_summary(s), brief.deterministic_insights(s, i)).select("brief_sha256").scalar()

    first = F.col("impact_rank") == 1
    altered = materialise(scores.withColumn("impact_score", F.when(first, F.col("impact_score") - 1).otherwise(F.col("impact_score"))), "altered")
    one = spark.range(1).select(once(scores, ids).alias("whole"), once(scores.repartition(5), ids.repartition(3)).alias("repartitioned"),
                                once(altered, ids).alias("altered"))
    one = materialise(one, "fingerprints")
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(run).alias("run"), (F.col(run) == F.col("whole")).alias("identical"), F.length(run).cast("long").alias("digits"))
        for run in ("repartitioned", "altered")])))


@query
def citation_metrics(spark, sf):
    reviews, scores, ids = _evidence(spark, sf)
    return _rounded(evaluate.citation_metrics(brief.deterministic_insights(scores, ids), reviews))


@query
def recommendation_panel(spark, sf):
    reviews, scores, ids = _evidence(spark, sf)
    insights = brief.deterministic_insights(scores, ids)
    shown = views.recommendation_panel(insights, evidence.cited_reviews(insights, reviews, "insight_id"))
    return shown.select("category", "insight_id", "topic", F.col("position").cast("double").alias("position"), "review_id", "review_text", "source")


@query
def insight_export(spark, sf):
    reviews, scores, ids = _evidence(spark, sf)
    insights = brief.deterministic_insights(scores, ids)
    return exports.recommendation_export(
        brief.brief_summary(scores), insights, evidence.cited_reviews(insights, reviews, "insight_id"), "documents", False
    )


# --- Written recommendations -------------------------------------------------

def _real_pool(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(scores, pool) of the evidence that a writer would be given."""
    _, scores, ids = _evidence(spark, sf)
    return scores, materialise(evidence.evidence_pool(ids), "pool")


def _written_responses(spark, sf, pool: DataFrame) -> DataFrame:
    """One response per conversation turn, its text as the finding, right or wrong in a dozen ways."""
    turns = corpus.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), (F.col("conv_id") % 23).cast("int").alias("topic_id"),
        ((F.col("conv_id") * 7 + F.col("turn")) % 14).alias("kind"), "text",
    ).join(pool, "topic_id", "left")
    kind = F.col("kind")
    ids = F.coalesce(F.slice("review_ids", 1, 2), F.array(F.lit("R000001")))
    ids = F.when(kind == 5, F.array(F.lit("R999999"))).when(kind == 9, F.concat(ids, ids)).otherwise(ids)
    finding = F.coalesce("text", F.lit(""))

    def item(category: Column) -> Column:
        return F.struct(
            category.alias("category"), F.col("topic_id").alias("topic_id"), finding.alias("finding"),
            F.lit("The pattern may affect the experience and warrants review.").alias("business_implication"),
            F.lit("Inspect the cited experience and test a focused response.").alias("recommended_action"),
            ids.alias("evidence_review_ids"),
        )

    items = F.array(item(F.lit("Product")), item(F.when(kind == 4, "Product").otherwise("Pricing")), item(F.lit("Marketing")))
    items = F.when(kind == 3, F.slice(items, 1, 2)).otherwise(items)
    summary = F.when(kind == 6, F.lit("This will increase revenue by 20 percent across the market.")).otherwise(
        F.lit("The supplied evidence suggests a focused issue that merits validation.")
    )
    plain = F.to_json(F.struct(summary.alias("executive_synthesis"), items.alias("recommendations")))
    return materialise(turns.select("response_id", (
        F.when(kind == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit('{"note":null,'), F.substring(plain, F.lit(2), F.length(plain))))
        .when(kind == 7, F.concat(plain, F.lit(" That is all.")))
        .when(kind == 8, F.replace(plain, F.lit('"category"'), F.lit('"kind":1,"category"')))
        .when(kind == 10, F.regexp_replace(plain, r'"topic_id":(\d+)', '"topic_id":"$1"'))
        .when(kind == 11, F.lit(None))
        .when(kind == 12, F.regexp_replace(plain, r'"topic_id":(\d+)', '"topic_id":[$1]'))
        .when(kind == 13, F.concat(F.lit("["), plain, F.lit("]")))
        .otherwise(plain)
    ).alias("content")), "written")


@query
def recommendation_checks(spark, sf):
    _, pool = _real_pool(spark, sf)
    return responses.validate_responses(responses.parse_responses(_written_responses(spark, sf, pool)), pool).withColumns({
        c: F.coalesce(c, F.lit("")) for c in ("reason", "error")})


@query
def accepted_recommendations(spark, sf):
    scores, pool = _real_pool(spark, sf)
    return _listed(responses.accepted_insights(responses.parse_responses(_written_responses(spark, sf, pool)), pool, scores))


@query
def chosen_brief(spark, sf):
    scores, pool = _real_pool(spark, sf)
    parsed = responses.parse_responses(_written_responses(spark, sf, pool))
    chosen = responses.choose_brief(parsed, pool, brief.brief_summary(scores))
    return chosen.withColumn("warning", F.coalesce("warning", F.lit("")))


@query
def proposed_labels(spark, sf):
    """One proposal per benchmark item, naming all topics, some of them badly; all topics under each, beside the old names."""
    old = materialise(_narrow(spark, sf).groupBy("topic_id").agg(F.min("topic").alias("label")), "labels")
    kind = F.col("item_id") % 5
    names = old.select(F.sort_array(F.collect_list("topic_id")).alias("ids"), F.min("topic_id").alias("first"), F.max("topic_id").alias("last"))
    items = corpus.table(spark, sf, "benchmark").crossJoin(F.broadcast(names))  # one row of topic ids
    offered = F.filter("ids", lambda t: (kind != 1) | (t != F.col("first")))
    name = F.when(kind == 2, F.col("text")).when(kind == 3, F.lit("two\nlines")).otherwise(F.concat(F.lit("Topic "), F.md5("text")))
    named = F.map_from_entries(F.transform(offered, lambda t: F.struct(
        t.cast("string"), F.when((kind == 4) & (t == F.col("last")), F.lit(" ")).otherwise(F.when(t == F.col("first"), name).otherwise(F.lit("Plain name"))))))
    proposals = items.select(F.col("item_id").alias("proposal_id"), F.to_json(named).alias("content"))
    return _rounded(naming.labels_under(naming.check_proposed_labels(proposals, old), old))


@query
def renamed_topics(spark, sf):
    """The topics under each of two proposals: all named, and one too few."""
    old = _narrow(spark, sf).groupBy("topic_id").agg(F.min("topic").alias("label"))
    outlier = spark.createDataFrame([(fixed.OUTLIER_TOPIC, fixed.OUTLIER_LABEL)], "topic_id int, label string")
    old = materialise(old.unionByName(outlier), "labels")
    pairs = F.struct(F.col("topic_id").cast("string"), F.concat(F.lit("New "), "label"))
    named = old.where(F.col("topic_id") >= 0).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pairs)))).alias("1"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("topic_id") != 2, pairs))))).alias("2"),
    ).unpivot([], ["1", "2"], "proposal_id", "content")
    renamed = [naming.rename_topics(old, named.where(F.col("proposal_id") == p)).withColumn("proposal", F.lit(p)) for p in ("1", "2")]
    return _rounded(renamed[0].unionByName(renamed[1]))


# --- Dashboard tables --------------------------------------------------------

@query
def priority_table(spark, sf):
    return _rounded(views.priority_table(_scores(spark, sf)))


@query
def reach_points(spark, sf):
    return _rounded(views.reach_points(_scores(spark, sf)))


@query
def most_discussed(spark, sf):
    return _rounded(views.most_discussed(_scores(spark, sf)))


@query
def fastest_rising(spark, sf):
    return _rounded(views.fastest_rising(_scores(spark, sf)))


@query
def trend_lines(spark, sf):
    changes, _, scores = analyze.score(_narrow(spark, sf))
    return _rounded(views.trend_lines(changes, scores))


@query
def score_components(spark, sf):
    return _rounded(views.score_components(_scores(spark, sf)))


@query
def sentiment_mix(spark, sf):
    return _rounded(views.sentiment_mix(_scores(spark, sf)))


@query
def drill_down(spark, sf):
    words = lexical.topic_keywords(lexical.lexical_features(_spaced(spark, sf), STOP_WORDS))
    shown = views.drill_down(_scores(spark, sf), words.select("topic_id", "keywords"))
    return _rounded(shown.withColumn("keywords", F.array_join("keywords", ", ")))


@query
def topic_voices(spark, sf):
    reviews, _, ids = _evidence(spark, sf)
    return _rounded(views.topic_voices(ids.select("topic_id", F.col("representative").alias("representative_ids")), reviews))


# --- Evaluation --------------------------------------------------------------

def _rerun(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline, current, validation) of two runs placed by rule on the row number."""
    rows = _clean(spark, sf)
    row, topic = F.col("row_no"), F.col("topic_id")
    outlier = F.lit(fixed.OUTLIER_TOPIC)
    baseline = _named(spark, rows.withColumn("topic_id", F.when(row % 13 == 0, outlier).otherwise(topic)))
    moved = F.when(row % 11 == 0, outlier).when(row % 3 == 0, (topic + 1) % 20).otherwise(topic)
    current = _named(spark, rows.withColumn("topic_id", moved).withColumn("topic", F.concat(F.lit("src"), topic.cast("string")))).select(
        "row_no", "review_id", "review_text", F.col("review_text").alias("topic_text"), "topic_id",
        F.concat(F.lit("m"), F.col("topic_id").cast("string")).alias("topic_model_label"), F.col("business_topic").alias("topic"),
    )
    baseline = materialise(baseline, "baseline")
    current = materialise(current, "current")
    judged = baseline.where("rating is not null").join(current.select("review_id", F.col("topic").alias("now")), "review_id")
    human = F.when(row % 4 == 0, F.col("business_topic")).when(row % 4 == 1, F.col("now")).otherwise(F.lit("Other"))
    verdict = F.when(row % 7 == 0, "").when(human == F.col("business_topic"), " True").otherwise("FALSE ")
    validation = judged.select(
        "row_no", "review_text", F.col("topic").alias("model_topic"), F.col("sentiment_label").alias("model_sentiment"),
        human.alias("human_topic"), F.when(row % 9 == 0, "").otherwise(F.col("sentiment_label")).alias("human_sentiment"),
        verdict.alias("topic_correct"),
        F.when(row % 5 == 0, "TRUE").when(row % 5 == 1, "false").when(row % 5 == 2, "maybe").otherwise("true").alias("sentiment_correct"),
    )
    return baseline, current, validation


@query
def coverage_metrics(spark, sf):
    baseline, _, _ = _rerun(spark, sf)
    return _rounded(evaluate.coverage(baseline))


@query
def label_accuracy(spark, sf):
    return _rounded(evaluate.label_accuracy(_rerun(spark, sf)[2]))


@query
def evaluation_summary(spark, sf):
    reviews, scores, ids = _evidence(spark, sf)
    return _rounded(evaluation.evaluation_summary(reviews, scores, ids, _rerun(spark, sf)[2]))


@query
def validation_sample(spark, sf):
    return evaluate.validation_sample(_clean(spark, sf))


@query
def reused_sentiment(spark, sf):
    baseline, current, _ = _rerun(spark, sf)
    felt = evaluate.reuse_sentiment(current, baseline.where("row_no % 6 <> 0"))
    return felt.select("review_id", "topic_model_label", "sentiment_label", "sentiment_score", "sentiment_method")


@query
def assignment_comparison(spark, sf):
    baseline, current, _ = _rerun(spark, sf)
    return _rounded(evaluate.compare_assignments(current, baseline).drop("topic_text"))


def _judged(spark, sf) -> tuple[DataFrame, DataFrame]:
    baseline, current, validation = _rerun(spark, sf)
    assignments = materialise(evaluate.compare_assignments(current, baseline), "assignments")
    return evaluate.judged_rows(validation, assignments), assignments


@query
def accuracy_by_class(spark, sf):
    return _rounded(evaluate.accuracy_by_class(_judged(spark, sf)[0]))


@query
def before_after(spark, sf):
    return _rounded(evaluate.before_after(*_judged(spark, sf)))


@query
def corrected_examples(spark, sf):
    return evaluate.outcome_examples(_judged(spark, sf)[0], True, "row_no")


@query
def newly_incorrect_examples(spark, sf):
    return evaluate.outcome_examples(_judged(spark, sf)[0], False, "row_no")


# --- Files -------------------------------------------------------------------

@query
def export_safe_reviews(spark, sf):
    """Reviews opened by a formula sign in some rows, made safe for spreadsheets."""
    sign = F.when(F.col("row_no") % 4 == 0, " =").when(F.col("row_no") % 4 == 1, "-").when(F.col("row_no") % 4 == 2, "@").otherwise("")
    marked = clean.clean(_prepared(spark, sf)).select("row_no", F.concat(sign, F.col("review_text")).alias("review_text"), "source")
    return exports.export_safe(marked)


@query
def upload_columns(spark, sf):
    """Which tables may be uploaded as they are: one column must hold the review text."""
    def answer(name):
        try:
            clean.standardise_columns(corpus.table(spark, sf, name))
        except ValueError as error:
            return str(error)
        return ""

    names = ["documents", "labels", "benchmark", "conversations", "pages", "embeddings"]
    counts = [corpus.table(spark, sf, n).agg(F.count("*").alias("rows")).select(
        F.lit(n).alias("table_name"), F.lit(answer(n)).alias("refusal"), "rows") for n in names]
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole


@query
def json_labels(spark, sf):
    """Topic names written as one JSON map, read back and shown beside their areas."""
    folder = store(spark.range(1), "json-parent") + "/labels"
    names = _narrow(spark, sf).select("topic", "topic_id").distinct()
    labels = F.array(*[F.lit(d) for d in fixed.DISPLAY_TO_AREA])
    pairs = F.struct(F.col("topic"), F.element_at(labels, F.col("topic_id") % len(fixed.DISPLAY_TO_AREA) + 1))
    names.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pairs)))).alias("value")).coalesce(1).write.text(folder)
    shown = naming.with_display(names.select("topic"), files.read_labels(spark, folder), "topic", "display")
    return naming.with_display(shown, files.label_table(spark, fixed.DISPLAY_TO_AREA), "display", "area")


@query
def written_file_hash(spark, sf):
    """SHA-256 of a file with the benchmark's texts in order, by file."""
    folder = store(spark.range(1), "hash-parent") + "/texts"
    corpus.table(spark, sf, "benchmark").orderBy("item_id").coalesce(1).select("text").write.text(folder)
    return exports.file_fingerprint(spark, folder + "/part-*").select("sha256")


@query
def csv_round_trip(spark, sf):
    """Reviews written as spreadsheet-safe CSV and read back as an upload."""
    rows = clean.clean(_prepared(spark, sf)).select(
        F.col("row_no").cast("string").alias("key"), "review_text", F.col("rating").cast("string").alias("rating"),
        F.when(F.col("row_no") % 6 == 0, "N/A").otherwise(F.col("source")).alias("source"),
    )
    folder = store(spark.range(1), "csv-parent") + "/csv"
    exports.write_csv(rows, folder, byte_order_mark=False)
    return files.read_reviews(spark, folder).select("key", "review_text", "rating", "source")


@query
def numbered_upload(spark, sf):
    """Row numbers of an upload follow the file, one by one from zero."""
    folder = store(spark.range(1), "csv-parent") + "/csv"
    corpus.table(spark, sf, "labels").orderBy("doc_id").coalesce(1).write.csv(folder, header=True)
    return files.with_row_numbers(files.read_csv(spark, folder, multi_line=False)).select(
        "row_no", F.col("doc_id").cast("long").alias("doc_id")
    )


@query
def validation_file(spark, sf):
    """Validation rows written and read back with blanks kept."""
    folder = store(spark.range(1), "csv-parent") + "/csv"
    validation = _rerun(spark, sf)[2].select(F.col("row_no").cast("string").alias("key"), "human_sentiment", "topic_correct")
    validation.write.csv(folder, header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_validation(spark, folder).drop("row_no")


@query
def reloaded_snapshot(spark, sf):
    """Scores saved with their input's fingerprint, then loaded against it."""
    narrow = _narrow(spark, sf)
    changes, _, scores = analyze.score(narrow)
    folder = store(spark.range(1), "snapshot-parent") + "/snapshot"
    exports.save_snapshot(folder, {"scores": scores, "trends": changes}, narrow)
    return _rounded(exports.load_snapshot(spark, folder, narrow)["scores"].select("topic_id", "topic", "impact_score"))


@query
def table_fingerprint(spark, sf):
    return exports.table_fingerprint(corpus.table(spark, sf, "documents"))
