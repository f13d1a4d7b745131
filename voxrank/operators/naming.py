"""Business names for topics, from a lexicon or from proposed labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrank import fixed_values as fixed
from voxrank.functions import text as tx
from voxrank.operators.responses import strict_json
from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise


def lexicon_names(
    reviews: DataFrame, lexicon: dict[str, list[str]] = fixed.PRODUCT_AREA_TERMS, text: str = "topic_text"
) -> DataFrame:
    """(topic_id, name): the lexicon label whose terms occur most often.

    Occurrences are counted per row, one column per label, so the only shuffle
    carries one partial sum per task and topic. Ties go to the label listed
    first; an occurrence spanning two reviews is not counted.
    """
    folded = F.translate(tx.fold_case(F.col(text)), "ς", "σ")  # as casefold does to the terms
    labels = list(lexicon)
    counts = []
    for label in labels:
        found = [tx.occurrences(F.col("_folded"), term.casefold()) for term in lexicon[label]]
        counts.append(sum(found[1:], found[0]))
    rows = reviews.select("topic_id", folded.alias("_folded")).select(
        "topic_id", *[c.alias(f"n{i}") for i, c in enumerate(counts)]
    )
    totals = rows.groupBy("topic_id").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(labels))])
    return totals.select("topic_id", _best(totals, labels).alias("name"))


def _best(totals: DataFrame, labels: list[str]) -> Column:
    highest = F.array_max(F.array(*[F.col(f"n{i}") for i in range(len(labels))]))
    name = F.when(F.col("topic_id") == fixed.OUTLIER_TOPIC, fixed.OUTLIER_LABEL).when(highest == 0, fixed.UNNAMED_LABEL)
    for i, label in enumerate(labels):
        name = name.when(F.col(f"n{i}") == highest, label)
    return name


def with_display(df: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """Map ``source`` through (label, display) rows, keeping what is unmapped."""
    named = labels.select(F.col("label").alias(source), F.col("display").alias("_display"))
    return df.join(named, source, "left").withColumn(target, F.coalesce("_display", source)).drop("_display")


@dataclass
class CheckedLabels:
    """(proposal_id, accepted) of every proposal; (proposal_id, topic_id, label) of the accepted ones."""

    proposals: DataFrame
    accepted_labels: DataFrame


def check_proposed_labels(proposals: DataFrame, topics: DataFrame) -> CheckedLabels:
    """Accept or reject proposals (proposal_id, content), each one JSON object of topic names.

    A proposal is accepted as a whole: exactly the topics without the outlier group, and only
    short, single-line, non-blank texts. Its own entries are matched with the topics and
    counted; an object's keys differ, so as many matches as entries and as topics mean equal
    sets. Neither the topics nor the old labels are repeated for each proposal.
    """
    def usable(label: Column) -> Column:
        return F.coalesce(
            (tx.collapse_spaces(label) != "") & (F.length(label) <= fixed.LABEL_LIMIT) & ~F.contains(label, F.lit("\n")),
            F.lit(False),
        )

    fields = F.try_variant_get(strict_json(F.col("content")), "$", "map<string,variant>")
    value = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    read = proposals.select("proposal_id", F.explode_outer(fields).alias("key", "value")).select(
        "proposal_id", "key", value.alias("label"))
    entries = materialise(read, "proposals")
    nameable = topics.where(F.col("topic_id") != fixed.OUTLIER_TOPIC).select("topic_id", F.col("topic_id").cast("string").alias("key"))
    nameable = materialise(nameable, "nameable")
    known = entries.join(counted_broadcast(nameable), "key", "left")
    total = nameable.agg(F.count("*").alias("n")).scalar()
    judged = known.groupBy("proposal_id").agg(
        F.count("key").alias("entries"), F.count("topic_id").alias("matches"),
        F.bool_and(F.col("key").isNotNull() & usable(F.col("label"))).alias("usable"),
    )
    accepted = (F.col("entries") == total) & (F.col("matches") == total) & F.col("usable")
    judged = materialise(judged.select("proposal_id", accepted.alias("accepted")), "judged")
    labels = known.join(judged.where("accepted"), "proposal_id").select("proposal_id", "topic_id", "label")
    return CheckedLabels(judged, labels)


def labels_under(checked: CheckedLabels, topics: DataFrame) -> DataFrame:
    """(proposal_id, accepted, topic_id, label, old_label): every one of ``topics`` (topic_id, label) under every proposal.

    A rejected proposal leaves the old labels. The topics are a written table of one row each.
    """
    old = counted_broadcast(topics.select("topic_id", F.col("label").alias("old_label")))
    new = checked.accepted_labels.withColumnRenamed("label", "_new")
    return checked.proposals.crossJoin(old).join(new, ["proposal_id", "topic_id"], "left").select(
        "proposal_id", "accepted", "topic_id", F.coalesce("_new", "old_label").alias("label"), "old_label")


def rename_topics(topics: DataFrame, proposal: DataFrame) -> DataFrame:
    """``topics`` (topic_id, label) under one proposal if it is accepted, else as they are."""
    labels = check_proposed_labels(proposal, topics).accepted_labels.select("topic_id", F.col("label").alias("_new"))
    return topics.join(counted_broadcast(materialise(labels, "new-labels")), "topic_id", "left").withColumn(
        "label", F.coalesce("_new", "label")).drop("_new")
