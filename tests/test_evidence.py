import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxrank.operators import brief, evaluate, evidence, responses, sentiment
from voxrank.plans import analyze, views
from voxrank.sources import exports

GOOD = {
    "finding": "The supplied reviews describe friction that merits validation.",
    "business_implication": "The pattern may affect the experience represented here and warrants review.",
    "recommended_action": "Inspect the cited experience and test a focused response.",
}
SUMMARY = "The supplied evidence suggests a focused issue that merits coordinated validation."


@pytest.fixture(scope="module")
def story(spark):
    """(reviews, scores, ids, pool): two topics with dates, ratings and price wording."""
    rows = []
    for i in range(40):
        topic = 0 if i < 25 else 1
        text = f"review {i} about the price" if i % 6 == 0 else f"Review {i} about the Price" if i % 6 == 1 else f"review {i}"
        rows.append((i, f"R{i + 1:06d}", topic, f"Topic {topic}", datetime(2026, 1, 1) + timedelta(days=i), float(i % 5 + 1), text, None if i % 4 else "Shop"))
    frame = spark.createDataFrame(rows, "row_no long, review_id string, topic_id int, topic string, date timestamp, rating double, review_text string, source string")
    reviews = analyze.with_flags(sentiment.from_rating(frame)).cache()
    scores = analyze.score(reviews)[2].cache()
    topics = spark.createDataFrame([(0, ["R000003", "R000001", "R000002"]), (1, ["R000030"])], "topic_id int, representative_ids array<string>")
    ids = evidence.ids_by_kind(topics, evidence.supporting_rows(reviews)).cache()
    return reviews, scores, ids, evidence.evidence_pool(ids).cache()


def test_pool_order_and_size(story):
    pool = {r.topic_id: r.review_ids for r in story[3].collect()}
    # representatives, then the first two of ratings 1 and 2, then the first two with "price" as written
    assert pool[0] == ["R000003", "R000001", "R000002", "R000007"]
    assert pool[1] == ["R000030", "R000026", "R000027", "R000031", "R000037"]


def test_evidence_ignores_case_only_when_asked(spark, story):
    reviews = analyze.with_flags(story[0].drop("is_commercial", "cites_commerce"), case_sensitive_evidence=False)
    first = evidence.supporting_rows(reviews).where("kind = 'commercial' AND topic_id = 0").orderBy("position")
    assert [r.review_id for r in first.collect()] == ["R000001", "R000002", "R000007"]


def test_brief_rules(story):
    reviews, scores, ids, _ = story
    found = brief.deterministic_insights(scores, ids).orderBy("insight_id").collect()
    assert [r.insight_id for r in found] == [f"D{i + 1}" for i in range(len(found))]
    assert [r.category for r in found][:4] == ["Pain Points", "Product", "Pricing", "Marketing"]
    top = scores.where("impact_rank = 1").first()
    marketing = next(r for r in found if r.category == "Marketing")
    assert marketing.topic_id == top.topic_id and marketing.rank == 1
    assert marketing.evidence.startswith(
        f"Rank 1 of 2; {top.review_count} reviews ({top.share_pct:.1f}% share of voice); {top.negative_pct:.1f}% negative; "
        f"Business Impact Score {top.impact_score:.2f}/10; purchase relevance {top.purchase_relevance_score:.2f}/10; "
        f"sentiment coverage {top.sentiment_coverage:.1f}%. Topic share changed {top.change_pp:+.1f} percentage points"
    )
    rows = [r for r in reviews.collect() if r.topic_id == found[0].topic_id and r.sentiment_label == "Negative"]
    assert found[0].review_ids == [r.review_id for r in sorted(rows, key=lambda r: r.row_no)[:3]]
    text = brief.brief_summary(scores).first().summary
    assert text.startswith(f"Analyzed 40 reviews across 2 topics. {top.topic} ranks first")


def test_brief_skips_rules_without_evidence(spark):
    frame = spark.createDataFrame([(0, "R000001", 0, "T", None, 5.0, "nice")], "row_no long, review_id string, topic_id int, topic string, date timestamp, rating double, review_text string")
    reviews = analyze.with_flags(sentiment.from_rating(frame))
    scores = analyze.score(reviews)[2]
    topics = spark.createDataFrame([(0, ["R000001"])], "topic_id int, representative_ids array<string>")
    found = brief.deterministic_insights(scores, evidence.ids_by_kind(topics, evidence.supporting_rows(reviews))).collect()
    assert [(r.insight_id, r.category) for r in found] == [("D1", "Marketing")]
    assert "Topic share changed" not in found[0].evidence


def test_brief_repeats_exactly(story):
    _, scores, ids, _ = story
    hashes = {
        brief.brief_fingerprint(brief.brief_summary(s), brief.deterministic_insights(s, i)).first().brief_sha256
        for s, i in [(scores, ids), (scores.repartition(3), ids.repartition(4))]
    }
    assert len(hashes) == 1


def test_document(story):
    reviews, scores, _, pool = story
    text = evidence.evidence_document(evidence.structured_evidence(scores, pool, reviews)).first().document
    document = json.loads(text)
    assert set(document) == {"analysis_scope", "topics"}
    assert document["analysis_scope"]["valid_review_count"] == 40
    assert set(document["topics"][0]) == {
        "topic_id", "topic_name", "impact_rank", "review_count", "share_of_voice_pct", "sentiment", "trend",
        "purchase_relevance", "business_impact", "evidence_reviews",
    }
    assert [t["impact_rank"] for t in document["topics"]] == [1, 2]
    by_topic = {t["topic_id"]: t for t in document["topics"]}
    assert [r["review_id"] for r in by_topic[0]["evidence_reviews"]] == ["R000003", "R000001", "R000002", "R000007"]
    assert by_topic[0]["evidence_reviews"][1]["source"] == "Shop" and by_topic[0]["evidence_reviews"][0]["source"] == "Unavailable"
    score = scores.where("topic_id = 0").first()
    assert by_topic[0]["business_impact"]["score_0_to_10"] == round(score.impact_score, 4)


def test_citations_and_export(spark, story):
    reviews, scores, ids, _ = story
    insights = brief.deterministic_insights(scores, ids)
    cited = evidence.cited_reviews(insights, reviews, "insight_id")
    metrics = evaluate.citation_metrics(insights, reviews).first()
    assert metrics.citation_rate_pct == 100 and metrics.recommendations == insights.count()
    wrong = insights.withColumn("review_ids", F.when(F.col("category") == "Product", F.array(F.lit("R000026"), F.lit("R999999"))).otherwise(F.col("review_ids")))
    none = wrong.withColumn("review_ids", F.when(F.col("category") == "Pricing", F.array().cast("array<string>")).otherwise(F.col("review_ids")))
    checks = {r.insight_id: r.grounded for r in evaluate.citation_checks(none, reviews).collect()}
    assert checks["D1"] and not checks["D2"] and not checks["D3"]
    with pytest.raises(Exception, match="Cited review not found: R999999"):
        evidence.cited_reviews(wrong, reviews, "insight_id").collect()
    rows = exports.recommendation_export(brief.brief_summary(scores), insights, cited, "=set", True).collect()
    marketing = next(r for r in rows if r.category == "Marketing")
    assert marketing.dataset == "'=set" and marketing.synthetic_data
    ids_listed = marketing.review_ids.split(" | ")
    assert marketing.supporting_reviews.startswith(f"{ids_listed[0]}: ")
    assert len(marketing.sources.split(" | ")) == len(ids_listed)
    panel = views.recommendation_panel(insights.where("category <> 'Pricing'"), cited)
    assert [r.insight_id for r in panel.where("category = 'Pricing'").collect()] == [None]


def written(**changes):
    items = [{"category": c, "topic_id": 0, **GOOD, "evidence_review_ids": ["R000003"]} for c in ("Product", "Pricing", "Marketing")]
    body = {"executive_synthesis": SUMMARY, "recommendations": items}
    for key, value in changes.items():
        if key in body:
            body[key] = value
        elif key == "extra":
            body["note"] = value
        else:
            items[1][key] = value
    return body


CASES = {
    "plain": (json.dumps(written()), True, ""),
    "fenced": ("```json\n" + json.dumps(written(), indent=1) + "\n```", True, ""),
    "padded": ("  \n" + json.dumps(written()) + "\n", True, ""),
    "float topic": (json.dumps(written(topic_id=0.0)), True, ""),
    "true topic": (json.dumps(written(topic_id=True, evidence_review_ids=["R000030"])), True, ""),
    "not json": ("{oops", False, "not valid JSON"),
    "trailing text": (json.dumps(written()) + " done", False, "not valid JSON"),
    "trailing bracket": (json.dumps(written()) + "] [", False, "not valid JSON"),
    "trailing brace": (json.dumps(written()) + "} {", False, "not valid JSON"),
    "a list": ("[1]", False, "response fields"),
    "extra key": (json.dumps(written(extra=1)), False, "response fields"),
    "short summary": (json.dumps(written(executive_synthesis="Too short.")), False, "executive synthesis"),
    "numeric summary": (json.dumps(written(executive_synthesis="This will increase revenue by 20 percent across the market.")), False, "executive synthesis"),
    "object summary": (json.dumps(written(executive_synthesis={"text": "a long enough object in place of text"})), False, "executive synthesis"),
    "two items": (json.dumps(written(recommendations=written()["recommendations"][:2])), False, "Exactly three"),
    "items not a list": (json.dumps(written(recommendations="abc")), False, "Exactly three"),
    "extra item key": (json.dumps(written(why="x")), False, "recommendation fields"),
    "repeated category": (json.dumps(written(category="Product")), False, "category or topic"),
    "unknown category": (json.dumps(written(category="Sales")), False, "category or topic"),
    "unknown topic": (json.dumps(written(topic_id=9)), False, "category or topic"),
    "text topic": (json.dumps(written(topic_id="0")), False, "category or topic"),
    "claim": (json.dumps(written(finding="This clearly guarantees better loyalty.")), False, "claim in finding"),
    "short action": (json.dumps(written(recommended_action="Do it now")), False, "claim in recommended_action"),
    "unknown id": (json.dumps(written(evidence_review_ids=["R999999"])), False, "citations"),
    "other topic's id": (json.dumps(written(evidence_review_ids=["R000030"])), False, "citations"),
    "no ids": (json.dumps(written(evidence_review_ids=[])), False, "citations"),
    "repeated id": (json.dumps(written(evidence_review_ids=["R000003", "R000003"])), False, "citations"),
    "four ids": (json.dumps(written(evidence_review_ids=["R000003", "R000001", "R000002", "R000007"])), False, "citations"),
    "number id": (json.dumps(written(evidence_review_ids=[3])), False, "citations"),
    "missing": (None, False, "not valid JSON"),
    "a number": ("5", False, "response fields"),
    "null": ("null", False, "response fields"),
    "a text": ('"abc"', False, "response fields"),
    "listed body": ("[" + json.dumps(written()) + "]", False, "response fields"),
    "nested topic": (json.dumps(written(topic_id=[0])), False, "category or topic"),
    "nested category": (json.dumps(written(category={"a": 1})), False, "category or topic"),
    "nested topic of unknown category": (json.dumps(written(category="Sales", topic_id=[0])), False, "category or topic"),
    "nested id": (json.dumps(written(evidence_review_ids=[["R000003"]])), False, "citations"),
    "four nested ids": (json.dumps(written(evidence_review_ids=[["R000003"]] * 4)), False, "citations"),
}
TYPE_ERRORS = {"a number", "null", "listed body", "nested topic", "nested category", "nested id"}


def test_responses(spark, story):
    _, scores, _, pool = story
    frame = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "response_id string, content string")
    parsed = responses.parse_responses(frame)
    checks = {r.response_id: r for r in responses.validate_responses(parsed, pool).collect()}
    for name, (_, accepted, reason) in CASES.items():
        assert checks[name].accepted == accepted, (name, checks[name].reason)
        assert reason in (checks[name].reason or ""), (name, checks[name].reason)
        kind = "JSONDecodeError" if name in ("not json", "trailing text", "trailing bracket", "trailing brace", "missing") else "ValueError"
        assert checks[name].error == (None if accepted else "TypeError" if name in TYPE_ERRORS else kind), name
    kept = responses.accepted_insights(parsed, pool, scores).collect()
    assert {r.response_id for r in kept} == {k for k, v in CASES.items() if v[1]}
    one = sorted((r for r in kept if r.response_id == "plain"), key=lambda r: r.insight_id)
    assert [(r.insight_id, r.category) for r in one] == [("L1", "Product"), ("L2", "Pricing"), ("L3", "Marketing")]
    assert all(r.review_ids == ["R000003"] and r.evidence.startswith("Rank ") for r in one)
    chosen = {r.response_id: r for r in responses.choose_brief(parsed, pool, brief.brief_summary(scores)).collect()}
    assert chosen["plain"].summary == SUMMARY and chosen["plain"].warning is None and chosen["plain"].method.startswith("LLM")
    assert "(ValueError)" in chosen["unknown id"].warning and chosen["unknown id"].method.startswith("Deterministic")
    assert "(JSONDecodeError)" in chosen["not json"].warning
    assert "(TypeError)" in chosen["nested topic"].warning
    assert chosen["missing"].warning.startswith("No API key")
