"""Text, cleanup, evidence, scoring, claims, support and audits against hand-worked results and plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import RECORDS, Catalog, Rule, required_literal
from plumbline.functions import text as t
from plumbline.operators import audits, claims, cleanup, evidence, metrics, scoring, support

SUMMARY = (
    "Aggression and task refusal occur. There is no self-injury or elopement in the record.\n\n"
    "The behavior occurs 3 times per day and lasts 10 minutes. It is maintained by escape.\n\n"
    "The BIP includes OT services and a visual schedule.\n- Break card is used daily by the student\n"
)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "text", ["donâ€™t", "Ã©cole", "ﬁne ½\r\nx", "﻿a\rb", "plain", "", None, "â pâte", "é", "a\xa0b", "Â x", "â€\x9dq"]
)
def test_repair_is_the_plain_one(spark, text):
    assert one(spark, text, t.repair) == t.repair_python(text or "")


def test_normalized(spark):
    assert one(spark, "  A–B \t\n\n\n\nC\xa0D— ", t.normalized) == "a-b c d-"


def test_scalars(spark):
    assert one(spark, "us.model:v1/x ", t.slug) == "us.model_v1_x"
    assert one(spark, "::", t.slug) == "model"
    assert [one(spark, x, t.parse_bool) for x in ("True", " yes ", "1", "y", None, "false")] == [True, True, True, False, False, False]
    assert [one(spark, x, t.parse_optional_bool) for x in ("", "None", "TRUE", "no", None)] == [None, None, True, False, None]
    assert [one(spark, x, t.safe_int) for x in ("12.9", "-3.7", "", "x", None, "inf", "nan")] == [12, -3, 0, 0, 0, 0, 0]
    assert one(spark, "a\x1cb\r\nc\n", t.lines) == ["a", "b", "c"]
    assert one(spark, "<a href=\"x\">'&", t.escape_html) == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;"


def test_lists(spark):
    items = spark.createDataFrame([(["a", "a", "", "b ", "a", "b"],)], "x array<string>")
    row = items.select(t.without_adjacent(F.col("x")), t.distinct_compact(F.col("x"))).first()
    assert row[0] == ["a", "b ", "a", "b"]
    assert row[1] == ["a", "b"]


def test_required_literals_are_required():
    for rule in RECORDS.rules.values():
        for pattern in (*rule.positive, *rule.negative):
            literal = required_literal(pattern)
            assert literal in pattern.replace("\\", "")
            for text in (SUMMARY.lower(), "no fba. 1:1 support staff, duration: 5", "3-5 times a week"):
                if re.search(pattern, text):
                    assert literal in text


def test_catalog_counts():
    assert len(RECORDS.fields) == 24
    assert (sum(len(r.positive) for r in RECORDS.rules.values()), sum(len(r.negative) for r in RECORDS.rules.values())) == (119, 48)
    assert [len(RECORDS.scored(p)) for p in ("prompt_1", "prompt_2", "prompt_3")] == [24, 19, 2]
    with pytest.raises(ValueError):
        RECORDS.scored("prompt_9")
    with pytest.raises(ValueError):
        Catalog({"a": "A"}, {})


def predicted(spark, text):
    row = evidence.evidence(spark.createDataFrame([(text,)], "text string")).first()
    return {e.field_name for e in row.evidence if e.predicted}, {e.field_name: e for e in row.evidence}, row.abstentions


def test_evidence_and_vetoes(spark):
    found, by_name, abstains = predicted(spark, SUMMARY)
    assert {"aggression_present", "task_refusal_present", "behavior_frequency_numeric_present", "function_escape_stated", "bip_exists", "ot_services_present"} <= found
    assert not {"self_injury_present", "elopement_present"} & found
    assert by_name["self_injury_present"].negative_hits == ["no self-injur"]
    assert by_name["behavior_frequency_numeric_present"].positive_hits[0] == "3 times per day"
    assert abstains == []


def test_a_veto_anywhere_wins(spark):
    found, _, _ = predicted(spark, "No aggression at home. Aggression at school.")
    assert "aggression_present" not in found


def test_abstentions(spark):
    found, _, abstains = predicted(spark, "Cannot determine whether a 1:1 ratio applies. It is not specified, not specified.")
    assert "ratio_1to1_explicitly_stated" not in found
    assert [tuple(a) for a in abstains] == [("not_specified", "not specified"), ("cannot_determine", "cannot determine")]


def test_evidence_is_that_of_python(spark):
    texts = [SUMMARY, "sensory breaks; pay attention; not documented", "BIP is not included.", "", "1 to 1 aide and 2:1 staff", "FBA data was conducted"]
    for row in evidence.evidence(spark.createDataFrame([(x,) for x in texts], "text string")).collect():
        plain = re.sub(r"\s+", " ", row.text.lower()).strip()
        for e in row.evidence:
            rule = RECORDS.rules[e.field_name]
            hits = [m[0] for p in rule.positive if (m := re.search(p, plain))]
            vetoes = [m[0] for p in rule.negative if (m := re.search(p, plain))]
            assert e.positive_hits == list(dict.fromkeys(hits))[:5]
            assert e.negative_hits == list(dict.fromkeys(vetoes))[:5]
            assert e.predicted == (bool(hits) and not vetoes)


def test_result_types(spark):
    rows = [(p, g, s, n) for p in (True, False) for g in (True, False) for s in (True, False) for n in (True, False)]
    frame = spark.createDataFrame(rows, "p boolean, g boolean, s boolean, n boolean")
    for r in frame.withColumn("y", scoring.result_type(F.col("p"), F.col("g"), F.col("s"), F.col("n"))).collect():
        want = "unscored" if not r.s else "correct_present" if r.p and r.g else "correct_absent" if not r.p and not r.g else "unsupported_addition" if r.p else "wrong_negative" if r.n else "omission"
        assert r.y == want


SMALL = Catalog({"a": "A", "b": "B"}, {"a": Rule("a", (r"\bred\b",), (r"\bno red\b",)), "b": Rule("b", (r"\bblue\b",))}, {"p": ("a", "b"), "q": ("a",)})


def test_scoring_and_metrics(spark):
    responses = spark.createDataFrame(
        [("t1", "c1", "m", "p", "red and blue"), ("t2", "c2", "m", "p", "no red"), ("t3", "c1", "n", "q", "")],
        "timestamp string, case_id string, model_name string, prompt_id string, text string",
    )
    truth = scoring.truth_maps(spark.createDataFrame([("c1", "a", True), ("c1", "b", False), ("c2", "a", True), ("c2", "b", False)], "case_id string, field_name string, truth boolean"))
    found = evidence.evidence(responses, SMALL)
    kinds = {(r.timestamp, r.field_name): r.error_type for r in scoring.field_results(found, truth, SMALL).collect()}
    assert kinds == {
        ("t1", "a"): "correct_present", ("t1", "b"): "unsupported_addition", ("t2", "a"): "wrong_negative", ("t2", "b"): "correct_absent", ("t3", "a"): "omission", ("t3", "b"): "unscored",
    }
    results = scoring.summaries(found, truth, SMALL)
    assert {r.timestamp: (r.correct_scored_fields, r.scored_field_count, r.accuracy_percent) for r in results.collect()} == {"t1": (1, 2, 50.0), "t2": (1, 2, 50.0), "t3": (0, 1, 0.0)}
    means = {(r.grouped, r.prompt_id, r.model_name): r.average_accuracy for r in metrics.average_accuracy(results, ["prompt_id"], ["model_name"]).collect()}
    assert means[("", None, None)] == 33.33 and means[("prompt_id", "p", None)] == 50.0 and means[("model_name", None, "n")] == 0.0
    tallies = metrics.field_tallies(scoring.field_results(found, truth, SMALL))
    assert [tuple(r) for r in metrics.ranking(tallies, "misses").collect()] == [("a", 2), ("b", 1)]


def test_missing_key_fails(spark):
    responses = spark.createDataFrame([("t", "c", "m", "p", "red")], "timestamp string, case_id string, model_name string, prompt_id string, text string")
    truth = spark.createDataFrame([], "case_id string, truths map<string,boolean>")
    with pytest.raises(Exception, match="no answer key for case c"):
        scoring.field_results(evidence.evidence(responses, SMALL), truth, SMALL).collect()


def test_first_usage(spark):
    frame = spark.createDataFrame([({"prompt_tokens": None, "input_tokens": "5"},), ({"input_tokens": "7"},), ({},), (None,)], "u map<string,string>")
    assert [r[0] for r in frame.select(scoring.first_usage(F.col("u"), "inputTokens", "prompt_tokens", "input_tokens")).collect()] == [None, "7", "", ""]


FORM = (
    "Student yells in class | POINTS TO CONSIDER | Does the student need supports?\n\n"
    "Form 6d something\nStudent yells in class\nSTUDENT YELLS IN CLASS\n  Likes   drawing \n"
)


def test_cleanup(spark):
    row = cleanup.clean(spark.createDataFrame([("d", FORM), ("e", None)], "id string, raw_text string")).orderBy("id").collect()
    assert row[0].cleaned_text == "Student yells in class\nLikes drawing"
    assert row[0].audit.removed_by_reason == {"duplicate_extracted_line": 2, "template_only_line": 1, "template_points_to_consider": 1}
    assert (row[0].audit.raw_line_count, row[0].audit.cleaned_line_count, row[0].audit.removed_count) == (5, 2, 4)
    assert [x.reason for x in row[0].removed][0] == "template_points_to_consider"
    assert row[1].cleaned_text == "" and row[1].audit.removed_count == 0


def test_cleanup_is_idempotent(spark):
    once = cleanup.clean(spark.createDataFrame([(FORM,)], "raw_text string")).select(F.col("cleaned_text").alias("raw_text"))
    again = cleanup.clean(once).first()
    assert again.cleaned_text == again.raw_text and again.audit.removed_count == 0


def test_units_and_claims(spark):
    units = claims.breakdown(spark.createDataFrame([(SUMMARY,)], "text string")).first().units
    assert [u.source_text for u in units][:3] == ["Aggression and task refusal occur.", "There is no self-injury or elopement in the record.", "The behavior occurs 3 times per day and lasts 10 minutes."]
    assert units[-1].source_text == "Break card is used daily by the student" and units[-1].claim_type == "accommodation"
    kept = [u for u in units if u.looks_like_claim]
    assert [u.claim_id for u in kept] == [f"claim_{i:03d}" for i in range(1, len(kept) + 1)]
    assert all(u.claim_id is None and u.claim_type is None for u in units if not u.looks_like_claim)


def test_claim_types_by_precedence(spark):
    texts = ["maintained by escape with ot services", "The BIP has a timer", "a visual schedule", "crisis staffing", "needs supervision", "It should change", "yelling", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(claims.claim_type(F.col("x"))).collect()]
    assert got == ["function", "service", "accommodation", "safety", "staffing_or_support", "recommendation", "behavior", "other"]


def test_keywords(spark):
    assert one(spark, "Students include: the bus, buses 1:1 with class", support.keywords) == ["student", "include:", "bus", "buse", "1:1", "clas"]


def test_support_ladder(spark):
    source = "The student receives speech therapy twice a week || uses a break card when upset\nMath goals were met"
    text = (
        "- uses a break card when upset\n- The student receives speech therapy weekly sessions\n- The duration is not specified in documents\n"
        "- The student needs a helicopter and support from pilots\n- student goals include reading math and support\n"
    )
    cut = claims.breakdown(spark.createDataFrame([("c", text)], "case_id string, text string"))
    row = support.support(cut, support.sources(spark.createDataFrame([("c", source)], "case_id string, text string"))).first()
    assert [c.support_status for c in row.claims] == ["supported", "supported", "unclear", "unsupported", "unclear"]
    assert row.claims[0].support_score == 1.0 and row.claims[1].support_evidence == "The student receives speech therapy twice a week"
    assert row.claim_support_counts == {"supported": 2, "unclear": 2, "unsupported": 1} and row.claim_count == 5
    alone = support.support(cut, support.sources(spark.createDataFrame([("other", source)], "case_id string, text string"))).first()
    assert {c.support_status for c in alone.claims} == {"not_checked"}


def test_contained(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta\ngamma delta epsilon zeta yy"), (2, "alpha beta gamma"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "alpha beta\ngamma delta epsilon zeta"), (2, "beta gam"), (3, ""), (4, "pha beta\ngamma delta epsilon ze")], "item_id int, text string")
    assert sorted(map(tuple, support.contained(docs, items).collect())) == [(1, 1), (1, 4), (2, 2)]


def test_audits(spark):
    rows = [(True, True, False), (True, False, True), (False, False, True), (False, True, True), (False, False, False)]
    frame = spark.createDataFrame(rows, "truth boolean, c boolean, r boolean")
    got = [r[0] for r in frame.select(audits.review_status(F.col("truth"), F.col("c"), F.col("r"))).collect()]
    assert got == ["source_hit_found", "needs_manual_note_true_field", "template_hit_removed", "needs_manual_review_false_field", "not_found_in_source"]
    truth = spark.createDataFrame([("b", "f", True), ("a", "f", True), ("a", "g", False)], "case_id string, field_name string, truth boolean")
    found = {r.field_name: r for r in audits.case_set(truth).collect()}
    assert found["f"].true_cases == ["a", "b"] and found["f"].always_true and found["g"].never_true
    cases = spark.createDataFrame([("a",)], "case_id string")
    assert {r.field_name for r in audits.missing_answers(cases, truth.withColumn("field_name", F.lit("bip_exists"))).collect()} == set(RECORDS.fields) - {"bip_exists"}
