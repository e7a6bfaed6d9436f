"""Predictions held against an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import RECORDS, Catalog
from plumbline.functions import text as t
from plumbline.operators.evidence import abstention_text


def result_type(predicted: Column, truth: Column, scored: Column, has_negative: Column) -> Column:
    """The six result types; the order of the cases matters."""
    return (
        F.when(~scored, "unscored")
        .when(predicted & truth, "correct_present")
        .when(~predicted & ~truth, "correct_absent")
        .when(predicted, "unsupported_addition")
        .when(has_negative, "wrong_negative")
        .otherwise("omission")
    )


def coverage_map(catalog: Catalog) -> Column:
    """prompt_id: its scored fields, as a literal map; prompts are few."""
    entries = [x for p, fields in catalog.coverage.items() for x in (F.lit(p), F.array(*map(F.lit, fields)))]
    return F.create_map(*entries)


def truth_maps(truth: DataFrame) -> DataFrame:
    """``(case_id, truths)`` from long ``(case_id, field_name, truth)``: one row to join per case."""
    return truth.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "truth"))).alias("truths"))


def field_results(found: DataFrame, truths: DataFrame, catalog: Catalog = RECORDS) -> DataFrame:
    """One row per response and field from ``evidence`` and ``truth_maps``.

    Responses join the answer key by case, once, before fields are spread. A response of a case without a key
    fails, as does a prompt that the catalog does not know: neither can be scored.
    """
    names = F.create_map(*[F.lit(x) for pair in catalog.labels.items() for x in pair])
    keyed = found.join(truths, "case_id", "left")
    truth = F.coalesce(F.col("truths"), F.raise_error(F.concat(F.lit("no answer key for case "), F.col("case_id"))).cast("map<string,boolean>"))
    covered = F.coalesce(F.try_element_at(coverage_map(catalog), F.col("prompt_id")), F.raise_error(F.concat(F.lit("no fields are scored for prompt "), F.col("prompt_id"))).cast("array<string>"))
    keyed = keyed.withColumn("truths", truth).withColumn("__covered", covered)
    rest = [c for c in found.columns if c not in ("evidence", "abstentions")]
    spread = keyed.select(*rest, "truths", "__covered", F.explode_outer("evidence").alias("e"))
    scored = F.array_contains("__covered", F.col("e.field_name"))
    actual = F.try_element_at("truths", F.col("e.field_name"))
    out = spread.select(
        *rest,
        F.col("e.field_name").alias("field_name"),
        F.element_at(names, F.col("e.field_name")).alias("field_label"),
        F.col("e.ordinal").alias("ordinal"),
        scored.alias("scored_in_prompt"),
        F.col("e.predicted").alias("predicted"),
        actual.alias("ground_truth"),
        F.when(scored, F.col("e.predicted") == actual).alias("is_match"),
        result_type(F.col("e.predicted"), actual, scored, F.size("e.negative_hits") > 0).alias("error_type"),
        F.array_join("e.positive_hits", " | ").alias("positive_hits"),
        F.array_join("e.negative_hits", " | ").alias("negative_hits"),
        F.array_join("e.positive_patterns", " | ").alias("matched_positive_patterns"),
        F.array_join("e.negative_patterns", " | ").alias("matched_negative_patterns"),
    )
    return out


def predictions(found: DataFrame, truths: DataFrame, catalog: Catalog = RECORDS) -> DataFrame:
    """One row per response: its scored fields, what was predicted and what matched, by field (null where unscored), and the hash of the answer key, keys sorted."""
    keyed = found.join(truths, "case_id", "left")
    covered = F.coalesce(F.try_element_at(coverage_map(catalog), F.col("prompt_id")), F.array().cast("array<string>"))
    scored = lambda e: F.array_contains("__covered", e["field_name"])
    match = lambda e: F.when(scored(e), e["predicted"] == F.try_element_at("truths", e["field_name"]))
    by_field = lambda value: F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["field_name"], value(e))))
    keyed = keyed.withColumn("__covered", covered)
    return keyed.select(
        "timestamp", "case_id", "model_name", "prompt_id",
        F.col("__covered").alias("scored_fields"),
        by_field(lambda e: e["predicted"]).alias("predicted_fields"),
        by_field(match).alias("matches"),
        t.digest(t.sorted_json(F.col("truths"), catalog.fields)).alias("ground_truth_hash"),
    )


def first_usage(usage: Column, *names: str) -> Column:
    """The value of the first key that is present, even if it is null; empty text if none is."""
    value = F.lit("")
    for name in reversed(names):
        value = F.when(F.map_contains_key(usage, F.lit(name)), F.try_element_at(usage, F.lit(name))).otherwise(value)
    return F.when(usage.isNull(), "").otherwise(value)


def summaries(found: DataFrame, truths: DataFrame, catalog: Catalog = RECORDS) -> DataFrame:
    """One row per response: counts, accuracy in percent to two places, abstention, tokens, hashes. No shuffle beyond the key's join."""
    keyed = found.join(truths, "case_id", "left")
    covered = F.coalesce(F.try_element_at(coverage_map(catalog), F.col("prompt_id")), F.array().cast("array<string>"))
    labels = F.create_map(*[F.lit(x) for p in catalog.coverage for x in (p, catalog.prompt_labels.get(p, p))])
    keyed = keyed.withColumn("__scored", F.filter("evidence", lambda e: F.array_contains(covered, e["field_name"])))
    right = F.size(F.filter("__scored", lambda e: e["predicted"] == F.try_element_at("truths", e["field_name"]))).cast("bigint")
    total = F.size("__scored").cast("bigint")
    usage = F.col("usage") if "usage" in found.columns else F.create_map().cast("map<string,string>")
    timing = F.col("metrics") if "metrics" in found.columns else F.create_map().cast("map<string,string>")
    predicted = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["field_name"], e["predicted"])))
    return keyed.select(
        "timestamp", "case_id", "model_name", "prompt_id",
        F.coalesce(F.try_element_at(labels, F.col("prompt_id")), F.col("prompt_id")).alias("prompt_label"),
        total.alias("scored_field_count"),
        right.alias("correct_scored_fields"),
        F.round(F.when(total > 0, right / total * 100).otherwise(0.0), 2).alias("accuracy_percent"),
        (F.size("abstentions") > 0).alias("abstention_detected"),
        abstention_text(F.col("abstentions")).alias("abstention_hits"),
        first_usage(usage, "inputTokens", "prompt_tokens", "input_tokens").alias("input_tokens"),
        first_usage(usage, "outputTokens", "completion_tokens", "output_tokens").alias("output_tokens"),
        first_usage(usage, "totalTokens", "total_tokens").alias("total_tokens"),
        first_usage(timing, "latencyMs", "latency_ms", "latency").alias("latency_ms"),
        t.digest(F.col("text")).alias("raw_response_sha256"),
        t.digest(t.sorted_json(predicted, catalog.fields)).alias("predicted_json_sha256"),
    )
