"""Answer keys held against source documents, and a case set against what it can test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import RECORDS, Catalog
from plumbline.functions import text as t
from plumbline.operators.evidence import evidence


def review_status(truth: Column, in_clean: Column, in_raw: Column) -> Column:
    """Positive hits decide; vetoes do not matter here."""
    return (
        F.when(truth & in_clean, "source_hit_found")
        .when(truth, "needs_manual_note_true_field")
        .when(in_raw & ~in_clean, "template_hit_removed")
        .when(in_raw, "needs_manual_review_false_field")
        .otherwise("not_found_in_source")
    )


def truth_audit(cases: DataFrame, catalog: Catalog = RECORDS) -> DataFrame:
    """From ``(case_id, raw_text, cleaned_text, truths)``: one row per case and field. Each text is normalized once."""
    clean = evidence(cases.withColumnRenamed("evidence", "__e") if "evidence" in cases.columns else cases, catalog, "cleaned_text").withColumnRenamed("evidence", "clean").drop("abstentions")
    both = evidence(clean, catalog, "raw_text").withColumnRenamed("evidence", "raw").drop("abstentions")
    spread = both.select("case_id", "truths", F.explode_outer(F.arrays_zip("clean", "raw")).alias("z"))
    name = F.col("z.clean.field_name")
    truth = F.coalesce(F.try_element_at("truths", name), F.lit(False))
    labels = F.create_map(*[F.lit(x) for pair in catalog.labels.items() for x in pair])
    return spread.select(
        "case_id",
        name.alias("field_name"),
        F.element_at(labels, name).alias("field_label"),
        truth.alias("ground_truth"),
        review_status(truth, F.size("z.clean.positive_hits") > 0, F.size("z.raw.positive_hits") > 0).alias("review_status"),
        F.col("z.clean.positive_hits").alias("cleaned_positive_hits"),
        F.col("z.clean.negative_hits").alias("cleaned_negative_hits"),
        F.col("z.raw.positive_hits").alias("raw_positive_hits"),
        F.col("z.raw.negative_hits").alias("raw_negative_hits"),
        F.col("z.clean.ordinal").alias("ordinal"),
    )


def text_hashes(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", t.digest(F.col("raw_text")).alias("raw_text_hash"), t.digest(F.col("cleaned_text")).alias("cleaned_text_hash"))


def case_set(truth: DataFrame) -> DataFrame:
    """``(field_name, true_count, false_count, true_cases, false_cases, never_true, always_true)``.

    Case lists are as long as the case set, which is a study's; counts alone would need no list.
    """
    case = lambda wanted: F.array_sort(F.collect_list(F.when(F.col("truth") == wanted, F.col("case_id"))))
    out = truth.groupBy("field_name").agg(
        F.count_if(F.col("truth")).alias("true_count"),
        F.count_if(~F.col("truth")).alias("false_count"),
        case(True).alias("true_cases"),
        case(False).alias("false_cases"),
    )
    return out.withColumn("never_true", F.col("true_count") == 0).withColumn("always_true", F.col("false_count") == 0)


def missing_answers(cases: DataFrame, truth: DataFrame, catalog: Catalog = RECORDS) -> DataFrame:
    """``(case_id, field_name)`` that the answer key lacks: an anti join of what is required."""
    required = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, catalog.fields))).alias("field_name"))
    return required.join(truth.select("case_id", "field_name"), ["case_id", "field_name"], "left_anti")
