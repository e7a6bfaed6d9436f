"""Aggregates over results, field results and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as t

#: Fields in a ranking, and runs at either end.
FIELDS_SHOWN, RUNS_SHOWN = 10, 5


def average_accuracy(results: DataFrame, *by: Sequence[str]) -> DataFrame:
    """The mean of the rounded accuracies and the number of rows, in one pass, for all rows and for each list of columns.

    ``grouped`` tells the columns that a row is about, comma-joined.
    """
    columns = list(dict.fromkeys(c for group in by for c in group))
    sets = [[F.col(c) for c in group] for group in by] + [[]]
    grouped = results.groupingSets(sets, *map(F.col, columns)) if columns else results.groupBy()
    name = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]) if columns else F.lit("")
    return grouped.agg(F.round(F.avg("accuracy_percent"), 2).alias("average_accuracy"), F.count("*").alias("evaluations"), name.alias("grouped"))


def error_types(field_results: DataFrame) -> DataFrame:
    kept = field_results.where(F.col("scored_in_prompt") & (F.coalesce("error_type", F.lit("")) != ""))
    return kept.groupBy("error_type").agg(F.count("*").alias("n"))


def field_tallies(field_results: DataFrame) -> DataFrame:
    """Misses, false positives and omissions of each field, in one pass over scored rows."""
    return field_results.where("scored_in_prompt").groupBy("field_name").agg(
        F.count_if(~F.col("is_match")).alias("misses"),
        F.count_if(F.col("error_type") == "unsupported_addition").alias("false_positives"),
        F.count_if(F.col("error_type").isin("omission", "wrong_negative")).alias("omissions"),
    )


def ranking(tallies: DataFrame, what: str, limit: int = FIELDS_SHOWN) -> DataFrame:
    """Fields by count, then name; those of none are left out."""
    return tallies.where(F.col(what) > 0).select("field_name", F.col(what).alias("n")).orderBy(F.desc("n"), "field_name").limit(limit)


def runs_at_end(results: DataFrame, best: bool, limit: int = RUNS_SHOWN) -> DataFrame:
    """The best or weakest responses; equal ones in the order of ``seq``, either way."""
    order = F.desc("accuracy_percent") if best else F.asc("accuracy_percent")
    return results.orderBy(order, "seq").limit(limit)


def tokens(results: DataFrame) -> DataFrame:
    """Sums of the token columns; what is no number counts zero."""
    return results.agg(*[F.coalesce(F.sum(t.safe_int(F.col(c))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


def overview(results: DataFrame) -> DataFrame:
    """One row: numbers of evaluations and abstentions, average accuracy, and the sorted cases, models and prompts."""
    some = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s" if c != "model_name" else "model_names")
    return results.agg(
        F.count("*").alias("total_evaluations"),
        F.coalesce(F.round(F.avg("accuracy_percent"), 2), F.lit(0.0)).alias("overall_average_accuracy"),
        F.count_if("abstention_detected").alias("abstention_detected_count"),
        some("case_id"), some("model_name"), some("prompt_id"),
    )


def exportable(runs: DataFrame, least: int = 0) -> DataFrame:
    """Of ``runs(run_id, status, total_evaluations)`` those that are completed, or have no status, and have at least so many evaluations."""
    enough = F.coalesce("total_evaluations", F.lit(0)) >= least if least > 0 else F.lit(True)
    return runs.where((F.col("status").isNull() | (F.col("status") == "completed")) & enough)


def support_counts(claims: DataFrame) -> DataFrame:
    """Claims by support status, from the maps that each response carries."""
    return claims.select(F.explode("claim_support_counts").alias("support_status", "n")).groupBy("support_status").agg(F.sum("n").alias("n"))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key, by aggregation rather than a window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
