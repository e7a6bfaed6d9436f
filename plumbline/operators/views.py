"""Views of results and field results for those who read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as t

#: Percent of accuracy from which a result is good, and below which it is bad.
GOOD, BAD = 85, 70


def accuracy_class(accuracy: Column) -> Column:
    return F.when(accuracy >= GOOD, "good").when(accuracy < BAD, "bad").otherwise("")


def misses(results: DataFrame) -> Column:
    return F.greatest(F.coalesce("scored_field_count", F.lit(0)) - F.coalesce("correct_scored_fields", F.lit(0)), F.lit(0))


def result_view(results: DataFrame) -> DataFrame:
    """Adds ``misses``, ``accuracy_class`` and a line that sums the result up."""
    shown = results.withColumn("misses", misses(results)).withColumn("accuracy_class", accuracy_class(F.col("accuracy_percent")))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    said = F.concat(
        F.lit("Accuracy "), number("accuracy_percent"), F.lit("% | Correct "), number("correct_scored_fields"), F.lit("/"), number("scored_field_count"),
        F.lit(" | Misses "), F.col("misses").cast("string"), F.lit(" | Abstention "), F.when(F.col("abstention_detected"), "Yes").otherwise("No"),
    )
    return shown.withColumn("summary", said)


def truth_word(value: Column) -> Column:
    return F.when(value.isNull(), "Unscored").when(value, "Yes").otherwise("No")


def field_outcome(error_type: Column, is_match: Column) -> Column:
    """The result type, or what the match says where none is given."""
    given = F.nullif(F.coalesce(error_type, F.lit("")), F.lit(""))
    return F.coalesce(given, F.when(is_match.isNull(), "unscored").when(is_match, "match").otherwise("miss"))


def field_view(field_results: DataFrame) -> DataFrame:
    """Adds ``outcome`` and the words for prediction, truth and match."""
    word = lambda c: truth_word(F.col(c)).alias(f"{c}_word")
    return field_results.select("*", field_outcome(F.col("error_type"), F.col("is_match")).alias("outcome"), word("predicted"), word("ground_truth"), word("is_match"))


def unit_label(looks_like_claim: Column) -> Column:
    return F.when(looks_like_claim, "kept").otherwise("dropped")


def public_path(path: str, root: str) -> str:
    """``path`` from ``root`` on, or its last name if it lies elsewhere."""
    path, root = path.rstrip("/"), root.rstrip("/")
    return path[len(root) + 1 :] if path.startswith(root + "/") else path.rsplit("/", 1)[-1]


def escaped(rows: DataFrame, *columns: str) -> DataFrame:
    """Texts made safe for HTML."""
    return rows.withColumns({c: t.escape_html(F.col(c)) for c in columns})
