"""Rule evidence: for each text and field the first matches of its patterns, and the verdict.

Patterns are literals of one projection, so a text is normalized once and nothing is joined; a pattern
runs only where the text holds a literal that all its matches must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import RECORDS, Catalog, required_literal
from plumbline.functions import text as t
from plumbline.functions.held import held

#: Hits and patterns shown of each field and polarity.
SHOWN = 5


def first_match(text: Column, pattern: str) -> Column:
    """The first match, null without one."""
    hit = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    needed = required_literal(pattern)
    return F.when(F.contains(text, F.lit(needed)), hit) if needed else hit


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """``(hit, pattern)`` of each pattern that matches, in order."""
    if not patterns:
        return F.array().cast("array<struct<hit:string,pattern:string>>")
    each = F.array(*[F.struct(first_match(text, p).alias("hit"), F.lit(p).alias("pattern")) for p in patterns])
    return F.filter(each, lambda x: x["hit"].isNotNull())


def _shown(found: Column, part: str) -> Column:
    return F.slice(t.distinct_compact(F.transform(found, lambda x: x[part])), 1, SHOWN)


def evidence(texts: DataFrame, catalog: Catalog = RECORDS, text_col: str = "text", normalize: bool = True) -> DataFrame:
    """Adds ``evidence``, an array with one struct per field in field order, and ``abstentions``.

    A field is predicted true if a positive pattern matches and no negative one does. ``normalize`` is false for a
    text that already is normalized.
    """
    text = t.normalized(F.col(text_col)) if normalize else F.col(text_col)
    step = held(texts, __text=text)
    names = catalog.fields
    raw = [c for i, n in enumerate(names) for c in (hits(F.col("__text"), catalog.rules[n].positive).alias(f"__p{i}"), hits(F.col("__text"), catalog.rules[n].negative).alias(f"__n{i}"))]
    step = step.select(*texts.columns, abstentions(F.col("__text"), catalog).alias("abstentions"), *raw)
    each = [
        F.struct(
            F.lit(n).alias("field_name"),
            F.lit(i).alias("ordinal"),
            ((F.size(f"__p{i}") > 0) & (F.size(f"__n{i}") == 0)).alias("predicted"),
            _shown(F.col(f"__p{i}"), "hit").alias("positive_hits"),
            _shown(F.col(f"__n{i}"), "hit").alias("negative_hits"),
            _shown(F.col(f"__p{i}"), "pattern").alias("positive_patterns"),
            _shown(F.col(f"__n{i}"), "pattern").alias("negative_patterns"),
        )
        for i, n in enumerate(names)
    ]
    return step.select(*texts.columns, F.array(*each).alias("evidence"), "abstentions")


def abstentions(text: Column, catalog: Catalog = RECORDS) -> Column:
    """``(label, text)`` of all abstaining wording in a normalized text, by label, each once."""
    kind = "array<struct<label:string,text:string>>"
    if not catalog.abstention:
        return F.array().cast(kind)
    parts = []
    for label, pattern in catalog.abstention.items():
        needed = required_literal(pattern)
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        found = F.transform(found, _labelled(label))
        parts.append(F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast(kind)))
    return F.concat(*parts)


def _labelled(label: str):
    return lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"))


def abstention_text(found: Column) -> Column:
    """``label:text`` joined by bars."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["label"], x["text"])), " | ")


def by_field(found: DataFrame) -> DataFrame:
    """One row per field: the struct's members as columns beside those of the text.

    The outer form keeps Catalyst from inferring a filter on the array's size, which would work out all evidence twice.
    """
    rest = [c for c in found.columns if c not in ("evidence", "abstentions")]
    return found.select(*rest, F.explode_outer("evidence").alias("e")).select(*rest, "e.*")
