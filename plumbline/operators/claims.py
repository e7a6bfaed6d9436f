"""Responses cut into units, and the units that make claims. Everything happens within a response's row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import CLAIM_SIGNALS, CLAIM_TYPES, NO_CLAIM
from plumbline.functions import text as t
from plumbline.functions.held import held
from plumbline.operators.cleanup import any_of

BULLET = r"^\s*(?:[-*\u2022]+|\d+[.)])\s*"
#: What BULLET does not leave as it is.
BULLET_LINE = r"^(?:[-*\u2022]|\d+[.)])"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"
#: Words of the shortest claim.
LEAST_WORDS = 4


def units(text: Column, prepared: bool = False) -> Column:
    """Bullet lines whole, other lines by sentence; blanks compacted, the first of equal units kept. ``prepared``: the text is ``claim_text``."""

    def cut(line: Column) -> Column:
        return F.when(line.rlike(BULLET_LINE), F.array(F.regexp_replace(line, BULLET, ""))).otherwise(F.split(line, SENTENCE_END))

    value = text if prepared else t.claim_text(text)
    return t.distinct_compact(F.flatten(F.transform(F.transform(F.split(value, "\n"), t.strip), cut)))


@dataclass(frozen=True)
class Lexicon:
    """What signs a claim, what opens a unit that makes none, and the types in order of precedence."""

    signals: tuple[str, ...] = CLAIM_SIGNALS
    openings: tuple[str, ...] = NO_CLAIM
    types: dict[str, str] = field(default_factory=lambda: CLAIM_TYPES)


RECORDS = Lexicon()


def looks_like_claim(unit: Column, lexicon: Lexicon = RECORDS) -> Column:
    """At least LEAST_WORDS words, no opening that makes no claim, and some sign of one."""
    low = F.lower(unit)
    return (F.size(F.split(low, " ")) >= LEAST_WORDS) & ~any_of(low, lexicon.openings) & any_of(low, lexicon.signals)


def claim_type(unit: Column, lexicon: Lexicon = RECORDS) -> Column:
    """The first type, in order, whose words the unit holds; else other."""
    low = F.lower(unit)
    kind = F.when(F.lit(False), "other")
    for name, pattern in lexicon.types.items():
        kind = kind.when(low.rlike(pattern), name)
    return kind.otherwise("other")


def claim_id(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def breakdown(responses: DataFrame, text_col: str = "text", prefix: Column | str = "claim", lexicon: Lexicon = RECORDS) -> DataFrame:
    """Adds ``units``: (unit_index from one, source_text, normalized_text, looks_like_claim, claim_type, claim_id).

    Claims are numbered among themselves; other units have neither type nor id.
    """
    name = F.lit(prefix) if isinstance(prefix, str) else prefix
    step = held(responses, __units=units(F.col(text_col)), __prefix=name)
    step = held(step, __kept=F.filter("__units", lambda u: looks_like_claim(u, lexicon)))

    def unit(u: Column, i: Column) -> Column:
        kept = F.array_position("__kept", u)
        return F.struct(
            (i + 1).cast("bigint").alias("unit_index"),
            u.alias("source_text"),
            F.lower(u).alias("normalized_text"),
            (kept > 0).alias("looks_like_claim"),
            F.when(kept > 0, claim_type(u, lexicon)).alias("claim_type"),
            F.when(kept > 0, claim_id(F.col("__prefix"), kept)).alias("claim_id"),
        )

    return held(step, units=F.transform("__units", unit)).drop("__units", "__prefix", "__kept")


def count_by(values: Column) -> Column:
    """A map of how often each value stands in an array, keys sorted."""
    keys = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(values, lambda v: v == k)).cast("bigint")))
