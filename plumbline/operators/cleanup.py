"""Form text removed from extracted documents, with an audit of what went and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import INLINE_GUIDANCE, MARKERS, TEMPLATE_LINES
from plumbline.functions import text as t
from plumbline.functions.held import held

#: Removals that an audit shows.
EXAMPLES = 25
LINE_REASON, GUIDANCE_REASON, MARKER_REASON, DUPLICATE_REASON = "template_only_line", "inline_template_guidance", "template_points_to_consider", "duplicate_extracted_line"


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def marker_cut(line: Column, markers: tuple[str, ...] = MARKERS) -> tuple[Column, Column]:
    """The line before the first marker, and the rest from it on (empty without one). Markers are found on the upper-cased line."""
    upper = F.upper(line)
    places = [F.nullif(F.locate(m, upper), F.lit(0)) for m in markers]
    first = F.least(*places) if len(places) > 1 else places[0]
    before = F.when(first.isNull(), line).otherwise(F.regexp_replace(F.substring(line, F.lit(1), first - 1), r"[ |]+$", ""))
    after = F.when(first.isNull(), "").otherwise(t.strip(F.substring(line, first, F.length(line))))
    return before, after


def line_parts(line: Column, template: tuple[str, ...] = TEMPLATE_LINES, guidance: str = INLINE_GUIDANCE, markers: tuple[str, ...] = MARKERS) -> Column:
    """Of a compact line: what is kept, and what is removed as (reason, text), in order."""
    item = lambda reason, what: F.struct(F.lit(reason).alias("reason"), what.alias("text"))
    whole = any_of(F.lower(line), template)
    hit = F.regexp_extract(line, guidance, 0)
    before, after = marker_cut(F.regexp_replace(line, guidance, ""), markers)
    removed = F.array(F.when(hit != "", item(GUIDANCE_REASON, hit)), F.when(after != "", item(MARKER_REASON, after)))
    return F.when(whole, F.struct(F.lit("").alias("kept"), F.array(item(LINE_REASON, line)).alias("removed"))).otherwise(
        F.struct(t.compact(before).alias("kept"), F.filter(removed, lambda x: x.isNotNull()).alias("removed"))
    )


def clean(documents: DataFrame, text_col: str = "raw_text", template: tuple[str, ...] = TEMPLATE_LINES, guidance: str = INLINE_GUIDANCE, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Adds ``cleaned_text`` and ``audit`` to each document.

    Line by line: blank lines go, form lines go whole, guidance and what follows a marker is cut out, and of
    lines equal but for case the first stays. All within the row, without a shuffle. ``audit`` has the counts of
    raw and kept lines and characters, the removals by reason, and the first EXAMPLES of them.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    cut = held(documents, __lines=F.filter(F.transform(t.lines(raw), t.compact), lambda x: x != ""))
    cut = held(cut, __parts=F.transform("__lines", lambda x: line_parts(x, template, guidance, markers)))
    cut = held(cut, __keys=F.transform("__parts", lambda p: F.lower(p["kept"])))
    # a line is a duplicate if an earlier one has its key
    first = lambda p: F.array_position("__keys", F.lower(p["kept"]))
    step = lambda p, i: F.struct(p["kept"].alias("kept"), p["removed"].alias("removed"), ((p["kept"] != "") & (first(p) <= i)).alias("again"))
    cut = held(cut, __steps=F.transform("__parts", step))
    again = lambda s: F.concat(s["removed"], F.when(s["again"], F.array(F.struct(F.lit(DUPLICATE_REASON).alias("reason"), s["kept"].alias("text")))).otherwise(F.array().cast("array<struct<reason:string,text:string>>")))
    stay = F.transform(F.filter("__steps", lambda s: (s["kept"] != "") & ~s["again"]), lambda s: s["kept"])
    cut = held(cut, __kept=stay, __removed=F.flatten(F.transform("__steps", again)))
    reasons = [GUIDANCE_REASON, DUPLICATE_REASON, LINE_REASON, MARKER_REASON]
    counts = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(r).alias("key"), count_reason("__removed", r).alias("value")) for r in sorted(reasons)]),
            lambda e: e["value"] > 0,
        )
    )
    cleaned = F.array_join("__kept", "\n")
    audit = F.struct(
        F.size("__lines").cast("bigint").alias("raw_line_count"),
        F.size("__kept").cast("bigint").alias("cleaned_line_count"),
        F.length(raw).cast("bigint").alias("raw_char_count"),
        F.length(cleaned).cast("bigint").alias("cleaned_char_count"),
        F.size("__removed").cast("bigint").alias("removed_count"),
        counts.alias("removed_by_reason"),
        F.slice("__removed", 1, EXAMPLES).alias("removed_examples"),
    )
    return cut.select(*documents.columns, cleaned.alias("cleaned_text"), audit.alias("audit"), F.col("__removed").alias("removed"))


def count_reason(removed: str, reason: str) -> Column:
    return F.size(F.filter(removed, lambda x: x["reason"] == reason)).cast("bigint")
