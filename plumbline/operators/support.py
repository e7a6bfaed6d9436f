"""Claims held against source documents: exact text first, then the best overlap of keywords with one unit of the source.

A document's units and keywords are worked out once per document; a response meets its document in one
equi-join, and everything else happens within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import STOP_WORDS, UNSUPPORTABLE
from plumbline.functions import text as t
from plumbline.functions.held import held
from plumbline.operators.claims import count_by

KEYWORD = r"[a-z0-9][a-z0-9:-]{2,}"
CELL_BREAK = r"\s+\|\|\s+|\s+\|\s+"
#: Words of the shortest source unit that counts.
LEAST_UNIT = 3
#: Percent of a claim's keywords, and number of them, that one unit must hold: supported, and unclear.
SUPPORTED, UNCLEAR = (55, 3), (30, 2)
#: What is said of each outcome.
REASONS = {
    "empty": "empty claim",
    "abstains": "claim says the document does not specify something",
    "exact": "exact text appears in cleaned document text",
    "wordless": "not enough claim keywords to check",
    "supported": "enough claim keywords match one source text unit",
    "unclear": "some source keywords match, but not enough for a clean support call",
    "unsupported": "no close source text match found",
    "no_document": "document text was not provided",
}


def keywords(text: Column) -> Column:
    """Distinct words of three characters or more, without stop words, a final s cut off those of more than four."""
    found = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def source_units(text: Column) -> Column:
    """Cells of the lines of a ``claim_text``, of LEAST_UNIT words or more, repeats included."""
    cells = F.flatten(F.transform(t.lines(text), lambda line: F.split(t.strip(line), CELL_BREAK)))
    return F.filter(F.transform(cells, t.strip), lambda u: F.size(F.filter(F.split(u, t.SPACE), lambda w: w != "")) >= LEAST_UNIT)


def sources(documents: DataFrame, key: str = "case_id", text_col: str = "text") -> DataFrame:
    """``(key, source, source_units)``: the lower-cased text and each unit with its keywords."""
    step = documents.select(F.col(key), (F.coalesce(F.col(text_col), F.lit("")) != "").alias("given"), t.claim_text(F.col(text_col)).alias("value"))
    step = step.withColumn("cells", source_units(F.col("value")))
    pairs = F.transform("cells", lambda u: F.struct(u.alias("text"), keywords(u).alias("words")))
    return step.where("given").select(key, F.lower("value").alias("source"), F.filter(pairs, lambda p: F.size(p["words"]) > 0).alias("source_units"))


def best_unit(words: Column, candidates: Column) -> Column:
    """``(overlap, text)`` of the unit with most of the words, the first of equals; zero and empty without any."""
    none = F.struct(F.lit(0).alias("overlap"), F.lit("").alias("text"))
    scored = F.transform(candidates, lambda u: F.struct(F.size(F.array_intersect(words, u["words"])).alias("overlap"), u["text"].alias("text")))
    return F.aggregate(scored, none, lambda best, u: F.when(u["overlap"] > best["overlap"], u).otherwise(best))


def outcome(status: str, reason: str, evidence: Column, score: Column) -> Column:
    return F.struct(F.lit(status).alias("support_status"), F.lit(REASONS[reason]).alias("support_reason"), evidence.alias("support_evidence"), score.alias("support_score"))


def verdict(claim: Column, words: Column, best: Column, source: Column) -> Column:
    """The ladder: empty, abstaining, exact, without keywords, supported, unclear, unsupported. Thresholds are compared as integers."""
    low, n = F.lower(claim), F.size(words)
    score = F.round(F.when(n > 0, best["overlap"] / n).otherwise(0.0), 3)
    reached = lambda bar: (100 * best["overlap"] >= bar[0] * n) & (best["overlap"] >= bar[1])
    nothing, zero = F.lit(""), F.lit(0.0)
    return (
        F.when(source.isNull(), outcome("not_checked", "no_document", nothing, zero))
        .when(claim == "", outcome("unclear", "empty", nothing, zero))
        .when(low.rlike(UNSUPPORTABLE), outcome("unclear", "abstains", nothing, zero))
        .when(F.contains(source, low), outcome("supported", "exact", claim, F.lit(1.0)))
        .when(n == 0, outcome("unclear", "wordless", nothing, zero))
        .when(reached(SUPPORTED), outcome("supported", "supported", best["text"], score))
        .when(reached(UNCLEAR), outcome("unclear", "unclear", best["text"], score))
        .otherwise(outcome("unsupported", "unsupported", best["text"], score))
    )


def support(claims: DataFrame, documents: DataFrame, key: str = "case_id") -> DataFrame:
    """From ``breakdown`` and ``sources``: adds ``claims`` with their support, and the counts by type and status."""
    joined = claims.join(documents, key, "left")  # within the row from here on
    kept = F.transform(F.filter("units", lambda u: u["looks_like_claim"]), lambda u: F.struct(u.alias("u"), keywords(u["source_text"]).alias("words")))
    step = held(joined, __kept=kept)
    step = step.withColumn("__best", F.transform("__kept", lambda k: F.struct(k["u"].alias("u"), k["words"].alias("words"), best_unit(k["words"], F.coalesce("source_units", F.array())).alias("best"))))

    def claim(k: Column) -> Column:
        u, v = k["u"], verdict(k["u"]["source_text"], k["words"], k["best"], F.col("source"))
        return F.struct(
            u["claim_id"].alias("claim_id"), u["source_text"].alias("source_text"), u["normalized_text"].alias("normalized_text"),
            u["claim_type"].alias("claim_type"), u["unit_index"].alias("source_unit_index"), v.alias("v"),
        )

    step = step.withColumn("__claims", F.transform("__best", claim))
    flat = F.transform("__claims", lambda c: F.struct(*[c[x].alias(x) for x in ("claim_id", "source_text", "normalized_text", "claim_type", "source_unit_index")], *[c["v"][x].alias(x) for x in ("support_status", "support_reason", "support_evidence", "support_score")]))
    step = held(step, claims=flat)
    return step.select(
        *claims.columns,
        F.size("units").cast("bigint").alias("source_unit_count"),
        F.size("claims").cast("bigint").alias("claim_count"),
        count_by(F.transform("claims", lambda c: c["claim_type"])).alias("claims_by_type"),
        count_by(F.transform("claims", lambda c: c["support_status"])).alias("claim_support_counts"),
        "claims",
    )


def best_by_join(claims: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The best unit of each claim by a hash join on keywords: for sources too long to search within a row.

    claims: ``(key, claim, at, words)``; candidates: ``(key, unit, before, text, words)``. A unit may serve a claim
    if ``before < at``. Returns ``(key, claim, overlap, unit, text)``: most words, then the first unit; a claim
    without any has overlap 0, unit null and the empty text.
    """
    left = claims.select(key, "claim", "at", F.explode("words").alias("word"))
    right = candidates.select(key, "unit", "before", F.explode("words").alias("word"))
    met = left.join(right, [key, "word"]).where("before < at").groupBy(key, "claim", "unit").agg(F.count("*").cast("int").alias("overlap"))
    top = met.groupBy(key, "claim").agg(F.max(F.struct(F.col("overlap"), (-F.col("unit")).alias("minus"))).alias("top"))
    top = top.select(key, "claim", F.col("top.overlap").alias("overlap"), (-F.col("top.minus")).alias("unit"))
    found = claims.select(key, "claim").join(top, [key, "claim"], "left").join(candidates.select(key, "unit", "text"), [key, "unit"], "left")
    return found.select(key, "claim", F.coalesce("overlap", F.lit(0)).alias("overlap"), "unit", F.coalesce("text", F.lit("")).alias("text"))


#: Words of the runs by which ``contained`` finds texts, and characters for texts without a whole word within.
RUN, GRAM = 3, 3
#: Items whose runs are sent to every task; beyond, the join shuffles.
BROADCAST_ITEMS = 50_000


def contained(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``(key, item_key)`` of every item whose text stands within a document's, exactly.

    Instead of trying every pair: the inner words of an item stand in the document as they are, so the pair
    meets in a hash join on up to RUN of them; an item of one or two words meets on its first GRAM characters. Only keys and
    hashes are joined; texts are fetched for the pairs that met, and compared. Null and empty items are in none.
    """
    split = lambda c: F.split(c, r"[ \t-\r]+")
    runs = lambda ws, n: F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))
    grams = lambda s, n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.xxhash64(F.substring(s, i, F.lit(n))))
    # texts are split at white space; the first and the last word of an item may be parts of words
    items = items.select(F.col(item_key), F.col("text").alias("item_text")).where(F.coalesce("item_text", F.lit("")) != "").withColumn("ws", split("item_text"))
    texts = documents.select(key, "text").where("text is not null")
    small = items.count() <= BROADCAST_ITEMS
    few = lambda rows: F.broadcast(rows) if small else rows
    inner = F.least(F.size("ws") - 2, F.lit(RUN))
    sizes = {r[0] for r in items.select(F.when(inner > 0, inner).otherwise(-F.least(F.length("item_text"), F.lit(GRAM)))).distinct().collect()}  # six values at most
    met = None
    for size in sorted(sizes):
        if size > 0:
            wanted = items.where(inner == size).select(item_key, F.xxhash64(*[F.get("ws", F.lit(1 + k)) for k in range(size)]).alias("h"))
            spread = texts.select(key, split("text").alias("ws")).where(F.size("ws") >= size).select(key, F.explode(F.array_distinct(runs(F.col("ws"), size))).alias("h"))
        else:
            wanted = items.where((inner <= 0) & (F.least(F.length("item_text"), F.lit(GRAM)) == -size)).select(item_key, F.xxhash64(F.substring("item_text", 1, -size)).alias("h"))
            spread = texts.where(F.length("text") >= -size).select(key, F.explode(F.array_distinct(grams(F.col("text"), -size))).alias("h"))
        pairs = spread.join(few(wanted), "h").select(key, item_key)
        met = pairs if met is None else met.unionByName(pairs)
    if met is None:
        return texts.select(key).join(items.select(item_key), F.lit(True)).where("false")
    fetched = texts.join(met.distinct(), key).join(few(items.select(item_key, "item_text")), item_key)
    return fetched.where(F.contains("text", F.col("item_text"))).select(key, item_key).distinct()
