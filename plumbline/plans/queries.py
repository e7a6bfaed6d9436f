"""Queries over the given tables, one per operator or group of operators, each with the same result in SQL.

Documents stand for source and response texts, labels for an answer key, the turns of a conversation for
prompts and responses, benchmark items for claims to find, and events for a log of runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import UNSUPPORTABLE, Catalog, Rule
from plumbline.functions import text as t
from plumbline.functions.held import held
from plumbline.operators import audits, claims, cleanup, evidence, metrics, scoring, support, views
from plumbline.plans import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

INSULTS = ("idiot", "moron", "loser", "scum", "clown", "trash", "stupid", "pathetic", "worthless", "disgusting")
#: What is looked for in documents: their quality, their language, and what they disclose.
CORPUS = Catalog(
    labels={"low_quality": "Low quality", "toxic_language": "Toxic language", "licence_stated": "Licence stated", "secret_shown": "Secret shown"},
    rules={
        "low_quality": Rule("low_quality", (r"[%*#$&]{3}", r"[a-z]!! ", r" \| [^|]* \| "), (r"(licensed|released) under",)),
        "toxic_language": Rule("toxic_language", tuple(f"(^| ){w}( |$)" for w in INSULTS)),
        "licence_stated": Rule("licence_stated", (r"licensed under", r"released under"), (r"by-nc",)),
        "secret_shown": Rule("secret_shown", (r"password=[0-9a-f]+", r"token = ", r"akia[a-z0-9]{16}")),
    },
    coverage={"both": ("low_quality", "toxic_language"), "quality": ("low_quality",)},
    abstention={"mail": r"mail[0-9]", "licence": r"licensed under", "version": r"version [0-9]"},
)
LEXICON = claims.Lexicon(
    signals=(r"(^| )(the|and|of)( |$)", r"(^| )(que|de|la)( |$)", r"[0-9]+"),
    openings=(r"^the ", r"^la "),
    types={"number": r"[0-9]+", "relation": r"(^| )(of|de|von)( |$)", "article": r"(^| )(the|la|das)( |$)"},
)
TEMPLATE = (r"^licensed under", r"^this work is licensed")
GUIDANCE = r"password=[0-9a-f]+"
MARKERS = ("RELEASED UNDER",)


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns, spread over the cores where it is one file: what follows is heavy on each row."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        found = found.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if len(found.inputFiles()) < cores and name in ("documents", "conversations") else found


# --- SQL that several queries share ----------------------------------------------------------------

_KEPT = f"""
    lines AS (
        SELECT doc_id, lang, source, u.i AS pos, trim(regexp_replace(u.line, '\\s+', ' ', 'g')) AS line
        FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i) u),
    cut AS (
        SELECT *, regexp_replace(line, '{GUIDANCE}', '', 'g') AS bare, regexp_extract(line, '{GUIDANCE}') AS guided,
               regexp_matches(lower(line), '{TEMPLATE[0]}|{TEMPLATE[1]}') AS form
        FROM lines WHERE line <> ''),
    marked AS (SELECT *, strpos(upper(bare), '{MARKERS[0]}') AS spot FROM cut),
    parted AS (
        SELECT *, CASE WHEN form THEN '' WHEN spot > 0 THEN trim(regexp_replace(regexp_replace(left(bare, spot - 1), '[ |]+$', ''), '\\s+', ' ', 'g'))
                       ELSE trim(regexp_replace(bare, '\\s+', ' ', 'g')) END AS kept,
               CASE WHEN form OR spot = 0 THEN '' ELSE trim(substr(bare, spot)) END AS tail FROM marked),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(kept), kept = '' ORDER BY pos) AS nth FROM parted)
"""
_UNITS = """
    pieces AS (
        SELECT {key}, {pos} AS turn, trim(u.line) AS line, u.i AS i
        FROM {table}, LATERAL (SELECT unnest(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10))) AS line,
                               unnest(range(len(string_split(text, chr(10))))) AS i) u),
    cuts AS (
        SELECT {key}, turn, i, CASE WHEN regexp_replace(line, '^\\s*(?:[-*]+|\\d+[.)])\\s*', '') <> line
                    THEN [regexp_replace(line, '^\\s*(?:[-*]+|\\d+[.)])\\s*', '')]
                    ELSE string_split(regexp_replace(line, '([.!?])\\s+([A-Z0-9"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END AS parts FROM pieces),
    flat AS (SELECT {key}, turn, i, j, trim(regexp_replace(parts[j + 1], '\\s+', ' ', 'g')) AS unit FROM cuts, LATERAL (SELECT unnest(range(len(parts))) AS j) x),
    firsts AS (SELECT {key}, turn, unit, min(i * 1000000 + j) AS place FROM flat WHERE unit <> '' GROUP BY ALL),
    units AS (SELECT {key}, turn, unit, row_number() OVER (PARTITION BY {key}, turn ORDER BY place) AS unit_index FROM firsts)
"""
DOC_UNITS = _UNITS.format(key="doc_id", pos="0", table="documents")
TURN_UNITS = _UNITS.format(key="conv_id", pos="turn", table="conversations")


def _either(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


_CLAIM = f"(len(string_split(unit, ' ')) >= 4 AND NOT {_either('lower(unit)', LEXICON.openings)} AND {_either('lower(unit)', LEXICON.signals)})"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(unit), '{p}') THEN '{k}'" for k, p in LEXICON.types.items()) + " ELSE 'other' END"
_STOP = ", ".join(f"'{w}'" for w in support.STOP_WORDS)
_WORDS = (
    "list_distinct([CASE WHEN ends_with(w, 's') AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END "
    f"for w in regexp_extract_all(lower({{0}}), '{support.KEYWORD.replace('{', '{{').replace('}', '}}')}') if w NOT IN ({_STOP})])"
)


def _fields_sql(text: str = "text", source: str = "documents", name: str = "") -> str:
    """One row per document and field: first hits of positive and negative patterns, in order."""
    out = []
    for f, rule in CORPUS.rules.items():
        hit = lambda ps: "[x for x in [" + ", ".join(f"trim(regexp_extract(norm, '{p}'))" for p in ps) + "] if x <> '']" if ps else "[]::VARCHAR[]"
        out.append(f"SELECT doc_id, '{f}' AS field_name, {hit(rule.positive)} AS pos, {hit(rule.negative)} AS neg FROM norms{name}")
    return f"norms{name} AS (SELECT doc_id, trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')) AS norm FROM {source}), fields{name} AS (" + " UNION ALL ".join(out) + ")"


_FIELDS = _fields_sql()
_RESULTS = f"""
    {_FIELDS},
    truths AS (SELECT doc_id, 'low_quality' AS field_name, quality = 0 AS truth FROM labels UNION ALL SELECT doc_id, 'toxic_language', toxic = 1 FROM labels),
    results AS (
        SELECT d.doc_id, d.lang, d.source, f.field_name, (d.lang = 'en' OR f.field_name = 'low_quality') AS scored_in_prompt,
               len(pos) > 0 AND len(neg) = 0 AS predicted, truth AS ground_truth, len(neg) > 0 AS vetoed
        FROM fields f JOIN truths t USING (doc_id, field_name) JOIN documents d USING (doc_id)),
    typed AS (
        SELECT *, CASE WHEN scored_in_prompt THEN predicted = ground_truth END AS is_match,
               CASE WHEN NOT scored_in_prompt THEN 'unscored' WHEN predicted AND ground_truth THEN 'correct_present'
                    WHEN NOT predicted AND NOT ground_truth THEN 'correct_absent' WHEN predicted THEN 'unsupported_addition'
                    WHEN vetoed THEN 'wrong_negative' ELSE 'omission' END AS error_type FROM results),
    accuracies AS (
        SELECT doc_id, lang, source, count(*) FILTER (scored_in_prompt) AS scored_field_count, count(*) FILTER (is_match) AS correct_scored_fields,
               round(count(*) FILTER (is_match) * 100.0 / count(*) FILTER (scored_in_prompt), 2) AS accuracy_percent FROM typed GROUP BY ALL)
"""

# --- cleanup ---------------------------------------------------------------------------------------


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.clean(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"), "text", TEMPLATE, GUIDANCE, MARKERS)


@query("SELECT doc_id, len([x for x in string_split(text, chr(10)) if trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '']) AS n_lines FROM documents")
def q01_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(F.filter(t.lines(F.col("text")), lambda x: t.compact(x) != "")).cast("bigint").alias("n_lines"))


@query(f"WITH {_KEPT} SELECT doc_id, count(*) FILTER (form) AS n_form_lines, count(*) FILTER (kept <> '' AND nth = 1) AS n_kept FROM documents LEFT JOIN ranked USING (doc_id) GROUP BY doc_id")
def q02_form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cleaned(spark, sf_dir)
    return found.select("doc_id", cleanup.count_reason("removed", cleanup.LINE_REASON).alias("n_form_lines"), F.col("audit.cleaned_line_count").alias("n_kept"))


@query(f"""WITH {_KEPT} SELECT doc_id, coalesce(sha256(string_agg(kept, chr(10) ORDER BY pos) FILTER (kept <> '' AND nth = 1)), sha256('')) AS cleaned_sha256,
    count(*) FILTER (kept <> '' AND nth > 1) AS n_duplicates FROM documents LEFT JOIN ranked USING (doc_id) GROUP BY doc_id""")
def q03_cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cleaned(spark, sf_dir)
    return found.select("doc_id", t.digest(F.col("cleaned_text")).alias("cleaned_sha256"), cleanup.count_reason("removed", cleanup.DUPLICATE_REASON).alias("n_duplicates"))


@query(f"""WITH {_KEPT}, removals AS (
        SELECT lang, 'template_only_line' AS reason FROM ranked WHERE form
        UNION ALL SELECT lang, 'inline_template_guidance' FROM ranked WHERE NOT form AND guided <> ''
        UNION ALL SELECT lang, 'template_points_to_consider' FROM ranked WHERE tail <> ''
        UNION ALL SELECT lang, 'duplicate_extracted_line' FROM ranked WHERE kept <> '' AND nth > 1)
    SELECT lang, reason, count(*) AS n FROM removals GROUP BY ALL""")
def q04_removed_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _cleaned(spark, sf_dir).select("lang", F.explode_outer("audit.removed_by_reason").alias("reason", "k")).where("k > 0")
    return counts.groupBy("lang", "reason").agg(F.sum("k").alias("n"))


@query(f"WITH {_KEPT} SELECT doc_id, pos::INT AS line, kept, tail FROM ranked WHERE NOT form AND spot > 0")
def q05_marker_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode_outer(t.lines(F.col("text"))).alias("line", "raw")).where("raw is not null").select("doc_id", "line", t.compact(F.col("raw")).alias("raw"))
    bare = docs.where(~cleanup.any_of(F.lower("raw"), TEMPLATE)).withColumn("bare", F.regexp_replace("raw", GUIDANCE, ""))
    before, after = cleanup.marker_cut(F.col("bare"), MARKERS)
    return bare.where(F.contains(F.upper("bare"), F.lit(MARKERS[0]))).select("doc_id", "line", t.compact(before).alias("kept"), after.alias("tail"))


# --- claims ----------------------------------------------------------------------------------------


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    return claims.breakdown(docs, prefix=F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), lexicon=LEXICON)


@query(f"WITH {DOC_UNITS} SELECT doc_id, count(unit) AS n_units, md5(coalesce(string_agg(unit, chr(10) ORDER BY unit_index), '')) AS units_md5 FROM documents LEFT JOIN units USING (doc_id) GROUP BY doc_id")
def q06_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = held(table(spark, sf_dir, "documents", "doc_id", "text"), u=claims.units(F.col("text")))
    return found.select("doc_id", F.size("u").cast("bigint").alias("n_units"), F.md5(F.array_join("u", "\n")).alias("units_md5"))


@query(f"WITH {DOC_UNITS} SELECT lang, count(*) FILTER ({_CLAIM}) AS n_kept, count(*) FILTER (NOT {_CLAIM}) AS n_dropped FROM units JOIN documents USING (doc_id) GROUP BY lang")
def q07_claim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.size(F.filter("units", lambda u: u["looks_like_claim"]))
    found = _units(spark, sf_dir).select("lang", kept.alias("k"), F.size("units").alias("n")).where("n > 0")
    return found.groupBy("lang").agg(F.sum("k").alias("n_kept"), F.sum(F.col("n") - F.col("k")).alias("n_dropped"))


@query(f"WITH {DOC_UNITS} SELECT source, {_TYPE} AS claim_type, count(*) AS n FROM units JOIN documents USING (doc_id) WHERE {_CLAIM} GROUP BY ALL")
def q08_claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.transform(F.filter("units", lambda u: u["looks_like_claim"]), lambda u: u["claim_type"])
    counts = _units(spark, sf_dir).select("source", F.explode_outer(claims.count_by(kept)).alias("claim_type", "k")).where("k > 0")
    return counts.groupBy("source", "claim_type").agg(F.sum("k").alias("n"))


@query(f"SELECT doc_id, len({_WORDS.format('text')}) AS n_keywords FROM documents")
def q09_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(support.keywords(F.col("text"))).cast("bigint").alias("n_keywords"))


# --- evidence --------------------------------------------------------------------------------------


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"), CORPUS).drop("text")


@query(f"WITH {_FIELDS} SELECT field_name, count(*) FILTER (len(pos) > 0) AS n_hit, count(*) FILTER (len(neg) > 0) AS n_vetoed, count(*) FILTER (len(pos) > 0 AND len(neg) = 0) AS n_predicted FROM fields GROUP BY field_name")
def q10_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.by_field(_evidence(spark, sf_dir))
    return rows.groupBy("field_name").agg(
        F.count_if(F.size("positive_hits") > 0).alias("n_hit"), F.count_if(F.size("negative_hits") > 0).alias("n_vetoed"), F.count_if("predicted").alias("n_predicted")
    )


@query(f"""WITH {_FIELDS}, each AS (SELECT doc_id, field_name, x.hit, min(x.i) AS i FROM fields, LATERAL (SELECT unnest(pos) AS hit, unnest(range(len(pos))) AS i) x GROUP BY ALL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY i) AS nth FROM each)
    SELECT doc_id, field_name, string_agg(hit, ' | ' ORDER BY i) AS hits FROM firsts WHERE nth <= 5 GROUP BY ALL""")
def q11_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.by_field(_evidence(spark, sf_dir)).where(F.size("positive_hits") > 0)
    return rows.select("doc_id", "field_name", F.array_join("positive_hits", " | ").alias("hits"))


@query("WITH norms AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM documents)" + " UNION ALL ".join(
    f" SELECT DISTINCT doc_id, '{label}' AS label, unnest(regexp_extract_all(norm, '{p}')) AS hit FROM norms" for label, p in CORPUS.abstention.items()))
def q12_labelled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", t.normalized(F.col("text")).alias("n"))
    return docs.select("doc_id", F.explode_outer(evidence.abstentions(F.col("n"), CORPUS)).alias("a")).where("a is not null").select("doc_id", "a.label", F.col("a.text").alias("hit"))


# --- scoring ---------------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence of the labelled documents as responses, and their answer key."""
    labels = table(spark, sf_dir, "labels")
    key = F.create_map(F.lit("low_quality"), F.col("quality") == 0, F.lit("toxic_language"), F.col("toxic") == 1)
    truths = labels.select(F.col("doc_id").cast("string").alias("case_id"), key.alias("truths"))
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    prompt = F.when(F.col("lang") == "en", "both").otherwise("quality")
    responses = docs.select(F.col("doc_id").cast("string").alias("case_id"), "lang", "source", prompt.alias("prompt_id"), F.lit("").alias("timestamp"), F.lit("corpus").alias("model_name"), "text")
    return evidence.evidence(responses, CORPUS), truths


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truths = _scored(spark, sf_dir)
    rows = scoring.field_results(found.drop("text"), truths, CORPUS).where(F.col("field_name").isin("low_quality", "toxic_language"))
    return rows.withColumn("doc_id", F.col("case_id").cast("bigint"))


def _accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir)
    right = rows.groupBy("doc_id", "lang", "source").agg(F.count_if("scored_in_prompt").alias("scored_field_count"), F.count_if("is_match").alias("correct_scored_fields"))
    return right.withColumn("accuracy_percent", F.round(F.col("correct_scored_fields") * 100.0 / F.col("scored_field_count"), 2))


@query(f"WITH {_RESULTS} SELECT doc_id, field_name, scored_in_prompt, predicted, ground_truth, coalesce(is_match::VARCHAR, 'none') AS is_match, error_type FROM typed")
def q13_field_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "field_name", "scored_in_prompt", "predicted", "ground_truth", F.coalesce(F.col("is_match").cast("string"), F.lit("none")).alias("is_match"), "error_type")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each labelled document; its source stands for the model."""
    found, truths = _scored(spark, sf_dir)
    return scoring.summaries(found.withColumn("model_name", F.col("source")), truths, CORPUS)


@query(f"""WITH {_RESULTS}, named AS (SELECT source AS model_name, CASE WHEN lang = 'en' THEN 'both' ELSE 'quality' END AS prompt_id, accuracy_percent FROM accuracies)
    SELECT model_name, prompt_id, round(avg(accuracy_percent), 2) AS average_accuracy, count(*) AS evaluations,
    CASE WHEN grouping(model_name) = 0 THEN 'model_name' WHEN grouping(prompt_id) = 0 THEN 'prompt_id' ELSE '' END AS grouped
    FROM named GROUP BY GROUPING SETS ((model_name), (prompt_id), ())""")
def q14_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_accuracy(_summaries(spark, sf_dir), ["model_name"], ["prompt_id"])


@query(f"""WITH {_RESULTS} SELECT doc_id::VARCHAR AS case_id, source AS model_name, CASE WHEN lang = 'en' THEN 'both' ELSE 'quality' END AS prompt_id, scored_field_count,
    correct_scored_fields, accuracy_percent, {_either("norm", tuple(CORPUS.abstention.values()))} AS abstention_detected, sha256(text) AS raw_response_sha256,
    sha256('{{' || (SELECT string_agg('"' || f.field_name || '": ' || (len(pos) > 0 AND len(neg) = 0)::VARCHAR, ', ' ORDER BY f.field_name) FROM fields f WHERE f.doc_id = a.doc_id) || '}}') AS predicted_json_sha256
    FROM accuracies a JOIN norms USING (doc_id) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)""")
def q35_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).select(
        "case_id", "model_name", "prompt_id", "scored_field_count", "correct_scored_fields", "accuracy_percent", "abstention_detected", "raw_response_sha256", "predicted_json_sha256"
    )


@query(f"""WITH {_RESULTS} SELECT doc_id::VARCHAR AS case_id, string_agg(field_name || ':' || predicted::VARCHAR || ':' || coalesce(is_match::VARCHAR, 'none'), ';' ORDER BY field_name) AS fields,
    sha256('{{"licence_stated": false, "low_quality": ' || bool_or(field_name = 'low_quality' AND ground_truth)::VARCHAR || ', "secret_shown": false, "toxic_language": ' || bool_or(field_name = 'toxic_language' AND ground_truth)::VARCHAR || '}}') AS ground_truth_hash
    FROM typed GROUP BY doc_id""")
def q36_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truths = _scored(spark, sf_dir)
    rows = scoring.predictions(found, truths, CORPUS)
    one = lambda f: F.concat_ws(":", F.lit(f), F.element_at("predicted_fields", f).cast("string"), F.coalesce(F.element_at("matches", f).cast("string"), F.lit("none")))
    return rows.select("case_id", F.concat_ws(";", one("low_quality"), one("toxic_language")).alias("fields"), "ground_truth_hash")


@query(f"""WITH {_RESULTS}, ends AS (SELECT doc_id, accuracy_percent, row_number() OVER (ORDER BY accuracy_percent DESC, doc_id) AS best, row_number() OVER (ORDER BY accuracy_percent, doc_id) AS worst FROM accuracies)
    SELECT 'best' AS which, doc_id, accuracy_percent FROM ends WHERE best <= 5 UNION ALL SELECT 'weakest', doc_id, accuracy_percent FROM ends WHERE worst <= 5""")
def q15_best_and_weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _accuracies(spark, sf_dir).withColumn("seq", F.col("doc_id"))
    end = lambda best, name: metrics.runs_at_end(rows, best).select(F.lit(name).alias("which"), "doc_id", "accuracy_percent")
    return end(True, "best").unionByName(end(False, "weakest"))


@query(f"WITH {_RESULTS} SELECT field_name, count(*) AS n FROM typed WHERE is_match = false GROUP BY field_name ORDER BY n DESC, field_name LIMIT 10")
def q16_most_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking(metrics.field_tallies(_fields(spark, sf_dir)), "misses")


@query(f"""WITH {_RESULTS} SELECT field_name, count(*) FILTER (is_match = false) AS misses, count(*) FILTER (error_type = 'unsupported_addition') AS false_positives,
    count(*) FILTER (error_type IN ('omission', 'wrong_negative')) AS omissions FROM typed WHERE scored_in_prompt GROUP BY field_name""")
def q17_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.field_tallies(_fields(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT error_type, count(*) AS n FROM typed WHERE scored_in_prompt GROUP BY error_type")
def q17b_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_types(_fields(spark, sf_dir))


# --- support ---------------------------------------------------------------------------------------


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q18_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each unit of an assistant's turn the best unit of the turns before it in the conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", claims.units(F.col("text")).alias("u"))
    units = turns.select("conv_id", "turn", "role", F.posexplode_outer("u").alias("i", "text")).where("text is not null").select(
        "conv_id", "turn", "role", (F.col("turn") * 100_000 + F.col("i")).alias("unit"), "text", support.keywords(F.col("text")).alias("words")
    )
    asked = units.where("role = 'assistant'").select("conv_id", F.col("unit").alias("claim"), F.col("turn").alias("at"), "words")
    return support.best_by_join(asked, units.select("conv_id", "unit", F.col("turn").alias("before"), "text", "words"), "conv_id").join(asked.select("conv_id", "claim", F.size("words").alias("n_words")), ["conv_id", "claim"])


_BEST = f"""{TURN_UNITS},
    worded AS (SELECT u.conv_id, u.turn, c.role, u.turn * 100000 + unit_index - 1 AS unit, u.unit AS text, {_WORDS.format('u.unit')} AS words FROM units u JOIN conversations c ON u.conv_id = c.conv_id AND u.turn = c.turn),
    pairs AS (
        SELECT a.conv_id, a.unit AS claim, len(a.words) AS n_words, b.unit, b.text, len(list_intersect(a.words, b.words)) AS overlap
        FROM worded a LEFT JOIN worded b ON a.conv_id = b.conv_id AND b.turn < a.turn AND len(list_intersect(a.words, b.words)) > 0 WHERE a.role = 'assistant'),
    best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, claim ORDER BY overlap DESC NULLS LAST, unit) AS nth FROM pairs)
"""


@query(f"WITH {_BEST} SELECT conv_id, claim, n_words::INT AS n_words, coalesce(overlap, 0)::INT AS overlap, coalesce(unit, -1) AS unit, coalesce(text, '') AS evidence FROM best WHERE nth = 1")
def q19_best_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("conv_id", "claim", "n_words", "overlap", F.coalesce("unit", F.lit(-1)).alias("unit"), F.col("text").alias("evidence"))


@query(f"""WITH {TURN_UNITS},
    sources AS (SELECT conv_id, turn + 1 AS turn, lower(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'))) AS source, trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS text FROM conversations WHERE text <> ''),
    cells AS (
        SELECT conv_id, turn, trim(c.cell) AS cell, l.i * 100000 + c.j AS place
        FROM sources, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i) l,
             LATERAL (SELECT unnest(regexp_split_to_array(trim(l.line), '\\s+\\|\\|\\s+|\\s+\\|\\s+')) AS cell, unnest(range(len(regexp_split_to_array(trim(l.line), '\\s+\\|\\|\\s+|\\s+\\|\\s+')))) AS j) c),
    worded AS (SELECT *, {_WORDS.format("cell")} AS words FROM cells WHERE len([x for x in regexp_split_to_array(cell, '\\s+') if x <> '']) >= 3),
    claimed AS (
        SELECT u.conv_id, u.turn, unit, unit_index, {_WORDS.format("unit")} AS words FROM units u JOIN conversations c ON u.conv_id = c.conv_id AND u.turn = c.turn
        WHERE c.role = 'assistant' AND {_CLAIM}),
    pairs AS (
        SELECT c.*, s.source, w.cell, coalesce(len(list_intersect(c.words, w.words)), 0) AS overlap, w.place
        FROM claimed c LEFT JOIN sources s ON c.conv_id = s.conv_id AND c.turn = s.turn LEFT JOIN worded w ON c.conv_id = w.conv_id AND c.turn = w.turn),
    best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, unit_index ORDER BY overlap DESC, place) AS nth FROM pairs),
    judged AS (
        SELECT conv_id, turn, unit_index, CASE WHEN overlap > 0 THEN cell ELSE '' END AS cell, unit,
               CASE WHEN len(words) > 0 THEN round(overlap / len(words)::DOUBLE, 3) ELSE 0 END AS score,
               CASE WHEN source IS NULL THEN 'no_document' WHEN regexp_matches(lower(unit), '{UNSUPPORTABLE}') THEN 'abstains' WHEN contains(source, lower(unit)) THEN 'exact' WHEN len(words) = 0 THEN 'wordless'
                    WHEN 100 * overlap >= 55 * len(words) AND overlap >= 3 THEN 'supported' WHEN 100 * overlap >= 30 * len(words) AND overlap >= 2 THEN 'unclear' ELSE 'unsupported' END AS why
        FROM best WHERE nth = 1)
    SELECT conv_id, turn, unit_index, CASE why WHEN 'no_document' THEN 'not_checked' WHEN 'exact' THEN 'supported' WHEN 'abstains' THEN 'unclear' WHEN 'wordless' THEN 'unclear' ELSE why END AS support_status,
           CASE why WHEN 'exact' THEN unit WHEN 'no_document' THEN '' WHEN 'abstains' THEN '' WHEN 'wordless' THEN '' ELSE cell END AS support_evidence,
           CASE why WHEN 'exact' THEN 1.0 WHEN 'no_document' THEN 0.0 WHEN 'abstains' THEN 0.0 WHEN 'wordless' THEN 0.0 ELSE score END::DOUBLE AS support_score
    FROM judged""")
def q20_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of an assistant's turn against the turn before it; the first turn of a conversation has no document."""
    turns = table(spark, sf_dir, "conversations")
    cut = claims.breakdown(turns.where("role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("case_id"), "conv_id", "turn", "text"), lexicon=LEXICON)
    source = support.sources(turns.select(F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("case_id"), "text"))
    rows = support.support(cut, source).select("conv_id", "turn", F.explode_outer("claims").alias("c")).where("c is not null")
    return rows.select("conv_id", "turn", F.col("c.source_unit_index").alias("unit_index"), "c.support_status", "c.support_evidence", "c.support_score")


# --- audits ----------------------------------------------------------------------------------------


@query(f"""WITH {_FIELDS}, truth AS (SELECT field_name, doc_id::VARCHAR AS case_id, len(pos) > 0 AND len(neg) = 0 AS t FROM fields)
    SELECT field_name, count(*) FILTER (t) AS true_count, count(*) FILTER (NOT t) AS false_count, md5(coalesce(string_agg(case_id, ',' ORDER BY case_id) FILTER (t), '')) AS true_cases_md5,
           count(*) FILTER (t) = 0 AS never_true, count(*) FILTER (NOT t) = 0 AS always_true FROM truth GROUP BY field_name""")
def q21_never_or_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = evidence.by_field(_evidence(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("case_id"), "field_name", F.col("predicted").alias("truth"))
    return audits.case_set(truth).select("field_name", "true_count", "false_count", F.md5(F.array_join("true_cases", ",")).alias("true_cases_md5"), "never_true", "always_true")


@query(f"""WITH {_KEPT}, cleaned AS (SELECT doc_id, string_agg(kept, chr(10) ORDER BY pos) FILTER (kept <> '' AND nth = 1) AS text FROM ranked GROUP BY doc_id),
    {_FIELDS}, {_fields_sql("coalesce(c.text, '')", "documents d LEFT JOIN cleaned c USING (doc_id)", "2")},
    paired AS (SELECT f.field_name, len(f.pos) > 0 AS raw, len(g.pos) > 0 AS clean, f.field_name = 'low_quality' AND quality = 0 OR f.field_name = 'toxic_language' AND toxic = 1 AS truth
             FROM fields f JOIN fields2 g USING (doc_id, field_name) JOIN labels USING (doc_id))
    SELECT field_name, CASE WHEN truth AND clean THEN 'source_hit_found' WHEN truth THEN 'needs_manual_note_true_field' WHEN raw AND NOT clean THEN 'template_hit_removed'
        WHEN raw THEN 'needs_manual_review_false_field' ELSE 'not_found_in_source' END AS review_status, count(*) AS n FROM paired GROUP BY ALL""")
def q22_truth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    key = F.create_map(F.lit("low_quality"), F.col("quality") == 0, F.lit("toxic_language"), F.col("toxic") == 1)
    docs = _cleaned(spark, sf_dir).join(labels.select("doc_id", key.alias("truths")), "doc_id")
    cases = docs.select(F.col("doc_id").cast("string").alias("case_id"), F.col("text").alias("raw_text"), "cleaned_text", "truths")
    return audits.truth_audit(cases, CORPUS).groupBy("field_name", "review_status").agg(F.count("*").alias("n"))


@query("""WITH asked AS (SELECT * FROM (VALUES ('large', 0), ('small', 1)) m(model_name, model_seq), (VALUES ('p1', 'What is said?'), ('p2', 'Who says it?')) q(prompt_id, question)),
    put AS (SELECT doc_id::VARCHAR AS case_id, model_name, prompt_id, model_seq, trim('You are reviewing synthetic special education documentation for research evaluation.' || chr(10) || chr(10) || 'CASE ID: ' || doc_id
        || chr(10) || chr(10) || 'IEP DOCUMENT:' || chr(10) || lang || chr(10) || chr(10) || 'BIP DOCUMENT:' || chr(10) || source || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10)
        || 'Answer naturally as if responding to a teacher. Do not output JSON unless asked.') AS model_input FROM documents, asked)
    SELECT case_id, model_name, prompt_id, model_seq, sha256(model_input) AS model_input_sha256 FROM put""")
def q23_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests for every document with every model and prompt; its language and source stand for the case's two documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source").withColumn("case_id", F.col("doc_id").cast("string"))
    kinds = F.explode(F.array(*[F.struct(F.lit(d).alias("doc_type"), F.col(c).alias("cleaned_text"), F.col(c).alias("raw_text")) for d, c in zip(runs.DOC_TYPES, ("lang", "source"), strict=True)]))
    order = docs.select("case_id", F.col("doc_id").alias("seq"))
    prompts = spark.createDataFrame([("p1", "What is said?"), ("p2", "Who says it?")], "prompt_id string, text string")
    asked = runs.requests(runs.Cases(order, docs.select("case_id", kinds.alias("d")).select("case_id", "d.*"), order), prompts, ["large", "small"])
    return asked.select("case_id", "model_name", "prompt_id", "model_seq", t.digest(F.col("model_input")).alias("model_input_sha256"))


@query("""SELECT field_name, count(*) AS n_missing FROM documents, (VALUES ('low_quality', true), ('toxic_language', true), ('licence_stated', false), ('secret_shown', false)) f(field_name, labelled)
    WHERE NOT (labelled AND doc_id IN (SELECT doc_id FROM labels)) GROUP BY field_name""")
def q24_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("case_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("case_id"), F.explode(F.array(F.lit("low_quality"), F.lit("toxic_language"))).alias("field_name"))
    return audits.missing_answers(docs, labels, CORPUS).groupBy("field_name").agg(F.count("*").alias("n_missing"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def q25_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", t.digest(F.col("text")).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'model') AS slug FROM pages")
def q26_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", t.slug(F.col("url")).alias("slug"))


# --- logs of runs ----------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def q27_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts"), "user_id", F.col("ts")).select("user_id", "event_id", "event_type")


@query("""SELECT event_type, sum(coalesce(trunc(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 0))::BIGINT AS k_sum,
    sum(coalesce(trunc(value), 0))::BIGINT AS value_sum FROM events GROUP BY event_type""")
def q28_safe_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_type", "props", "value")
    return rows.groupBy("event_type").agg(F.sum(t.safe_int(F.get_json_object("props", "$.k"))).alias("k_sum"), F.sum(t.safe_int(F.col("value"))).alias("value_sum"))


@query(f"""WITH {_RESULTS} SELECT t.doc_id::VARCHAR AS case_id, any_value(a.accuracy_percent) AS accuracy_percent, count(*) AS n_fields, string_agg(field_name || ':' || error_type, '; ' ORDER BY field_name) AS nested,
    bool_or(field_name = 'toxic_language' AND predicted) AS toxic_predicted FROM typed t JOIN accuracies a ON t.doc_id = a.doc_id GROUP BY t.doc_id""")
def q29_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truths = _scored(spark, sf_dir)
    fields = scoring.field_results(found.drop("text"), truths, CORPUS).where(F.col("field_name").isin("low_quality", "toxic_language")).withColumn("prompt_label", F.col("prompt_id"))
    rows = runs.nest(scoring.summaries(found, truths, CORPUS), fields, predicted=scoring.predictions(found, truths, CORPUS))
    text = F.array_join(F.transform("field_results", lambda x: F.concat_ws(":", x["field_name"], x["error_type"])), "; ")
    return rows.select("case_id", "accuracy_percent", F.size("field_results").cast("bigint").alias("n_fields"), text.alias("nested"), F.element_at("predicted_fields", "toxic_language").alias("toxic_predicted"))


@query("""WITH runs AS (SELECT user_id::VARCHAR AS run_id, count(*) AS n, CASE WHEN bool_or(event_type = 'error' AND value > 50) THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'completed' END AS status FROM events GROUP BY user_id)
    SELECT run_id, coalesce(status, 'none') AS status, n AS total_evaluations FROM runs WHERE (status IS NULL OR status = 'completed') AND n >= 20""")
def q30_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: failed after a grave error, without a status if there was no error at all."""
    bad = F.bool_or((F.col("event_type") == "error") & (F.col("value") > 50))
    status = F.when(bad, "failed").when(F.bool_or(F.col("event_type") == "error"), "completed")
    rows = table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(status.alias("status"), F.count("*").alias("total_evaluations"))
    return metrics.exportable(rows, 20).withColumn("status", F.coalesce("status", F.lit("none")))


@query(f"""WITH {DOC_UNITS}, kept AS (SELECT doc_id, unit, unit_index, row_number() OVER (PARTITION BY doc_id ORDER BY unit_index) AS n FROM units WHERE {_CLAIM})
    SELECT 'doc_' || doc_id || '_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS claim_id, doc_id, unit_index, {_TYPE} AS claim_type FROM kept""")
def q31_claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir).select("doc_id", F.explode_outer(F.filter("units", lambda u: u["looks_like_claim"])).alias("u")).where("u is not null")
    return rows.select("u.claim_id", "doc_id", "u.unit_index", "u.claim_type")


@query("""WITH w AS (SELECT doc_id, u.i AS i, u.w AS w FROM documents, LATERAL (SELECT unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i) u),
    full_ AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE w <> '')
    SELECT doc_id, count(*) FILTER (before IS NULL OR before <> w) AS n_kept, count(*) FILTER (before = w) AS n_repeated FROM full_ GROUP BY doc_id""")
def q32_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    kept = docs.where(F.size("w") > 0).select("doc_id", F.size("w").alias("n"), F.size(t.without_adjacent(F.col("w"))).alias("k"))
    return kept.select("doc_id", F.col("k").cast("bigint").alias("n_kept"), (F.col("n") - F.col("k")).cast("bigint").alias("n_repeated"))


@query("""WITH ordered AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations)
    SELECT conv_id, turn, role, number::INT AS number FROM ordered""")
def q33_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("""SELECT source, sum(CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END)::BIGINT AS n_true, count(*) FILTER (lang = 'fr') AS n_null FROM documents GROUP BY source""")
def q34_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text flags parsed as booleans, without and with null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang")
    flag = F.when(F.col("lang").isin("en", "de"), " True ").when(F.col("lang") == "fr", "None").otherwise("no")
    return docs.groupBy("source").agg(F.count_if(t.parse_bool(flag)).alias("n_true"), F.count_if(t.parse_optional_bool(flag).isNull()).alias("n_null"))


@query(f"""WITH {_RESULTS} SELECT count(*) AS total_evaluations, round(avg(accuracy_percent), 2) AS overall_average_accuracy, count(*) FILTER ({_either("norm", tuple(CORPUS.abstention.values()))}) AS abstention_detected_count,
    md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS case_ids_md5, string_agg(DISTINCT source, ',' ORDER BY source) AS model_names, string_agg(DISTINCT CASE WHEN lang = 'en' THEN 'both' ELSE 'quality' END, ',' ORDER BY CASE WHEN lang = 'en' THEN 'both' ELSE 'quality' END) AS prompt_ids
    FROM accuracies JOIN norms USING (doc_id)""")
def q37_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.overview(_summaries(spark, sf_dir))
    return rows.select("total_evaluations", "overall_average_accuracy", "abstention_detected_count", F.md5(F.array_join("case_ids", ",")).alias("case_ids_md5"), F.array_join("model_names", ",").alias("model_names"), F.array_join("prompt_ids", ",").alias("prompt_ids"))


@query(f"""WITH {_RESULTS}, views AS (SELECT *, greatest(scored_field_count - correct_scored_fields, 0) AS misses FROM accuracies)
    SELECT doc_id::VARCHAR AS case_id, misses, CASE WHEN accuracy_percent >= 85 THEN 'good' WHEN accuracy_percent < 70 THEN 'bad' ELSE '' END AS accuracy_class FROM views""")
def q38_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.result_view(_summaries(spark, sf_dir)).select("case_id", "misses", "accuracy_class")


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#039;')) AS escaped_sha256 FROM pages""")
def q39_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.escaped(table(spark, sf_dir, "pages", "page_id", "html"), "html").select("page_id", t.digest(F.col("html")).alias("escaped_sha256"))


@query(f"""WITH cells AS (
        SELECT doc_id, trim(c.cell) AS cell FROM documents, LATERAL (SELECT unnest(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10))) AS line) l,
            LATERAL (SELECT unnest(regexp_split_to_array(trim(l.line), '\\s+\\|\\|\\s+|\\s+\\|\\s+')) AS cell) c),
    kept AS (SELECT doc_id, cell FROM cells WHERE len([x for x in regexp_split_to_array(cell, '\\s+') if x <> '']) >= 3 AND len({_WORDS.format("cell")}) > 0)
    SELECT doc_id, count(*) AS n_units, sum(length(cell))::BIGINT AS n_chars, sum(len({_WORDS.format("cell")}))::BIGINT AS n_words FROM kept GROUP BY doc_id""")
def q40_source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sizes = lambda f: F.aggregate("source_units", F.lit(0).cast("bigint"), lambda a, u: a + f(u))
    rows = support.sources(docs, "doc_id").where(F.size("source_units") > 0)
    return rows.select("doc_id", F.size("source_units").cast("bigint").alias("n_units"), sizes(lambda u: F.length(u["text"])).alias("n_chars"), sizes(lambda u: F.size(u["words"])).alias("n_words"))
