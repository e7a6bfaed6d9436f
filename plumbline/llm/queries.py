"""The thin queries over the given tables: ``op<N>_<name>``, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, language, licences, mix, neighbours, pii, quality, simhash, toxicity
from plumbline.llm.shared import fold

#: Score from which a document is toxic.
TOXIC = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = quality.train(docs, labels, fold("doc_id", 3) != 1)
    found = quality.score(docs, forest).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count(base, k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(pii.digest(F.col("spans"), True), 256).alias("base_sha256"),
        pii.digest(F.col("spans"), False).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.documents_scores(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``; of a file without a licence all columns are empty or zero."""
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))
    doc_id = F.element_at(F.split("path", "/"), -1).cast("long")
    given = {"licence": F.lit(""), "found": F.lit("none"), "origin": F.lit("")}
    rest = {c: F.coalesce(c, empty).alias(c) for c, empty in given.items()}
    return found.select(doc_id.alias("doc_id"), rest["licence"], F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"), rest["found"], rest["origin"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
        F.concat_ws(",", F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("offending"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rendered(chat.repair(table(spark, sf_dir, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), "turn_no", "role", "text", "n_given", "rendered")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "item_id", "similarity", "start", "n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_neighbours": op2_neighbours,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_licences": op5_licences,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_mix": op8_mix,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
}

_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({whole}, {number}, '{name}', '{w}', {n})" for number, (whole, name, ws) in enumerate(licences.templates()) for w, n in sorted(ws.items()))


#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op5_licences": rf"""
        WITH templates(whole, number, name, w, n) AS (VALUES {_TEMPLATES}),
        total AS (SELECT count(DISTINCT number) AS n FROM templates),
        idf AS (SELECT w, ln((1 + (SELECT n FROM total)) / (1.0 + count(*))) + 1 AS idf FROM templates GROUP BY w),
        lengths AS (SELECT number, sqrt(sum((n * idf) ** 2)) AS length FROM templates JOIN idf USING (w) GROUP BY number),
        files AS (
            SELECT row_number() OVER () AS file_no, doc_id, concat_ws('/', source, lang) AS directory, coalesce(text, '') AS text FROM documents),
        marked AS (SELECT * FROM files WHERE regexp_matches(text, '{licences.MARKS}')),
        lines AS (SELECT file_no, unnest(string_split(text, chr(10))) AS unit FROM marked),
        parts AS (
            SELECT file_no, unnest(regexp_split_to_array(text, '{licences.BLANK}')) AS unit FROM marked
            UNION ALL SELECT * FROM lines
            UNION ALL SELECT file_no, unnest(regexp_split_to_array(unit, '{licences.STOP}')) FROM lines WHERE regexp_matches(unit, '{licences.MARKS}')),
        units AS (
            SELECT DISTINCT file_no, false AS whole, unit FROM parts WHERE regexp_matches(unit, '{licences.MARKS}')
            UNION ALL SELECT file_no, true, text FROM marked),
        numbered AS (SELECT row_number() OVER () AS unit_no, * FROM units),
        of_unit AS (SELECT unit_no, whole, w, count(*)::DOUBLE AS tf FROM (SELECT unit_no, whole, unnest({_WORDS.format("unit")}) AS w FROM numbered) GROUP BY ALL),
        norms AS (
            SELECT unit_no, sqrt(sum((tf * coalesce(idf, ln(1 + (SELECT n FROM total)) + 1)) ** 2)) AS norm
            FROM of_unit LEFT JOIN idf USING (w) GROUP BY unit_no),
        scores AS (
            SELECT unit_no, number, name, sum(u.tf * t.n * idf ** 2) / (any_value(norm) * any_value(length)) AS score
            FROM of_unit u JOIN templates t ON u.w = t.w AND u.whole = t.whole JOIN idf ON idf.w = u.w JOIN norms USING (unit_no) JOIN lengths USING (number)
            GROUP BY unit_no, number, name),
        good AS (
            SELECT file_no, whole, name, score FROM scores JOIN numbered USING (unit_no)
            WHERE score >= CASE WHEN whole THEN {licences.FILE} ELSE {licences.HEADER} END),
        own AS (
            SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY file_no ORDER BY whole DESC, round(score, 12) DESC, name) = 1),
        licensed AS (
            SELECT directory AS ancestor, name, score FROM good JOIN files USING (file_no) WHERE whole
            QUALIFY row_number() OVER (PARTITION BY directory ORDER BY round(score, 12) DESC, name) = 1),
        above AS (
            SELECT DISTINCT directory, array_to_string(string_split(directory, '/')[1:i], '/') AS ancestor
            FROM (SELECT directory, unnest(range(0, len(string_split(directory, '/')) + 1)) AS i FROM (SELECT DISTINCT directory FROM files))),
        nearest AS (
            SELECT directory, ancestor, name, score FROM above JOIN licensed USING (ancestor)
            QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(ancestor) DESC) = 1)
        SELECT doc_id, coalesce(o.name, n.name, '') AS licence, coalesce(round(coalesce(o.score, n.score), 6), 0.0) AS score,
               CASE WHEN o.whole THEN 'text' WHEN o.name IS NOT NULL THEN 'header' WHEN n.name IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
               CASE WHEN o.name IS NULL AND n.name IS NOT NULL THEN n.ancestor ELSE '' END AS origin
        FROM files f LEFT JOIN own o USING (file_no) LEFT JOIN nearest n ON f.directory = n.directory
    """,
    "op8_mix": """
        WITH numbered AS (SELECT row_number() OVER () AS row_no, * FROM documents),
        sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        means AS (
            SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * 1.0 / ((SELECT count(*) FROM sizes)::DOUBLE * n) AS rate,
                   greatest(1, ceil((SELECT sum(n) FROM sizes)::DOUBLE * 1.0 / ((SELECT count(*) FROM sizes)::DOUBLE * n) / 8.0))::INT AS parts
            FROM sizes),
        terms AS (SELECT source, parts, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM means, range(48) AS t(k)),
        cumulative AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
        keyed AS (
            SELECT row_no, d.source, part, ('0x' || substr(md5('17|' || part || '|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM numbered d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, range(1, m.parts + 1) AS t(part)),
        counted AS (
            SELECT row_no, count(*) AS copies
            FROM keyed k JOIN cumulative c ON k.source IS NOT DISTINCT FROM c.source AND c.c <= k.u GROUP BY row_no)
        SELECT d.* EXCLUDE (row_no), copy::INT AS copy FROM numbered d JOIN counted c USING (row_no), range(1, c.copies + 1) AS t(copy)
    """,
}
