"""The engine's verbs: validate, extract, run, report, export and verify."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.catalog import RECORDS, RESULT_TYPES, Catalog
from plumbline.functions import text as t
from plumbline.operators import audits, claims, cleanup, evidence, metrics, scoring, support, views
from plumbline.plans import report as reports
from plumbline.sources import backends, docx, files
from plumbline.sources.store import Store

#: Longest input put to a model, in characters.
MOST_INPUT = 120_000
#: Requests that are put to a model at a time, and requests whose answers are written before the next are asked:
#: a failed task asks no more than those again.
AT_A_TIME, BATCH = 8, 256
#: Cases that are sent to every task; more are joined by shuffle.
BROADCAST_CASES = 100_000
KEY = ("timestamp", "case_id", "model_name", "prompt_id")
DOC_TYPES = ("IEP", "BIP")


@dataclass
class Cases:
    """A case folder's tables: which cases in which order, their cleaned documents, and the answer key."""

    order: DataFrame
    documents: DataFrame
    truth: DataFrame


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_CASES else rows


def _listed(spark: SparkSession, folder: str, wanted: Sequence[str] | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    everything = files.files(spark, f"{folder}/cases")
    order = files.select_cases(everything.select(F.col("folder").alias("case_id")), wanted)
    kinds = {d: f"{d}.docx" for d in DOC_TYPES} | {"json": ".json"}
    inside = everything.join(_few(order.select(F.col("case_id").alias("folder"))), "folder", "left_semi")
    return order, {k: inside.where(F.col("name").endswith(end)) for k, end in kinds.items()}


def issues(spark: SparkSession, folder: str, wanted: Sequence[str] | None = None, catalog: Catalog = RECORDS, with_prompts: bool = True) -> DataFrame:
    """``(case_id, issue)``: everything that is wrong with a case folder, not only the first of it."""
    order, by_kind = _listed(spark, folder, wanted)
    counted = None
    for kind, found in by_kind.items():
        one = files.single(found, order, kind)
        counted = one if counted is None else counted.unionByName(one)
    how_many = counted.where("n <> 1").select("case_id", F.when(F.col("n") == 0, F.concat(F.lit("missing file: "), "kind")).otherwise(F.concat(F.lit("several files of one kind: "), "kind", F.lit(" ("), "names", F.lit(")"))).alias("issue"))
    read = None
    for kind in DOC_TYPES:
        docs = docx.documents(by_kind[kind], kind)
        read = docs if read is None else read.unionByName(docs)
    cleaned = cleanup.clean(read)
    what = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable document: "), "doc_type", F.lit(" ("), "error", F.lit(")")))
        .when(F.coalesce("raw_text", F.lit("")) == "", F.concat(F.lit("empty document: "), "doc_type"))
        .when(F.col("cleaned_text") == "", F.concat(F.lit("nothing left after cleaning: "), "doc_type"))
    )
    documents = cleaned.select("case_id", what.alias("issue")).where("issue is not null")
    texts = files.json_texts(by_kind["json"])
    given = texts.select("case_id", F.from_json("text", "map<string,string>").alias("m"))
    broken = given.where("m is null").select("case_id", F.lit("answer key is no JSON object").alias("issue"))
    named = F.trim(F.coalesce(F.try_element_at("m", F.lit("case_id")), F.lit("")))
    other = given.where((named != "") & (named != F.col("case_id"))).select("case_id", F.concat(F.lit("answer key is of case "), named).alias("issue"))
    lacking = audits.missing_answers(given.where("m is not null"), files.truth(texts, catalog), catalog).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("field_name")), ", ").alias("f"))
    out = how_many.unionByName(documents).unionByName(broken).unionByName(other).unionByName(lacking.select("case_id", F.concat(F.lit("answer key lacks fields: "), "f").alias("issue")))
    if with_prompts:
        out = out.unionByName(prompt_issues(spark, folder))
    return out


def prompt_issues(spark: SparkSession, folder: str) -> DataFrame:
    names = files.PROMPT_FILES
    wanted = spark.createDataFrame(list(names.items()), "prompt_id string, name string")
    found = files.files(spark, f"{folder}/master_prompts", "*", False).select("name", t.clean_prompt(F.col("content").cast("string")).alias("text"))
    both = wanted.join(found, "name", "left")
    what = F.when(F.col("text").isNull(), F.concat(F.lit("missing prompt: "), "name")).when(F.col("text") == "", F.concat(F.lit("empty prompt: "), "name")).when(F.col("text").rlike("[âÃ]"), F.concat(F.lit("broken encoding in prompt: "), "name"))
    return both.select(F.lit("").alias("case_id"), what.alias("issue")).where("issue is not null")


def validate(spark: SparkSession, folder: str, wanted: Sequence[str] | None = None, catalog: Catalog = RECORDS, with_prompts: bool = True) -> int:
    """The number of cases; fails with all issues if there are any."""
    found = [f"{r[0]}: {r[1]}" if r[0] else r[1] for r in issues(spark, folder, wanted, catalog, with_prompts).orderBy("case_id", "issue").collect()]
    if found:
        raise ValueError("\n- ".join(["the cases are not in order", *found]))
    return _listed(spark, folder, wanted)[0].count()


def load(spark: SparkSession, folder: str, wanted: Sequence[str] | None = None, catalog: Catalog = RECORDS) -> Cases:
    order, by_kind = _listed(spark, folder, wanted)
    read = docx.documents(by_kind[DOC_TYPES[0]], DOC_TYPES[0])
    for kind in DOC_TYPES[1:]:
        read = read.unionByName(docx.documents(by_kind[kind], kind))
    return Cases(order, cleanup.clean(read), files.truth(files.json_texts(by_kind["json"]), catalog))


def joined_texts(documents: DataFrame) -> DataFrame:
    """``(case_id, raw_text, cleaned_text, first, second)``: a case's documents in the order of DOC_TYPES."""
    of = lambda kind, c: F.coalesce(F.max(F.when(F.col("doc_type") == kind, F.col(c))), F.lit(""))
    one = documents.groupBy("case_id").agg(*[of(k, c).alias(f"{k}_{c}") for k in DOC_TYPES for c in ("raw_text", "cleaned_text")])
    a, b = DOC_TYPES
    return one.select(
        "case_id",
        F.concat_ws("\n", f"{a}_raw_text", f"{b}_raw_text").alias("raw_text"),
        F.concat_ws("\n", f"{a}_cleaned_text", f"{b}_cleaned_text").alias("cleaned_text"),
        F.col(f"{a}_cleaned_text").alias("first"),
        F.col(f"{b}_cleaned_text").alias("second"),
    )


def requests(cases: Cases, prompts: DataFrame, models: Sequence[str], most: int = MOST_INPUT) -> DataFrame:
    """Cases times models times prompts, with the text put to the model; one longer than ``most`` fails. Models and prompts are few."""
    spark = cases.order.sparkSession
    asked = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model_name string, model_seq int")
    rows = joined_texts(cases.documents).join(_few(cases.order), "case_id").crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(prompts.withColumnRenamed("text", "question")))
    put = backends.model_input(F.col("case_id"), F.col("first"), F.col("second"), F.col("question"))
    rows = rows.withColumn("model_input", put)
    tall = F.raise_error(F.concat(F.lit("input too long for case "), F.col("case_id"), F.lit(", prompt "), F.col("prompt_id"))).cast("string")
    return rows.select("case_id", "model_name", "prompt_id", "question", F.when(F.length("model_input") > most, tall).otherwise(F.col("model_input")).alias("model_input"), "seq", "model_seq")


def score_responses(responses: DataFrame, truth: DataFrame, catalog: Catalog = RECORDS) -> tuple[DataFrame, DataFrame]:
    """Results and field results of ``responses``; texts are normalized and matched once for both if the evidence is cached or written."""
    found = evidence.evidence(responses, catalog)
    truths = scoring.truth_maps(truth)
    labels = F.create_map(*[F.lit(x) for p in catalog.coverage for x in (p, catalog.prompt_labels.get(p, p))])
    fields = scoring.field_results(found, truths, catalog).withColumn("prompt_label", F.coalesce(F.try_element_at(labels, F.col("prompt_id")), F.col("prompt_id")))
    return scoring.summaries(found, truths, catalog), fields


def extract(spark: SparkSession, folder: str, store: Store, run: str, wanted: Sequence[str] | None = None, catalog: Catalog = RECORDS, overwrite: bool = False) -> dict[str, Any]:
    """Texts, cleanup audits, the answer key's audit and the case set; no model is asked and no prompts are needed."""
    validate(spark, folder, wanted, catalog, with_prompts=False)
    store.create(run, overwrite)
    cases = load(spark, folder, wanted, catalog)
    order = [r[0] for r in cases.order.orderBy("seq").collect()]
    manifest = manifest_of(store, run, "extract", order, [], "openai", catalog) | {"case_file_hashes": case_hashes(spark, folder, order)}
    store.write_json(run, "run_manifest.json", manifest | {"status": "running"})
    _write_audits(cases, store, run, order, catalog)
    store.write_json(run, "run_manifest.json", manifest | {"status": "completed", "completed_run_count": len(order)})
    store.mark_latest(run)
    return manifest


def _write_audits(cases: Cases, store: Store, run: str, order: list[str], catalog: Catalog) -> DataFrame:
    documents = store.write(run, "case_text", cases.documents)
    store.write(run, "answer_key", cases.truth)
    texts = joined_texts(documents).join(scoring.truth_maps(cases.truth), "case_id")
    store.write(run, "ground_truth_audits", audits.truth_audit(texts, catalog))
    store.write(run, "text_hashes", audits.text_hashes(texts))
    counted = {r["field_name"]: r.asDict() for r in audits.case_set(cases.truth).collect()}
    none = {"true_count": 0, "false_count": 0, "true_cases": [], "false_cases": [], "never_true": True, "always_true": True}
    rows = [{"field_name": f, "field_label": catalog.labels[f]} | {k: v for k, v in counted.get(f, none).items() if k != "field_name"} for f in catalog.fields]
    store.write_json(run, "case_set_audit.json", {
        "case_count": len(order), "case_ids": order, "field_counts": rows,
        "never_true_fields": [r["field_name"] for r in rows if r["never_true"]], "always_true_fields": [r["field_name"] for r in rows if r["always_true"]],
    })
    store.write_text(run, "case_set_audit.md", reports.case_set_markdown(rows, order))
    return documents


def case_hashes(spark: SparkSession, folder: str, order: list[str]) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {c: {} for c in order}
    for r in files.hashes(files.files(spark, f"{folder}/cases").where(F.col("folder").isin(order))).orderBy("folder", "name").collect():
        out[r["folder"]][r["name"]] = r["sha256"]
    return out


def manifest_of(store: Store, run: str, mode: str, order: list[str], models: list[str], provider: str, catalog: Catalog) -> dict[str, Any]:
    return {
        "run_id": run, "mode": mode, "run_dir": store.path(run), "case_ids": order, "case_count": len(order), "provider": backends.provider(provider), "models": models,
        "temperature": backends.TEMPERATURE, "max_tokens": backends.MAX_TOKENS, "field_order": catalog.fields, "prompt_labels": catalog.prompt_labels,
        "prompt_field_coverage": {k: list(v) for k, v in catalog.coverage.items()}, "prompt_scoring_notes": catalog.notes,
    }


def rule_catalog(catalog: Catalog) -> dict[str, Any]:
    return {
        "field_order": catalog.fields, "field_labels": catalog.labels, "rules": {f: {"positive": list(r.positive), "negative": list(r.negative)} for f, r in catalog.rules.items()},
        "prompt_field_coverage": {k: list(v) for k, v in catalog.coverage.items()}, "prompt_scoring_notes": catalog.notes, "abstention_patterns": catalog.abstention, "field_result_types": list(RESULT_TYPES),
    }


def run(
    spark: SparkSession, folder: str, store: Store, run_id: str, models: Sequence[str], client: backends.Client | DataFrame, wanted: Sequence[str] | None = None,
    provider: str = "openai", catalog: Catalog = RECORDS, overwrite: bool = False,
) -> dict[str, Any]:
    """Ask every model every prompt about every case, score and audit the answers, and report. ``client`` may be a table of saved answers."""
    if not models:
        raise ValueError("no models are given")
    prompts = files.prompts(spark, f"{folder}/master_prompts")
    validate(spark, folder, wanted, catalog)
    cases = load(spark, folder, wanted, catalog)
    order = [r[0] for r in cases.order.orderBy("seq").collect()]
    store.create(run_id, overwrite)
    expected = len(order) * len(models) * len(catalog.coverage)
    manifest = manifest_of(store, run_id, "run", order, list(models), provider, catalog)
    manifest |= {"expected_run_count": expected, "case_file_hashes": case_hashes(spark, folder, order), "prompts": {r[0]: r[1] for r in prompts.collect()}}
    store.write_json(run_id, "run_manifest.json", manifest | {"status": "running"})
    store.write_json(run_id, "field_rules.json", rule_catalog(catalog))
    store.mark_latest(run_id)
    try:
        documents = _write_audits(cases, store, run_id, order, catalog)
        asked = requests(Cases(cases.order, documents, cases.truth), prompts, models)
        if isinstance(client, DataFrame):
            responses = store.write(run_id, "responses", _saved(backends.replay(asked, client)))
        else:
            asked = store.write(run_id, "requests", asked)
            batch = F.pmod(F.xxhash64("case_id", "model_name", "prompt_id"), F.lit(-(-expected // BATCH)))
            for i in range(-(-expected // BATCH)):
                part = asked.where(batch == i).repartition(min(expected, AT_A_TIME))
                store.append(run_id, "responses", _saved(backends.ask(part, client)))
            responses = store.read(run_id, "responses")
        evaluate(responses, documents, cases.truth, store, run_id, catalog)
    except Exception as e:
        store.write_json(run_id, "run_manifest.json", manifest | {"status": "failed", "error": str(e)[:2000]})
        raise
    out = report(store, run_id, catalog)
    store.write_json(run_id, "run_manifest.json", manifest | {"status": "completed", "completed_run_count": out["total_evaluations"]})
    return out


def _saved(answered: DataFrame) -> DataFrame:
    hashed = answered.withColumn("model_input_sha256", t.digest(F.col("model_input"))).withColumn("model_input_char_count", F.length("model_input").cast("bigint"))
    return hashed.withColumnRenamed("question", "prompt_text").drop("model_input")


def evaluate(responses: DataFrame, documents: DataFrame, truth: DataFrame, store: Store, run_id: str, catalog: Catalog = RECORDS) -> None:
    """Score saved responses and check their claims against the cleaned documents."""
    found = store.write(run_id, "evidence", evidence.evidence(responses, catalog))
    truths = scoring.truth_maps(truth)
    labels = F.create_map(*[F.lit(x) for p in catalog.coverage for x in (p, catalog.prompt_labels.get(p, p))])
    order = [c for c in ("seq", "model_seq") if c in responses.columns]
    results = scoring.summaries(found, truths, catalog)
    if order:
        place = found.select("timestamp", "case_id", "model_name", "prompt_id", F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), 6, "0") for c in order], "prompt_id").alias("seq"))
        results = results.join(place.dropDuplicates(["timestamp", "case_id", "model_name", "prompt_id"]), ["timestamp", "case_id", "model_name", "prompt_id"])
    store.write(run_id, "results", results)
    fields = scoring.field_results(found, truths, catalog).withColumn("prompt_label", F.coalesce(F.try_element_at(labels, F.col("prompt_id")), F.col("prompt_id")))
    store.write(run_id, "field_results", fields.select(*schemas.FIELD_COLUMNS, "ordinal"))
    store.write(run_id, "predicted", scoring.predictions(found, truths, catalog))
    for name, columns in (("results", schemas.RESULT_COLUMNS), ("field_results", schemas.FIELD_COLUMNS)):
        store.export_csv(run_id, name, columns)
    cut = _cut(responses)
    source = support.sources(joined_texts(documents).select("case_id", F.col("cleaned_text").alias("text")))
    store.write(run_id, "claims", support.support(cut, source).drop("text"))


def _cut(responses: DataFrame) -> DataFrame:
    return claims.breakdown(responses.select(*KEY, "text"), prefix=t.file_stem(F.col("case_id"), F.col("model_name"), F.col("prompt_id")))


def saved_claims(store: Store, run_id: str) -> DataFrame | None:
    """A run's claims; those of responses that have none are made from the responses, and written. Without their documents they are not checked."""
    saved, responses = store.read(run_id, "claims"), store.read(run_id, "responses")
    if responses is None:
        return saved
    lacking = responses if saved is None else responses.join(saved.select(*KEY), list(KEY), "left_anti")
    lacking = lacking.where(F.coalesce("text", F.lit("")) != "")
    if not lacking.isEmpty():
        none = support.sources(lacking.select("case_id", "text").limit(0))
        store.append(run_id, "claims", support.support(_cut(lacking), none).drop("text"))
        saved = store.read(run_id, "claims")
    return saved


def report(store: Store, run_id: str | None = None, catalog: Catalog = RECORDS) -> dict[str, Any]:
    """Metrics and Markdown of a run, the latest if none is named; a run without rows has zeros."""
    name = store.resolve(run_id)
    out = reports.run_metrics(store.results(name), store.field_results(name), store.read(name, "claims"), name, store.path(name), catalog)
    store.write_json(name, "summary_metrics.json", out)
    store.write_text(name, "result_summary.md", reports.summary_markdown(out, catalog))
    store.write_text(name, "review_checklist.md", reports.checklist_markdown(out))
    return out


def standing(store: Store, names: Sequence[str]) -> DataFrame:
    """``(run_id, status, total_evaluations)``; the status of a run without a manifest is null."""
    rows = []
    for name in names:
        manifest, done = store.read_json(name, "run_manifest.json"), store.read_json(name, "summary_metrics.json")
        rows.append((name, (manifest.get("status") or "") if manifest else None, int(done.get("total_evaluations") or 0)))
    return store.spark.createDataFrame(rows, "run_id string, status string, total_evaluations long")


def exportable(store: Store, run_id: str, least: int = 0) -> bool:
    """Completed, if a manifest tells, and with at least so many evaluations."""
    return not metrics.exportable(standing(store, [run_id]), least).isEmpty()


def nested(store: Store, run_id: str) -> DataFrame:
    """One row per result with its field results, predictions and claims nested."""
    results, fields = reports.typed_results(store.results(run_id)), reports.typed_fields(store.field_results(run_id))
    return nest(results, fields, saved_claims(store, run_id), store.read(run_id, "responses"), store.read(run_id, "predicted"))


def nest(results: DataFrame, fields: DataFrame, saved: DataFrame | None = None, responses: DataFrame | None = None, predicted: DataFrame | None = None) -> DataFrame:
    """Results with what belongs to each, by timestamp, case, model and prompt; a result keeps its row where something is missing."""
    key = list(KEY)
    place = "ordinal" if "ordinal" in fields.columns else "seq"
    rest = [c for c in schemas.FIELD_COLUMNS if c not in (*key, "prompt_label")]
    by_result = fields.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), *rest))).alias("f"))
    by_result = by_result.select(*key, F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in rest])).alias("field_results"))
    out = results.join(by_result, key, "left").withColumn("result_id", F.concat_ws("__", t.file_stem(F.col("case_id"), F.col("model_name"), F.col("prompt_id")), F.col("timestamp")))
    if predicted is not None:
        out = out.join(predicted.select(*key, "predicted_fields", "matches", "ground_truth_hash"), key, "left")
    if saved is not None:
        out = out.join(saved.withColumnRenamed("units", "claim_units"), key, "left")
    if responses is not None:
        out = out.join(responses.select(*key, F.col("text").alias("raw_response"), "prompt_text"), key, "left")
    return out


def export(stores: Sequence[Store], target: str, least: int = 0) -> list[str]:
    """Write ``target/<group>/<run>`` as JSON rows, one per result, for each run that may be exported; returns the runs.

    Beside them stands ``target/<group>/<run>.json``: provider, metrics and summary of the run, its folder named from the stores' root on.
    """
    done = []
    for store in stores:
        names = store.runs()
        for run_id in [r[0] for r in metrics.exportable(standing(store, names), least).orderBy("run_id").collect()] if names else []:
            nested(store, run_id).write.mode("overwrite").json(f"{target}/{store.group}/{run_id}")
            Store(store.spark, target, store.group).write_json("", f"{run_id}.json", about(store, run_id))
            done.append(f"{store.group}/{run_id}")
    return done


def about(store: Store, run_id: str) -> dict[str, Any]:
    """What a run is, and how it went; metrics that were never written are worked out."""
    manifest, found = store.read_json(run_id, "run_manifest.json"), store.read_json(run_id, "summary_metrics.json")
    if not found:
        found = reports.run_metrics(store.results(run_id), store.field_results(run_id), store.read(run_id, "claims"), run_id, store.path(run_id))
    own, provider = store.path(run_id), manifest.get("provider", "unknown")
    shown = views.public_path(own, own.rsplit("/", 3)[0])
    text = (store.read_text(run_id, "result_summary.md") or "").replace(own, shown)
    return {"run_id": run_id, "provider": provider, "run_path": shown, "summary": found | {"run_dir": shown, "provider": provider}, "summary_markdown": text}


def verify(models: Sequence[str], base_url: str, api_key: str | None = None, bedrock: Any = None) -> None:
    """Fails if the backend does not list a model, or ``bedrock``, a client that manages models, knows it neither as model nor as profile."""
    if bedrock is not None:
        if wrong := backends.bedrock_problems(list(models), bedrock):
            raise ValueError("; ".join(f"{m}: {why}" for m, why in wrong.items()))
        return
    if missing := backends.missing_models(list(models), backends.available(base_url, api_key)):
        raise ValueError(f"the backend does not list: {', '.join(missing)}")
