"""A run's metrics, and what is written for people to read. The driver holds aggregates only."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import RECORDS, Catalog
from plumbline.functions import text as t
from plumbline.operators import metrics as m


def typed_results(results: DataFrame) -> DataFrame:
    """Results of any origin with the types that metrics need; rows without a place in the file get one."""
    kinds = {"accuracy_percent": "double", "scored_field_count": "bigint", "correct_scored_fields": "bigint"}
    out = results.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).withColumn("abstention_detected", t.parse_bool(F.col("abstention_detected")))
    return out if "seq" in out.columns else out.withColumn("seq", F.monotonically_increasing_id())


def typed_fields(rows: DataFrame) -> DataFrame:
    flags = {c: t.parse_bool(F.col(c)) for c in ("scored_in_prompt", "predicted", "ground_truth")}
    return rows.withColumns(flags | {"is_match": t.parse_optional_bool(F.col("is_match"))})


def run_metrics(results: DataFrame, fields: DataFrame, claims: DataFrame | None, run_id: str, run_dir: str, catalog: Catalog = RECORDS) -> dict[str, Any]:
    """All metrics of a run; without results, zeros and empty collections."""
    results, fields = typed_results(results).cache(), typed_fields(fields)
    try:
        top = m.overview(results).first()
        out: dict[str, Any] = {"run_id": run_id, "run_dir": run_dir}
        empty = not top["total_evaluations"]
        if not empty:
            out |= {"case_ids": top["case_ids"], "model_names": top["model_names"], "prompt_ids": top["prompt_ids"]}
        means = m.average_accuracy(results, ["prompt_id"], ["model_name"]).collect()
        tallies = m.field_tallies(fields).cache()
        label = lambda name: catalog.labels.get(name, name)
        ranked = lambda what, key: [{"field_name": r[0], "field_label": label(r[0]), key: r[1]} for r in m.ranking(tallies, what).collect()] if not empty else []
        ends = lambda best: [r.asDict() for r in m.runs_at_end(results, best).select("case_id", "model_name", "prompt_id", "accuracy_percent", "correct_scored_fields", "scored_field_count").collect()]
        return out | {
            "total_evaluations": top["total_evaluations"],
            "overall_average_accuracy": top["overall_average_accuracy"],
            "accuracy_by_prompt": {r["prompt_id"]: r["average_accuracy"] for r in sorted(means, key=str) if r["grouped"] == "prompt_id"},
            "accuracy_by_model": {r["model_name"]: r["average_accuracy"] for r in sorted(means, key=str) if r["grouped"] == "model_name"},
            "abstention_detected_count": top["abstention_detected_count"],
            "token_usage": {} if empty else m.tokens(results).first().asDict(),
            "error_type_counts": {} if empty else dict(sorted((r[0], r[1]) for r in m.error_types(fields).collect())),
            "claim_support_counts": {} if empty or claims is None else dict(sorted((r[0], r[1]) for r in m.support_counts(claims).collect())),
            "most_missed_fields": ranked("misses", "miss_count"),
            "likely_false_positive_fields": ranked("false_positives", "count"),
            "likely_omission_fields": ranked("omissions", "count"),
            "top_runs": ends(True),
            "bottom_runs": ends(False),
        }
    finally:
        results.unpersist()


def _section(title: str, lines: list[str], otherwise: str) -> list[str]:
    return ["", f"## {title}", "", *(lines or [f"- {otherwise}"])]


def summary_markdown(x: dict[str, Any], catalog: Catalog = RECORDS) -> str:
    run = lambda r: f"- `{r['case_id']}` | `{r['model_name']}` | `{r['prompt_id']}`: `{r['correct_scored_fields']}/{r['scored_field_count']}` (`{r['accuracy_percent']:.2f}%`)"
    out = [
        f"# Run {x['run_id']}", "",
        f"- Folder: `{x['run_dir']}`",
        f"- Evaluations: `{x['total_evaluations']}`",
        f"- Average accuracy: `{x['overall_average_accuracy']:.2f}%`",
        f"- Responses that abstain: `{x['abstention_detected_count']}`",
        f"- Tokens: `{x['token_usage'].get('total_tokens', 0)}`",
    ]
    out += _section("Accuracy by prompt", [f"- `{p}` ({catalog.prompt_labels.get(p, p)}): `{a:.2f}%`" for p, a in x["accuracy_by_prompt"].items()], "None.")
    out += _section("Accuracy by model", [f"- `{p}`: `{a:.2f}%`" for p, a in x["accuracy_by_model"].items()], "None.")
    out += _section("Result types", [f"- `{k}`: `{n}`" for k, n in x["error_type_counts"].items()], "None recorded.")
    out += _section("Support of claims", [f"- `{k}`: `{n}`" for k, n in x["claim_support_counts"].items()], "None recorded.")
    out += _section("Fields missed most", [f"- `{f['field_label']}`: `{f['miss_count']}`" for f in x["most_missed_fields"]], "None.")
    out += _section("Likely false positives", [f"- `{f['field_label']}`: `{f['count']}`" for f in x["likely_false_positive_fields"]], "None.")
    out += _section("Likely omissions", [f"- `{f['field_label']}`: `{f['count']}`" for f in x["likely_omission_fields"]], "None.")
    out += _section("Best responses", list(map(run, x["top_runs"])), "None.")
    out += _section("Weakest responses", list(map(run, x["bottom_runs"])), "None.")
    return "\n".join(out) + "\n"


def checklist_markdown(x: dict[str, Any]) -> str:
    """What a person should look at before the numbers are used; flagged fields first, each once."""
    flagged = dict.fromkeys(f["field_label"] for f in x["likely_false_positive_fields"] + x["likely_omission_fields"])
    out = [f"# To review: {x['run_id']}", "", "- [ ] The summary and the case set", "- [ ] Removals of the cleanup", "- [ ] Answer-key fields that need a note", "- [ ] One response with its predictions and claims"]
    out += _section("Fields to look at first", [f"- [ ] `{f}`" for f in flagged], "No field is flagged.")
    out += _section("Claims", [f"- `{k}`: `{n}`" for k, n in x["claim_support_counts"].items()], "No claims were saved.")
    return "\n".join(out) + "\n"


def case_set_markdown(rows: list[dict[str, Any]], cases: list[str]) -> str:
    out = ["# Case set", "", f"- Cases: `{len(cases)}` (`{', '.join(cases)}`)"]
    out += _section("Never true", [f"- `{r['field_label']}`" for r in rows if r["never_true"]], "None.")
    out += _section("Counts", [f"- `{r['field_label']}`: `{r['true_count']}` true / `{r['false_count']}` false" for r in rows], "None.")
    out += ["", "A field that is never true can show additions, but not whether it is found where it is present."]
    return "\n".join(out) + "\n"
