"""Runs end to end, on documents and keys that the test writes."""

from __future__ import annotations

import csv
import io
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.__main__ import config, main
from plumbline.catalog import RECORDS
from plumbline.operators import views
from plumbline.plans import runs
from plumbline.sources import backends, docx, files
from plumbline.sources.store import Store, run_id

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text):
    return f"<w:p><w:r><w:t xml:space='preserve'>{text}</w:t></w:r></w:p>"


def document(*paragraphs, table=()):
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{''.join(map(paragraph, cell))}</w:tc>" for cell in row) + "</w:tr>" for row in table)
    body = "".join(map(paragraph, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if rows else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx_order_and_repeats():
    content = document("First", "First", "Licensed under a Creative Commons Attribution", "Last", table=[[["a", "a", "b"], ["c"]], [["c"], ["c"]]])
    assert docx.extract(content) == "First\nLast\na | b || c\nc"


@pytest.fixture
def folder(tmp_path):
    prompts = tmp_path / "master_prompts"
    prompts.mkdir()
    for n in (1, 2, 3):
        (prompts / f"PROMPT {n}.md").write_text(f"Question {n}?", encoding="utf-8")
    for case in ("CASE001", "CASE002"):
        d = tmp_path / "cases" / case
        d.mkdir(parents=True)
        (d / f"{case}_IEP.docx").write_bytes(document("The student receives OT services each week.", "Form 6d page"))
        (d / f"{case}_BIP.docx").write_bytes(document("Yelling is maintained by escape."))
        true = {"ot_services_present", "verbal_disruption_present", "function_escape_stated", "bip_exists"}
        (d / f"{case}.json").write_text(json.dumps({"case_id": case, "A": {f: f in true for f in RECORDS.fields}}), encoding="utf-8")
    return tmp_path


def test_extract_validate_and_selection(spark, folder):
    assert runs.validate(spark, str(folder)) == 2
    with pytest.raises(ValueError, match="CASE009"):
        runs.validate(spark, str(folder), ["CASE009"])
    store = Store(spark, str(folder / "outputs"))
    runs.extract(spark, str(folder), store, "run_a", ["CASE002"])
    assert store.read_json("run_a", "run_manifest.json")["status"] == "completed" and store.latest() == "run_a"
    assert {r.cleaned_text for r in store.read("run_a", "case_text").collect()} == {"The student receives OT services each week.", "Yelling is maintained by escape."}
    audit = {r.field_name: r.review_status for r in store.read("run_a", "ground_truth_audits").collect()}
    assert audit["ot_services_present"] == "source_hit_found" and audit["bip_exists"] == "needs_manual_note_true_field"
    with pytest.raises(FileExistsError):
        runs.extract(spark, str(folder), store, "run_a", ["CASE002"])


def test_all_issues_are_listed(spark, folder):
    (folder / "cases/CASE001/CASE001_BIP.docx").unlink()
    (folder / "cases/CASE002/CASE002_IEP.docx").write_bytes(b"broken")
    (folder / "cases/CASE002/CASE002.json").write_text('{"case_id": "OTHER"}', encoding="utf-8")
    (folder / "master_prompts/PROMPT 2.md").write_text(" ", encoding="utf-8")
    with pytest.raises(ValueError) as e:
        runs.validate(spark, str(folder))
    for part in ("missing file: BIP", "unreadable document: IEP", "of case OTHER", "lacks fields", "empty prompt: PROMPT 2.md"):
        assert part in str(e.value)


def test_run_report_and_export(spark, folder):
    def client(model, prompt):
        assert "OT services" in prompt and "Form 6d" not in prompt
        return {"text": "The student receives OT services each week. Yelling occurs. Escape is the function. A BIP is in place for the student.", "usage": {"prompt_tokens": 5, "total_tokens": 9}, "metrics": {}, "keys": ["choices"]}

    store = Store(spark, str(folder / "outputs"))
    out = runs.run(spark, str(folder), store, "run_b", ["m"], client)
    assert out["total_evaluations"] == 6 and out["overall_average_accuracy"] == 100.0
    assert out["token_usage"] == {"input_tokens": 30, "output_tokens": 0, "total_tokens": 54}
    assert store.read("run_b", "field_results").count() == 6 * 24
    assert store.read_json("run_b", "run_manifest.json")["completed_run_count"] == 6
    saved = store.read("run_b", "responses")
    again = runs.run(spark, str(folder), store, "run_c", ["m"], saved)
    assert again["accuracy_by_prompt"] == out["accuracy_by_prompt"]
    assert runs.exportable(store, "run_b", 6) and not runs.exportable(store, "run_b", 7)
    assert runs.export([store], str(folder / "export")) == ["runs/run_b", "runs/run_c"]
    nested = spark.read.json(str(folder / "export/runs/run_b"))
    assert nested.count() == 6 and nested.selectExpr("max(size(field_results))").first()[0] == 24
    row = nested.where("prompt_id = 'prompt_1'").first()
    assert row.predicted_fields.bip_exists and row.matches.bip_exists and row.matches.safety_plan_present and len(row.ground_truth_hash) == 64
    assert nested.where("prompt_id = 'prompt_3'").first().matches.bip_exists is None
    about = json.loads((folder / "export/runs/run_b.json").read_text(encoding="utf-8"))
    assert about["provider"] == "openai" and about["run_path"] == "outputs/runs/run_b" == about["summary"]["run_dir"] and str(folder) not in about["summary_markdown"]
    shutil.rmtree(folder / "outputs/runs/run_c/claims")  # claims that are missing are made from the responses
    again = {r.prompt_id: r for r in runs.nested(store, "run_c").where("case_id = 'CASE001'").collect()}
    assert again["prompt_1"].claim_count == 3 and {c.support_status for c in again["prompt_1"].claims} == {"not_checked"}
    assert store.read("run_c", "claims").count() == 6
    shown = files.json_or(spark, str(folder / "export/runs/run_b"), nested.select("case_id", "prompt_id").limit(0))
    assert shown.count() == 6 and files.json_or(spark, str(folder / "none"), shown).count() == 6


def test_report_of_csv_files(spark, tmp_path, capsys):
    run = tmp_path / "outputs/runs/old"
    run.mkdir(parents=True)
    results = [c for c in schemas.RESULT_COLUMNS if not c.endswith("tokens")]
    with open(run / "results.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, results)
        w.writeheader()
        for case, right, accuracy in (("a", 24, 100.0), ("b", 18, 75.0)):
            w.writerow(dict.fromkeys(results, "") | {"timestamp": "t", "case_id": case, "model_name": "m", "prompt_id": "prompt_1", "scored_field_count": 24, "correct_scored_fields": right, "accuracy_percent": accuracy, "abstention_detected": "True"})
    fields = [c for c in schemas.FIELD_COLUMNS if c != "error_type"]
    with open(run / "field_results.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fields)
        w.writeheader()
        w.writerow(dict.fromkeys(fields, "") | {"field_name": "bip_exists", "scored_in_prompt": "True", "is_match": "False"})
        w.writerow(dict.fromkeys(fields, "") | {"field_name": "bip_exists", "scored_in_prompt": "False", "is_match": ""})
    assert main(["--mode", "report", "--base-dir", str(tmp_path), "--run-id", "old"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["total_evaluations"] == 2 and out["overall_average_accuracy"] == 87.5 and out["abstention_detected_count"] == 2
    assert out["most_missed_fields"] == [{"field_name": "bip_exists", "field_label": "BIP exists", "miss_count": 1}]
    assert out["error_type_counts"] == {} and [r["case_id"] for r in out["bottom_runs"]] == ["b", "a"]
    assert "`87.50%`" in (run / "result_summary.md").read_text(encoding="utf-8")
    assert main(["--mode", "report", "--base-dir", str(tmp_path), "--run-id", "none"], spark) == 1


def test_answer_keys_keep_their_types(spark):
    names = RECORDS.fields
    values = [True, False, "false", "0", "", 0, 0.0, 1, None, [], [0], {}, " ", "true"]
    flat = dict(zip(names, values, strict=False)) | {"other": 1}
    deep = {"A": dict(list(flat.items())[:7]), "B": dict(list(flat.items())[7:]), names[0]: False, "C": {names[0]: "x"}}
    texts = spark.createDataFrame([("flat", json.dumps(flat)), ("deep", json.dumps(deep))], "case_id string, text string")
    got = {(r.case_id, r.field_name): r.truth for r in files.truth(texts).collect()}
    for f, v in zip(names, values, strict=False):
        if not isinstance(v, dict):  # an object is a group of fields
            assert got["flat", f] == bool(v), (f, v)
            assert f == names[0] or got["deep", f] == bool(v)
    assert got["deep", names[0]] is True  # the last of equal names


def test_bedrock_readiness_and_config(tmp_path):
    class Service:
        def get_foundation_model(self, modelIdentifier):
            if modelIdentifier != "a":
                raise LookupError("no such model")

        def get_inference_profile(self, inferenceProfileIdentifier):
            if inferenceProfileIdentifier != "b":
                raise LookupError("no such profile")

    runs.verify(["a", "b"], "", bedrock=Service())
    with pytest.raises(ValueError, match="c: foundation model: no such model; inference profile: no such profile"):
        runs.verify(["a", "c"], "", bedrock=Service())
    at = tmp_path / "engine/src/runtime/run.json"
    at.parent.mkdir(parents=True)
    at.write_text(json.dumps({"PYTHON": ".venv/bin/python", "base_dir": ".\\cases", "npm_cmd": "C:\\npm.cmd", "models": "m"}), encoding="utf-8")
    found = config(str(at))
    assert found == {"python": f"{tmp_path}/.venv/bin/python", "base_dir": f"{tmp_path}/cases", "npm_cmd": "C:\\npm.cmd", "models": "m", "venv_dir": f"{tmp_path}/.venv"}


def test_bedrock_parts():
    class Runtime:
        def converse(self, **given):
            return {"output": {"message": {"content": [{"text": "a"}, {"text": ""}, {"reasoningContent": {}}, {"text": "b"}]}}}

    assert backends.bedrock_client(Runtime)("m", "p")["text"] == "a\nb"


def test_views(spark):
    rows = spark.createDataFrame([(24, 22, 91.67, True), (24, 24, 70.0, False), (2, None, 0.0, None)], "scored_field_count long, correct_scored_fields long, accuracy_percent double, abstention_detected boolean")
    got = [(r.misses, r.accuracy_class, r.summary) for r in views.result_view(rows).collect()]
    assert got == [(2, "good", "Accuracy 91.67% | Correct 22/24 | Misses 2 | Abstention Yes"), (0, "", "Accuracy 70.0% | Correct 24/24 | Misses 0 | Abstention No"), (2, "bad", "Accuracy 0.0% | Correct 0/2 | Misses 2 | Abstention No")]
    rows = spark.createDataFrame([("omission", False), ("", None), (None, True), ("", False)], "error_type string, is_match boolean").withColumn("predicted", F.col("is_match")).withColumn("ground_truth", F.lit(True))
    assert [(r.outcome, r.is_match_word) for r in views.field_view(rows).collect()] == [("omission", "No"), ("unscored", "Unscored"), ("match", "Yes"), ("miss", "No")]
    assert views.public_path("/a/b/c", "/a") == "b/c" and views.public_path("/x/c/", "/a") == "c"


def test_small_parts():
    assert backends.provider(" LM_Studio ") == "openai" and backends.provider("aws") == "bedrock"
    with pytest.raises(ValueError):
        backends.provider("other")
    assert backends.content_text([{"type": "text", "text": "a"}, {"type": "reasoning", "text": "no"}, {"image": 1}, {"type": "text", "text": "b"}]) == "a\nb"
    assert backends.content_text(" plain ") == "plain"
    assert backends.api_root("http://x/") == "http://x/v1" == backends.api_root("http://x/v1")
    assert backends.missing_models(["a", "b"], ["b"]) == ["a"]
    with pytest.raises(ValueError):
        run_id(" a b ")
