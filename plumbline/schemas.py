"""Schemas of what is read and written; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BOOL, LONG, DOUBLE = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


FILES = _struct(path=STRING, name=STRING, folder=STRING, content=T.BinaryType())
DOCUMENTS = _struct(case_id=STRING, doc_type=STRING, path=STRING, raw_text=STRING, error=STRING)
TRUTH = _struct(case_id=STRING, field_name=STRING, truth=BOOL)
RESPONSES = _struct(
    run_id=STRING, timestamp=STRING, case_id=STRING, model_name=STRING, prompt_id=STRING, text=STRING,
    usage=T.MapType(STRING, STRING), metrics=T.MapType(STRING, STRING), keys=T.ArrayType(STRING),
)

# --- fixed values: columns of result files, in order -------------------------------------------------

RESULT_COLUMNS = (
    "timestamp", "case_id", "model_name", "prompt_id", "prompt_label", "scored_field_count", "correct_scored_fields", "accuracy_percent",
    "abstention_detected", "abstention_hits", "input_tokens", "output_tokens", "total_tokens", "latency_ms", "raw_response_sha256", "predicted_json_sha256",
)
FIELD_COLUMNS = (
    "timestamp", "case_id", "model_name", "prompt_id", "prompt_label", "field_name", "field_label", "scored_in_prompt", "predicted", "ground_truth",
    "is_match", "error_type", "positive_hits", "negative_hits", "matched_positive_patterns", "matched_negative_patterns",
)
