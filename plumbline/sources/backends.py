"""Model backends: asked once per row, the answers written before anything is scored."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPERATURE, MAX_TOKENS, TIMEOUT = 0.0, 700, 900
#: Other names of providers, underscores and case apart.
PROVIDERS = {"local": "openai", "lmstudio": "openai", "openai": "openai", "openai-compatible": "openai", "bedrock": "bedrock", "aws": "bedrock", "replay": "replay"}
GROUPS = {"openai": "runs", "bedrock": "bedrock_runs", "replay": "runs"}
#: Fixed value: what the model is told it is.
SYSTEM = "You are a helpful assistant answering questions about special education documentation."

#: (model, prompt) -> {"text", "usage", "metrics", "keys"}
Client = Callable[[str, str], dict[str, Any]]


def provider(name: str | None) -> str:
    plain = (name or "openai").strip().lower().replace("_", "")
    if plain not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(set(PROVIDERS.values())))}")
    return PROVIDERS[plain]


def api_root(url: str) -> str:
    return url.rstrip("/") if url.rstrip("/").endswith("/v1") else url.rstrip("/") + "/v1"


def content_text(content: Any) -> str:
    """A message's content is text, or parts of which those of the type text count."""
    if isinstance(content, list):
        return "\n".join(p.get("text", "") for p in content if isinstance(p, dict) and p.get("type") == "text").strip()
    return (content or "").strip()


def openai_client(base_url: str, api_key: str | None = None, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS, timeout: int = TIMEOUT) -> Client:
    def ask(model: str, prompt: str) -> dict[str, Any]:
        messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
        body = {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, "stream": False}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        request = urllib.request.Request(f"{api_root(base_url)}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as response:
            data = json.load(response)
        return {"text": content_text(data["choices"][0]["message"]["content"]), "usage": data.get("usage") or {}, "metrics": {}, "keys": sorted(data)}

    return ask


def bedrock_client(make: Callable[[], Any], temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> Client:
    """``make`` gives a client with ``converse``; it is called once per task, since clients do not travel."""
    held: list[Any] = []

    def ask(model: str, prompt: str) -> dict[str, Any]:
        if not held:
            held.append(make())
        messages = [{"role": "user", "content": [{"text": prompt}]}]
        data = held[0].converse(modelId=model, messages=messages, system=[{"text": SYSTEM}], inferenceConfig={"temperature": temperature, "maxTokens": max_tokens})
        parts = data["output"]["message"]["content"]
        text = "\n".join(p["text"] for p in parts if isinstance(p, dict) and p.get("text")).strip()
        return {"text": text, "usage": data.get("usage") or {}, "metrics": data.get("metrics") or {}, "keys": sorted(data)}

    return ask


def available(base_url: str, api_key: str | None = None, timeout: int = 30) -> list[str]:
    """Models that an OpenAI-compatible backend lists."""
    request = urllib.request.Request(f"{api_root(base_url)}/models", headers={"Authorization": f"Bearer {api_key}"} if api_key else {})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return [m["id"] for m in json.load(response).get("data", [])]


def bedrock_problems(models: list[str], client: Any) -> dict[str, str]:
    """For each model that is neither a foundation model nor an inference profile, why not. ``client`` manages models."""
    out = {}
    for model in models:
        said = []
        for kind, look in (("foundation model", lambda m: client.get_foundation_model(modelIdentifier=m)), ("inference profile", lambda m: client.get_inference_profile(inferenceProfileIdentifier=m))):
            try:
                look(model)
                break
            except Exception as e:  # whatever the service raises
                said.append(f"{kind}: {e}")
        else:
            out[model] = "; ".join(said)
    return out


def missing_models(wanted: list[str], listed: list[str]) -> list[str]:
    return [m for m in wanted if m not in set(listed)]


def ask(requests: DataFrame, client: Client) -> DataFrame:
    """``requests`` (with ``model_name`` and ``model_input``) plus timestamp, text, usage, metrics and keys. Write the result: reading it twice asks twice."""
    kinds = pa.map_(pa.string(), pa.string())
    flat = lambda m: [(k, None if v is None else str(v)) for k, v in m.items() if not isinstance(v, dict | list)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, prompts = b.schema.names.index("model_name"), b.column("model_input").to_pylist()
            answers = [client(m, p) for m, p in zip(b.column(at).to_pylist(), prompts, strict=True)]
            now = [datetime.now(UTC).replace(tzinfo=None).isoformat()] * len(answers)
            new = [
                pa.array(now), pa.array([a["text"] for a in answers]), pa.array([flat(a["usage"]) for a in answers], kinds),
                pa.array([flat(a["metrics"]) for a in answers], kinds), pa.array([a["keys"] for a in answers], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "timestamp", "text", "usage", "metrics", "keys"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInArrow(run, f"{kept}, timestamp string, text string, usage map<string,string>, metrics map<string,string>, keys array<string>")


def replay(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Answers saved earlier, by case, model and prompt; a request without one is left out."""
    return requests.join(saved.select("case_id", "model_name", "prompt_id", "timestamp", "text", "usage", "metrics", "keys"), ["case_id", "model_name", "prompt_id"])


def model_input(case_id, first, second, question):
    """Fixed value: how a case and a question are put to a model. ``first`` and ``second`` are its two documents."""
    return F.trim(F.concat(
        F.lit("You are reviewing synthetic special education documentation for research evaluation.\n\nCASE ID: "), case_id,
        F.lit("\n\nIEP DOCUMENT:\n"), first, F.lit("\n\nBIP DOCUMENT:\n"), second, F.lit("\n\nQUESTION:\n"), question,
        F.lit("\n\nAnswer naturally as if responding to a teacher. Do not output JSON unless asked."),
    ))
