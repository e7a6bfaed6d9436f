"""Command line: ``python -m plumbline --mode run|extract|verify|validate|report|export``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path, PureWindowsPath

from pyspark.sql import SparkSession

from plumbline.plans import runs
from plumbline.sources import backends
from plumbline.sources.store import Store, new_run_id


#: Keys of a config file whose values are paths.
PATHS = ("python", "requirements", "base_dir", "demo_dir", "npm_cmd", "export_dir")


def config(path: str, root: str | None = None) -> dict[str, str]:
    """A flat JSON file of defaults for the options. Relative paths are taken from ``root`` on.

    That is the file's folder, or the project's where the file lies in its ``<any>/src/runtime``. ``venv_dir`` is the folder of ``python``'s environment.
    """
    at = Path(path).resolve()
    inside = at.parent.name == "runtime" and at.parents[1].name == "src"
    base = Path(root) if root else at.parents[3] if inside else at.parent
    found = {k.lower(): v for k, v in json.loads(at.read_text(encoding="utf-8")).items()}
    for key in PATHS:
        if found.get(key) and not PureWindowsPath(found[key]).is_absolute() and not Path(found[key]).is_absolute():
            found[key] = str((base / PureWindowsPath(found[key]).as_posix()).resolve())
    if found.get("python"):
        found["venv_dir"] = str(Path(found["python"]).parent.parent)
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--mode", choices=["run", "extract", "verify", "validate", "report", "export"], default="run")
    p.add_argument("--config", help="JSON file with defaults for the options below")
    p.add_argument("--base-dir", default=".")
    p.add_argument("--provider", default="openai")
    p.add_argument("--models", default="", help="comma-separated")
    p.add_argument("--base-url", default="http://localhost:1234/v1")
    p.add_argument("--api-key")
    p.add_argument("--aws-region", default="us-east-1")
    p.add_argument("--aws-profile")
    p.add_argument("--cases", default="", help="comma-separated; all if empty")
    p.add_argument("--run-id")
    p.add_argument("--overwrite-run", action="store_true")
    p.add_argument("--export-provider", default="all")
    p.add_argument("--export-min-evaluations", type=int, default=0)
    p.add_argument("--export-dir")
    return p


def aws(a: argparse.Namespace, service: str):
    try:
        import boto3
    except ImportError as e:
        raise RuntimeError("boto3 is needed for this provider") from e
    return boto3.Session(profile_name=a.aws_profile or None, region_name=a.aws_region).client(service)


def client(a: argparse.Namespace) -> backends.Client:
    if backends.provider(a.provider) == "bedrock":
        return backends.bedrock_client(lambda: aws(a, "bedrock-runtime"))
    return backends.openai_client(a.base_url, a.api_key)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    try:
        if a.config:
            p.set_defaults(**config(a.config))
            a = p.parse_args(argv)
        many = lambda text: [x.strip() for x in text.split(",") if x.strip()]
        models, cases = many(a.models), many(a.cases)
        provider = backends.provider(a.provider)
        if a.mode in ("run", "verify") and not models:
            raise ValueError("--models is needed")
        if a.mode == "verify":
            runs.verify(models, a.base_url, a.api_key, aws(a, "bedrock") if provider == "bedrock" else None)
            print(f"ready: {', '.join(models)}")
            return 0
        spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
        outputs = f"{a.base_dir}/outputs"
        store = Store(spark, outputs, backends.GROUPS[provider])
        if a.mode == "validate":
            print(f"{runs.validate(spark, a.base_dir, cases)} cases are in order")
        elif a.mode == "report":
            print(json.dumps(runs.report(store, a.run_id), indent=2))
        elif a.mode == "export":
            wanted = sorted(set(backends.GROUPS.values())) if a.export_provider == "all" else [backends.GROUPS[backends.provider(a.export_provider)]]
            done = runs.export([Store(spark, outputs, g) for g in wanted], a.export_dir or f"{outputs}/export", a.export_min_evaluations)
            print(f"{len(done)} runs exported")
        elif a.mode == "extract":
            runs.extract(spark, a.base_dir, Store(spark, outputs), a.run_id or new_run_id(), cases, overwrite=a.overwrite_run)
        else:
            runs.run(spark, a.base_dir, store, a.run_id or new_run_id(), models, client(a), cases, provider, overwrite=a.overwrite_run)
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
