"""Where runs are kept: Parquet tables and small text files in ``root/group/run``, on any file system that Spark reaches."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from plumbline import schemas
from plumbline.sources import files


def new_run_id() -> str:
    return datetime.now(UTC).strftime("run_%Y%m%d_%H%M%S_%f")


def run_id(text: str) -> str:
    value = text.strip()
    if not re.fullmatch(r"[A-Za-z0-9._-]+", value):
        raise ValueError("a run id is made of letters, digits, dots, dashes and underscores")
    return value


@dataclass
class Store:
    spark: SparkSession
    root: str
    group: str = "runs"

    def path(self, run: str, name: str = "") -> str:
        return "/".join(x for x in (self.root.rstrip("/"), self.group, run, name) if x)

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def create(self, run: str, overwrite: bool = False) -> None:
        """Fails on a run that exists, unless it may be overwritten; then its whole folder goes first."""
        fs, at = self._fs(self.path(run_id(run)))
        if fs.exists(at):
            if not overwrite:
                raise FileExistsError(f"run {run} exists; allow overwriting or choose another id")
            fs.delete(at, True)
        fs.mkdirs(at)

    def write_text(self, run: str, name: str, text: str) -> None:
        fs, at = self._fs(self.path(run, name))
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write_json(self, run: str, name: str, value: Any) -> None:
        self.write_text(run, name, json.dumps(value, indent=2, ensure_ascii=False))

    def read_text(self, run: str, name: str) -> str | None:
        path = self.path(run, name)
        if not self.exists(path):
            return None
        return self.spark.read.text(path, wholetext=True).first()[0]

    def read_json(self, run: str, name: str) -> dict[str, Any]:
        """Empty if the file is missing."""
        return json.loads(self.read_text(run, name) or "{}")

    def write(self, run: str, name: str, table: DataFrame) -> DataFrame:
        """Written once and read back, so that nothing upstream, least of all a model, runs again."""
        table.write.mode("overwrite").parquet(self.path(run, name))
        return self.spark.read.schema(table.schema).parquet(self.path(run, name))

    def append(self, run: str, name: str, table: DataFrame) -> None:
        table.write.mode("append").parquet(self.path(run, name))

    def read(self, run: str, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(run, name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def export_csv(self, run: str, name: str, columns: tuple[str, ...]) -> None:
        """A table as CSV parts with a header, beside it."""
        table = self.read(run, name)
        table.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(self.path(run, f"{name}.csv"))

    def results(self, run: str) -> DataFrame:
        return self._table(run, "results", schemas.RESULT_COLUMNS)

    def field_results(self, run: str) -> DataFrame:
        return self._table(run, "field_results", schemas.FIELD_COLUMNS)

    def _table(self, run: str, name: str, columns: tuple[str, ...]) -> DataFrame:
        """The Parquet table, or else the CSV files of a run that another program wrote."""
        found = self.read(run, name)
        return found if found is not None else files.csv(self.spark, self.path(run, f"{name}.csv"), columns)

    def mark_latest(self, run: str) -> None:
        self.write_text("", "latest_run.txt", run + "\n")

    def resolve(self, run: str | None) -> str:
        if run is None:
            return self.latest()
        if not self.exists(self.path(run_id(run))):
            raise FileNotFoundError(f"no run {run} in {self.path('')}")
        return run

    def latest(self) -> str:
        marked = (self.read_text("", "latest_run.txt") or "").strip()
        if marked:
            return marked
        names = self.runs()
        if not names:
            raise FileNotFoundError(f"no runs in {self.path('')}")
        return names[-1]

    def runs(self) -> list[str]:
        """Names of the group's runs that have results, sorted."""
        fs, at = self._fs(self.path(""))
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        return [n for n in names if self.exists(self.path(n, "results")) or self.exists(self.path(n, "results.csv"))]
