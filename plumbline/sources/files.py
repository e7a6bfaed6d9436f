"""Folders of cases, prompts and runs as DataFrames. All reading goes through Spark, so any of its file systems will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import schemas
from plumbline.catalog import PROMPT_FILES, RECORDS, Catalog
from plumbline.functions import text as t


def files(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = True) -> DataFrame:
    """``(path, name, folder, content)`` of the files whose names fit; a missing folder has none. Contents are read only if asked for."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower())
    try:
        found = reader.load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.FILES)
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), "content")


def hashes(found: DataFrame) -> DataFrame:
    return found.select("folder", "name", F.sha2("content", 256).alias("sha256"))


def select_cases(cases: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    """``(case_id, seq)``: the wanted cases in the order asked for, each once, or all by name; an unknown or empty selection fails."""
    known = cases.select("case_id").distinct()
    if not wanted:
        out = [r[0] for r in known.orderBy("case_id").collect()]
    else:
        out = list(dict.fromkeys(w for w in (" ".join(x.split()) for x in wanted) if w))
        asked = cases.sparkSession.createDataFrame([(c,) for c in out], "case_id string")
        if missing := [r[0] for r in asked.join(known, "case_id", "left_anti").orderBy("case_id").collect()]:
            raise ValueError(f"cases not found: {', '.join(missing)}")
    if not out:
        raise ValueError("there are no cases")
    return cases.sparkSession.createDataFrame([(c, i) for i, c in enumerate(out)], "case_id string, seq int")


def single(found: DataFrame, cases: DataFrame, what: str) -> DataFrame:
    """One row per case with how many files of a kind it has, their names joined."""
    counted = found.groupBy(F.col("folder").alias("case_id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return cases.select("case_id").join(counted, "case_id", "left").select("case_id", F.lit(what).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("names", F.lit("")).alias("names"))


def as_bool(value: Column) -> Column:
    """What a JSON value, given as JSON, amounts to: false for false, zero, null and what is empty; true for the rest, the text ``"false"`` included."""
    given = F.coalesce(value, F.lit("null"))
    return ~given.isin("false", "null", "[]", "{}", '""') & (F.coalesce(given.try_cast("double"), F.lit(1.0)) != 0)


def truth(texts: DataFrame, catalog: Catalog = RECORDS) -> DataFrame:
    """Long ``(case_id, field_name, truth)`` from ``(case_id, text)`` of JSON answer keys.

    Fields stand at the top or one level down; others are ignored; the last of equal names in the text wins.
    """

    def entries(json: Column) -> Column:
        """Keys and values, the values as JSON, so that texts keep their quotes."""
        found = F.map_entries(F.from_json(json, "map<string,variant>"))
        return F.transform(found, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))

    top = texts.select("case_id", F.posexplode(entries(F.col("text"))).alias("pos", "e"))
    inner = F.when(F.col("e.value").startswith("{"), entries(F.col("e.value")))
    here = F.array(F.struct(F.col("e.key").alias("key"), F.col("e.value").alias("value")))
    flat = top.select("case_id", "pos", F.posexplode(F.coalesce(inner, here)).alias("pos2", "f")).where(F.col("f.key").isin(*catalog.fields))
    last = flat.groupBy("case_id", F.col("f.key").alias("field_name")).agg(F.max_by(F.struct(F.col("f.value").alias("v")), F.struct("pos", "pos2")).alias("last"))
    return last.select("case_id", "field_name", as_bool(F.col("last.v")).alias("truth"))


def json_texts(found: DataFrame) -> DataFrame:
    return found.select(F.col("folder").alias("case_id"), "name", F.col("content").cast("string").alias("text"))


def prompts(spark: SparkSession, folder: str, names: dict[str, str] = PROMPT_FILES) -> DataFrame:
    """``(prompt_id, text)`` of the named files, repaired; one that is missing or empty fails."""
    ids = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)])
    found = files(spark, folder, "*", False).where(F.col("name").isin(*names.values()))
    out = found.select(F.element_at(ids, F.col("name")).alias("prompt_id"), t.clean_prompt(F.col("content").cast("string")).alias("text"))
    lengths = {r[0]: r[1] for r in out.select("prompt_id", F.length("text")).collect()}
    if missing := [v for k, v in names.items() if k not in lengths]:
        raise FileNotFoundError(f"missing prompt files: {', '.join(missing)}")
    if empty := [names[k] for k, n in lengths.items() if not n]:
        raise ValueError(f"empty prompt files: {', '.join(empty)}")
    return out


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text, those the file lacks null; a missing file has no rows. ``seq`` is the row's place in the file."""
    try:
        found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", seq bigint")
    kept = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return found.select(*kept, F.monotonically_increasing_id().alias("seq"))


def json(spark: SparkSession, path: str, schema: str | StructType, lines: bool = False) -> DataFrame:
    """JSON files of the schema, one value a file or, for ``lines``, a line; a missing path has no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_or(spark: SparkSession, path: str, otherwise: DataFrame) -> DataFrame:
    """JSON rows of a folder, as an export writes them; ``otherwise`` if it is missing or has none."""
    found = json(spark, path, otherwise.schema, lines=True)
    return otherwise if found.isEmpty() else found


def runs(spark: SparkSession, root: str) -> DataFrame:
    """``(run_group, run_id)`` of the runs with results under ``root/group/run``, by group and name."""
    found = files(spark, root, "results.csv")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -3).alias("run_group"), F.element_at(parts, -2).alias("run_id")).distinct().orderBy("run_group", "run_id")


def latest_run(spark: SparkSession, root: str, group: str) -> str:
    """The marked run if there is a mark that is not empty, else the last by name."""
    mark = files(spark, f"{root}/{group}", "latest_run.txt", False).select(F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s+", " ")).alias("m")).where("m <> ''")
    if row := mark.first():
        return row[0]
    last = runs(spark, root).where(F.col("run_group") == group).agg(F.max("run_id")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no runs in {root}/{group}")
    return last
