"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Documents can hold a megabyte each, so the default of 10,000 is too many.
BATCH_ROWS = 512
#: A key that more than this fraction of all rows have is joined without moving them.
HOT = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` if the cluster names one.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = getattr(context, "_plumbline_shared", None)
    if own is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = context._plumbline_shared = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return own


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and nothing is computed twice.

    The written table outlives a lost executor, unlike a cached one. It stays until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which shuffle files go when the query that wrote them has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside takes its shuffle files with it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _written(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_plumbline_written"):
        context._plumbline_written = []
    return context._plumbline_written


def release(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete all tables that ``staged`` has written, except ``but``'s: what was made of them must have been written or be done with."""
    kept = [] if but is None else but.inputFiles()
    paths = _written(spark)
    stay = [p for p in paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in kept)]
    for path in set(paths) - set(stay):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths[:] = stay


def joined(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``left`` joined to ``right``, which has each ``key`` once; ``sizes(key, n)`` tells how many rows of ``left`` have it.

    Keys that hold a HOT-th of all rows are at most HOT; their rows of ``right`` go to every task and those of ``left``
    stay where they are. All other rows meet by shuffle.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = staged(sizes.where(F.col("n") * HOT > total).where(F.col("n") > 1).select(key), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(hot)
    cold = left.join(few, key, "left_anti").join(right.join(few, key, "left_anti"), key)
    return cold.unionByName(left.join(F.broadcast(right.join(few, key, "left_semi")), key))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole documents within memory; a value that the user set stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str, folds: int):
    """``crc32(id as text) mod folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def trimmed() -> None:
    """Give what is free in this process back to the system: Python workers serve many tasks, and each keeps what its largest took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def binaries(column) -> list[bytes]:
    """An Arrow string column as bytes, null as empty, without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
