"""Labelled training rows, in a sample of bounded size, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, about: the labels' hashes decide which.
SAMPLE = 20_000


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, training: Column | None, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``(id, text, label)`` of about ``sample`` labelled documents, all of them if there are fewer.

    training: the condition, on the id alone, for a label to be used. A null label is none. An id that stands several
    times counts once, with its smallest label and its smallest text, so the sample is bounded whatever repeats; texts of any length
    are taken as a whole. The ids of the sample are few enough to broadcast, so only its own texts are shuffled.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min("label").alias("label"))
    if training is not None:
        known = known.where(training)
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    texts = docs.select(F.col(id_col), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), id_col).groupBy(F.col(id_col).alias("id"), "label").agg(F.min("text").alias("text")).select("id", "text", "label")
