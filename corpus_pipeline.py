"""From raw documents to a training mix: toxicity, near-duplicates, contamination, personal data, mixing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next stage. All but the last return the columns of documents. A stage begins by deleting what
earlier ones wrote on their way, so one pipeline runs at a time in a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mix, pii, similar, toxicity
from plumbline.llm.queries import TOXIC, table
from plumbline.llm.shared import fold, release, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. The model is fitted on the raw, labelled documents."""
    release(spark, but=docs)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, model, TOXIC)


def reject_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles 0.8 alike), the one of the smallest id."""
    release(spark, but=docs)
    return similar.drop_near_duplicates(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage like a benchmark item."""
    release(spark, but=docs)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` is the new length."""
    release(spark, but=docs)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as came, all sources equally often, shuffled."""
    release(spark, but=docs)
    return mix.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", reject_copies),
    ("decontamination", reject_contaminated),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: Trained models and fingerprints are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        release(spark, but=docs)
    return docs
