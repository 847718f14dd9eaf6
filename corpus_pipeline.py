"""The corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes what the one before kept and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again for the next.

Defined results: null and empty texts fail the quality rules, so they never
reach the later stages; a null doc_id is a document like others; of rows that
repeat one stays (they are copies); of equal texts the least doc_id stays; very
long texts are judged, masked and packed whole; further columns, whatever their
names, are carried to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, ngram_join, packing, pii, quality
from reviewlake.llm.common import small_batches, table, written
from reviewlake.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    small_batches(spark)
    return _counted(quality.assess(docs, keep_columns=True))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked by its kind."""
    small_batches(spark)
    return _counted(pii.redact(docs, pii.train(docs)))


def packing_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences (their ids, as bytes) with their length bucket, batch and slot."""
    small_batches(spark)
    return packing.pack_bytes(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("PII", pii_redaction),
    ("packing", packing_batches),
]

#: Shingles, tokens and a trained network are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole ``documents`` table; a digest of the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return packing.digests(STAGES[-1][1](spark, docs, sf_dir))
