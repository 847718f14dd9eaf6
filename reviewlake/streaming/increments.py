"""Incremental forms of the backlog loops (T1-T3) with Structured Streaming.

The original re-selects "rows not processed yet" in a loop; here a file
source + checkpoint tracks what was processed. Each micro-batch runs the
same batch operators (``foreachBatch``) and writes idempotently: the batch id
is part of the output path, so a retried batch overwrites its own output.
Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.plans.strategy import least_rows
from reviewlake.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_batches(spark: SparkSession, src: str, schema, out: str, process, max_files: int = 1,
                   checkpoint: str | None = None) -> None:
    """Run ``process(batch_df, batch_id)`` over every new file of ``src``; results
    go to ``out/batch=<id>`` (overwrite per batch id = idempotent retries)."""
    ckpt = checkpoint or out + "_ckpt"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
    _run(stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out, process)), ckpt)


def write_batch(batch: DataFrame, batch_id: int, out: str, process) -> None:
    """One micro-batch; also what a retry of the batch runs again."""
    process(batch, batch_id).write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))


def earlier(spark: SparkSession, out: str, batch_id: int, schema: str) -> DataFrame:
    """Rows (``schema``) that batches before ``batch_id`` have written: never
    those of the batch itself, so a retry sees what its first attempt saw."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", out).parquet(out)
    return rows.where(F.col("batch") < batch_id).drop("batch")


def preprocess_batch(spark: SparkSession, out: str, preprocess):
    """T1 for one batch: sentence ids continue from the greatest id stored by earlier batches."""
    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        last = earlier(spark, out, batch_id, "id bigint").agg(F.max("id")).first()[0] or 0
        return preprocess(batch, last + 1)
    return process


def stream_preprocess(spark: SparkSession, src: str, out: str, preprocess) -> DataFrame:
    """New reviews only — each micro-batch of review files is split into
    sentences with polarity by ``preprocess(batch, first id)``."""
    schema = spark.read.parquet(src).schema
    stream_batches(spark, src, schema, out, preprocess_batch(spark, out, preprocess))
    return spark.read.parquet(out)


def first_rows(spark: SparkSession, src: str, schema, out: str, keys: list[str]) -> None:
    """Rows of the new files of ``src`` whose key no earlier row had, appended to
    ``out``.  The keys seen are the query's state, kept per key by the state
    store: a run reads the new files and looks their keys up, never the history."""
    stream = spark.readStream.schema(schema).parquet(src).dropDuplicates(keys)
    _run(stream.writeStream.format("parquet").option("path", out).outputMode("append"), out + "_state")


def keyed_batch(spark: SparkSession, out: str, predict, keys: list[str]):
    """T2 and T3 for one batch, as insert-or-ignore: among equal keys of the
    batch the least row wins, and a key that an earlier batch has stored is
    skipped.  The batch's rows replace those of an earlier attempt; what that
    attempt had passed on is in the state, so nothing is inserted twice."""
    staged = out + "_staged"

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = least_rows(predict(batch), keys)
        rows.write.mode("overwrite").parquet(os.path.join(staged, f"batch={batch_id}"))
        first_rows(spark, staged + "/*", rows.schema, out, keys)
    return process


def stream_predict(spark: SparkSession, src: str, out: str, predict, keys: list[str], max_files: int = 1) -> DataFrame:
    """Predict aspect rows chunk by chunk; a row whose key is stored is
    skipped, so a re-run after a failure inserts nothing twice."""
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", max_files).parquet(src)
    _run(stream.writeStream.foreachBatch(keyed_batch(spark, out, predict, keys)), out + "_ckpt")
    return spark.read.parquet(out)


def stream_dedupe(spark: SparkSession, src: str, out: str, keys: list[str], max_files: int = 1) -> DataFrame:
    """Insert-or-ignore of arriving rows by their key."""
    return stream_predict(spark, src, out, lambda batch: batch, keys, max_files)


def stage_files(df: DataFrame, path: str, files: int = 4, key: str = "id") -> str:
    """Write ``df`` as several parquet files (stream input for tests/queries)."""
    df.repartition(files, key).write.mode("overwrite").parquet(path)
    return path
