"""Table maintenance as DataFrame rewrites.

Parquet tables are immutable; an "update" produces the next version of the
table, written by the caller (overwrite into a new folder, or a table format
with MERGE where available).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake.plans.strategy import least_rows


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """INSERT OR IGNORE — incoming rows whose key is new are appended;
    among incoming duplicates the first by ``order_by`` wins (deterministic)."""
    inc = incoming
    if order_by:
        w = W.partitionBy(*keys).orderBy(*order_by)
        inc = inc.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")
    else:
        inc = least_rows(inc, keys)
    new = inc.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def update_from(target: DataFrame, updates: DataFrame, on: list[str], set_cols: list[str]) -> DataFrame:
    """UPDATE … FROM — matched rows take the update's values (one match per key)."""
    u = least_rows(updates.select(*on, *[F.col(c).alias(f"__u_{c}") for c in set_cols]), on)
    j = target.join(u.withColumn("__m", F.lit(True)), on, "left")
    for c in set_cols:
        j = j.withColumn(c, F.when(F.col("__m"), F.col(f"__u_{c}")).otherwise(F.col(c)))
    return j.drop("__m", *[f"__u_{c}" for c in set_cols]).select(*target.columns)


def delete_cascade(parents: DataFrame, delete_when, children: list[tuple[DataFrame, str]],
                   parent_key: str = "id") -> tuple[DataFrame, list[DataFrame]]:
    """Delete parents matching ``delete_when`` and, as ON DELETE CASCADE,
    the children whose foreign key pointed at them (a semi-join on survivors)."""
    kept = parents.where(~F.coalesce(delete_when, F.lit(False)))
    keys = kept.select(F.col(parent_key).alias("__k"))
    out = [c.join(keys, c[fk] == keys["__k"], "left_semi") for c, fk in children]
    return kept, out


def write_sentences(sentences: DataFrame, path: str, buckets: int | None = None) -> None:
    """Sentence table clustered by review_id (files hold whole reviews,
    sorted by sentence id) so later joins/aggregations on review_id read
    co-located data."""
    n = buckets or sentences.sparkSession.sparkContext.defaultParallelism
    sentences.repartition(n, "review_id").sortWithinPartitions("review_id", "id") \
        .write.mode("overwrite").parquet(path)


def write_words(words: DataFrame, path: str) -> None:
    """Word table (sentence_id, pos, word, ws, sentencePart), one row per
    (sentence_id, pos) — of equal keys the least row — clustered by sentence."""
    least_rows(words, ["sentence_id", "pos"]).sortWithinPartitions("sentence_id", "pos").write.mode("overwrite").parquet(path)


def flag_tokenized(reviews: DataFrame, sentences: DataFrame) -> DataFrame:
    """Reviews whose sentences were written get tokenized = 1."""
    ids = sentences.select(F.col("review_id").alias("id")).distinct().withColumn("__t", F.lit(1))
    return reviews.join(ids, "id", "left").withColumn("tokenized", F.coalesce("__t", F.lit(0))).drop("__t")


def refresh_people(titles_old: DataFrame, titles_new: DataFrame) -> DataFrame:
    """People tables are rebuilt from scratch by the caller (overwrite);
    titles are kept and only new ids are added."""
    return insert_ignore(titles_old, titles_new, ["id"])
