"""Selection queries over reviews and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import config
from reviewlake.functions.columns import has_genre


def reviews_for_title(reviews: DataFrame, title_id: str | None = None) -> DataFrame:
    """Reviews not tagged 'exclude' (null usage is kept)."""
    r = reviews if title_id is None else reviews.where(F.col("title_id") == title_id)
    return r.where(F.coalesce(F.col("usage"), F.lit("")) != "exclude")


def reviews_to_preprocess(reviews: DataFrame) -> DataFrame:
    """backlog = reviews without normalised text."""
    if "normalizedText" not in reviews.columns:
        return reviews
    return reviews.where(F.col("normalizedText").isNull())


def distinct_backlog_titles(reviews: DataFrame) -> DataFrame:
    """Distinct titles with reviews in the backlog."""
    return reviews_to_preprocess(reviews).select("title_id").distinct()


def sentences_to_predict(sentences: DataFrame, reviews: DataFrame, genre_id: int | None = None,
                         chunk: int = config.PREDICT_CHUNK) -> DataFrame:
    """P9 + O3: next page of unanalysed sentences by id (TakeOrderedAndProject)."""
    r = reviews.select(F.col("id").alias("review_id"), "genre_flag")
    if genre_id is not None and genre_id >= 1:
        r = r.where(has_genre("genre_flag", genre_id))
    s = sentences.where(F.col("analyzed") == 0).join(r, "review_id", "left_semi")
    return s.select("id", F.col("sentence").alias("text")).orderBy("id").limit(chunk)


def mark_analyzed(sentences: DataFrame, ids: DataFrame) -> DataFrame:
    """P10 (S15): set analyzed = 1 for the given ids (a left join flag)."""
    flag = ids.select(F.col("id")).distinct().withColumn("__hit", F.lit(1))
    return sentences.join(flag, "id", "left").withColumn(
        "analyzed", F.when(F.col("__hit") == 1, 1).otherwise(F.col("analyzed"))).drop("__hit")


def reset_predictions(sentences: DataFrame, sentence_aspect: DataFrame, reviews: DataFrame,
                      genre_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clear ``analyzed`` and drop predicted (verified = 0) aspect rows,
    for all sentences or only those of reviews with the genre bit."""
    if genre_id is None or genre_id < 1:
        return sentences.withColumn("analyzed", F.lit(0)), sentence_aspect.where(F.col("verified") != 0)
    in_scope = reviews.where(has_genre("genre_flag", genre_id)).select(F.col("id").alias("review_id"), F.lit(1).alias("__in"))
    flagged = sentences.join(in_scope, "review_id", "left")
    s = flagged.withColumn("analyzed", F.when(F.col("__in") == 1, 0).otherwise(F.col("analyzed"))).drop("__in")
    if "review_id" in sentence_aspect.columns:
        scope = sentence_aspect.join(in_scope, "review_id", "left")
    else:
        scope = sentence_aspect.join(flagged.select(F.col("id").alias("sentence_id"), "__in"), "sentence_id", "left")
    gone = (F.col("verified") == 0) & F.col("__in").isNotNull()
    return s, scope.where(~gone).select(*sentence_aspect.columns)


def sample_review(reviews: DataFrame, seed: int = config.SEED) -> DataFrame:
    """One pseudo-random review per title, deterministic by seed.

    ``min_by`` is a partial aggregate: a title with a third of all reviews is
    reduced map-side, never sorted in one task."""
    h = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    return reviews.groupBy("title_id").agg(F.min_by("id", h).alias("id"))
