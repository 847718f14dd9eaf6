"""Per-review feature rows, targets, aspect ratings and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import config
from reviewlake.functions.columns import (binary_class, has_genre, label_score, rating_class, round_half_up,
                                          star_bucket)


def feature_names(aspect_categories: list[str]) -> tuple[list[str], list[str], list[str]]:
    """H10 column order: genre flags (by genre id), mean, counts (category
    alphabetical × 5 polarities, then None_none), means (alphabetical, None)."""
    cats = sorted(aspect_categories)
    counts = [f"{c}_{p.replace(' ', '_')}" for c in cats for p in config.POLARITY_LABELS] + ["None_none"]
    means = [f"{c}_mean" for c in cats] + ["None_mean"]
    flags = [f"genre_{g.replace('-', '_')}" for g in config.FEATURE_GENRES]
    return flags, counts, means


def filter_reviews(reviews: DataFrame, review_id=None, genre_id=None, usage=None, ratings=None) -> DataFrame:
    """Optional filters on id, genre bit, usage tag and a list of ratings."""
    r = reviews
    if review_id is not None:
        r = r.where(F.col("id") == review_id)
    if genre_id is not None:
        r = r.where(has_genre("genre_flag", genre_id))
    if usage is not None:
        r = r.where(F.col("usage") == usage)
    if ratings is not None:
        r = r.where(F.col("rating").isin(list(ratings)))
    return r


def review_features(reviews: DataFrame, sentences: DataFrame, sentence_aspect: DataFrame,
                    aspects: DataFrame, genres: DataFrame, categories: list[str] | None = None,
                    analyzed_only: bool = True, **filters) -> DataFrame:
    """A5 + A6: one wide row per review that has an analysed sentence.

    Semantics of the original SQL: review ⨝ sentence (analysed) ⟕ predicted
    aspect rows (verified = 0) ⟕ aspect; mean_review_polarity averages the
    *joined* rows (a sentence with n aspects weighs n, trap H9); counts use
    IFNULL(category,'None') × IFNULL(polarity,'none'); means are 0 when empty.

    Plan: the aspect rows carry review_id, so with
    ``spark.sql.requireAllClusterKeysForCoPartition=false`` joins and
    aggregation share one partitioning on review_id; counts and skew are AQE's.
    """
    if categories is None:
        categories = [r.category for r in aspects.select("category").collect()]
    flags, counts, means = feature_names(categories)
    genre_ids = {r.displayName: r.id for r in genres.where(F.col("displayName").isin(*config.FEATURE_GENRES)).collect()}

    r = filter_reviews(reviews, **filters).select(F.col("id").alias("review_id"), "rating", "genre_flag")
    s = sentences
    if analyzed_only and "analyzed" in s.columns:
        s = s.where(F.col("analyzed") == 1)
    s = s.select("review_id", F.col("id").alias("sentence_id"), F.col("polComp"))
    sa = sentence_aspect.where(F.col("verified") == 0)
    a = aspects.select(F.col("id").alias("aspect_id"), "category")
    if "review_id" in sa.columns:
        sa = sa.select("review_id", "sentence_id", "aspect_id", "polarity")
        j = r.join(s, "review_id").join(sa, ["review_id", "sentence_id"], "left")
    else:
        sa = sa.select("sentence_id", "aspect_id", "polarity")
        j = r.join(s, "review_id").join(sa, "sentence_id", "left")
    j = j.join(a, "aspect_id", "left")

    cat = F.coalesce(F.col("category"), F.lit("None"))
    pol = F.coalesce(F.col("polarity"), F.lit("none"))
    aggs = [F.avg("polComp").alias("mean_review_polarity")]
    combos = [(c, p) for c in sorted(categories) for p in config.POLARITY_LABELS] + [("None", "none")]
    for (c, p), name in zip(combos, counts):
        aggs.append(F.sum(F.when((cat == c) & (pol == p), 1).otherwise(0)).cast("long").alias(name))
    for c, name in zip(sorted(categories) + ["None"], means):
        aggs.append(F.coalesce(F.avg(F.when(cat == c, F.col("polComp"))), F.lit(0.0)).alias(name))
    g = j.groupBy("review_id", "rating", "genre_flag").agg(*aggs)

    flag_cols = [F.when(has_genre("genre_flag", genre_ids[gname]), 1).otherwise(-1).alias(fname)
                 for gname, fname in zip(config.FEATURE_GENRES, flags) if gname in genre_ids]
    return g.select(F.col("review_id").alias("id"), rating_class("rating").alias("class"),
                    binary_class("rating").alias("binary_class"), *flag_cols,
                    "mean_review_polarity", *counts, *means)


def empty_features(feature_columns: list[str]) -> dict:
    """Default value per feature column (genre -1, means 0.0, counts 0) for ``na.fill``."""
    out = {}
    for c in feature_columns:
        if c.startswith("genre_"):
            out[c] = -1
        elif "mean" in c:
            out[c] = 0.0
        else:
            out[c] = 0
    return out


def aspect_ratings(sentences: DataFrame, sentence_aspect: DataFrame) -> DataFrame:
    """Per (review, aspect) mean compound, mean label score and star bucket.

    Sentences without aspects count as aspect 'None' with label 'none'.
    Bins are right-closed (trap H6)."""
    j = sentences.select("review_id", F.col("id").alias("sentence_id"), "polComp") \
        .join(sentence_aspect.select("sentence_id", "category", "polarity"), "sentence_id", "left")
    j = j.withColumn("category", F.coalesce("category", F.lit("None"))) \
        .withColumn("polarity", F.coalesce("polarity", F.lit("none")))
    g = j.groupBy("review_id", "category").agg(
        F.avg("polComp").alias("compound"), F.avg(label_score("polarity")).alias("polarity_value"))
    # bucket the mean snapped to 1e-9, so that means equal to a bin edge land on the edge
    return g.withColumn("rating", star_bucket(round_half_up("polarity_value", 9)))


def score_features(reviews: DataFrame, sentences: DataFrame, sentence_aspect: DataFrame,
                   aspects: DataFrame, genres: DataFrame, weighting: str = "sentences") -> DataFrame:
    """Inference features for all reviews at once. ``weighting`` says what
    the review mean averages (trap H9): ``sentences``, each once, or ``rows``,
    as A5 does, a sentence with n aspects n times."""
    base = review_features(reviews, sentences, sentence_aspect, aspects, genres, analyzed_only=False)
    if weighting == "rows":
        return base
    per_sentence = sentences.groupBy("review_id").agg(F.avg("polComp").alias("__m"))
    return base.join(per_sentence, base["id"] == per_sentence["review_id"]) \
        .withColumn("mean_review_polarity", F.col("__m")).drop("__m", "review_id")


def overall_rating(aspect_ratings_df: DataFrame, predicted: DataFrame) -> DataFrame:
    """A10: the 'Overall' aspect bucket when present, else the classifier's class."""
    ov = aspect_ratings_df.where(F.col("category") == "Overall").select("review_id", F.col("rating").alias("__r"))
    return predicted.join(ov, "review_id", "left").withColumn(
        "overall", F.coalesce(F.col("__r"), F.col("prediction").cast("int"))).drop("__r")


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts normalised by true class."""
    c = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("y").agg(F.sum("n").alias("n_true"))
    return c.join(tot, "y").withColumn("rate", F.col("n") / F.col("n_true")).drop("n_true")


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Balanced accuracy and Matthews correlation from the k×k counts
    (the counts table is at most k² rows; metrics are one aggregation)."""
    c = pred.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")) \
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    per_true = c.groupBy("y").agg(F.sum("n").alias("t_k"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))
                                                                  .otherwise(0.0)).alias("c_k"))
    per_pred = c.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("p_k"))
    k = per_true.join(per_pred, "y", "full").na.fill(0.0)
    m = k.agg(F.avg(F.when(F.col("t_k") > 0, F.col("c_k") / F.col("t_k"))).alias("balanced_accuracy"),
              F.sum("c_k").alias("c"), F.sum("t_k").alias("s"),
              F.sum(F.col("p_k") * F.col("t_k")).alias("pt"),
              F.sum(F.col("p_k") * F.col("p_k")).alias("pp"), F.sum(F.col("t_k") * F.col("t_k")).alias("tt"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    mcc = F.when(den == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("pt")) / den)
    return m.select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round(mcc, 6).alias("mcc"))
