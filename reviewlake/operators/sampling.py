"""Sampling for annotation and training sets.

Top-k per group is written as a rank filter with a literal bound
(``dense_rank() < k``); Spark then plans a map-side ``WindowGroupLimit``, so
a group holding a third of all rows is cut to k rows per partition before the
shuffle and never sorted whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake import config
from reviewlake.functions.columns import has_genre, polarity_bin
from reviewlake.operators.aspects import term_matches
from reviewlake.plans.strategy import grouped_prefix_sum
from reviewlake.session import cut_lineage


def sample_sentences(sentences: DataFrame, reviews: DataFrame, terms: DataFrame,
                     limit: int = config.ASPECT_LIMIT, genre_id: int | None = None) -> DataFrame:
    """Distinct sentences ranked below ``limit`` by id within each
    (aspect, polarity bin) — limit-1 per group (trap H4); columns id, text, rating."""
    r = reviews.select(F.col("id").alias("review_id"), "rating", "genre_flag")
    if genre_id is not None and genre_id >= 1:
        r = r.where(has_genre("genre_flag", genre_id))
    s = sentences.join(r.select("review_id"), "review_id", "left_semi")
    hits = term_matches(s, terms).select(F.col("sentence_id").alias("id"), "aspect_id").distinct()
    hits = hits.join(sentences.select("id", F.col("polComp")), "id") \
        .withColumn("polarity", polarity_bin("polComp"))
    w = W.partitionBy("aspect_id", "polarity").orderBy("id")
    picked = hits.withColumn("__n", F.dense_rank().over(w)).where(F.col("__n") < limit).select("id").distinct()
    return picked.join(sentences.select("id", F.col("sentence").alias("text"), "review_id"), "id") \
        .join(r.select("review_id", "rating"), "review_id").select("id", "text", "rating")


def absa_dataset(sentences: DataFrame, sentence_aspect: DataFrame, reviews: DataFrame, genre_id: int,
                 target: int = config.TARGET_PER_ASPECT, train_split: float = config.TRAIN_SPLIT) -> DataFrame:
    """W2 (+W3): balanced gold-label set, aspects rarest first.

    For each aspect (≤ 13 driver steps, each a small job): the quota is
    (target - rows already picked for the aspect) div #polarities; per
    polarity the first quota-1 sentences by id are taken (not yet picked, of
    the genre); all gold rows of the picked sentences are returned, tagged
    'train' when their rank among the picked sentences is below
    max rank × train_split. The rows returned are distinct without the aspect
    (a sentence's label counts once); the aspect is only carried between steps
    for the quota (trap H12). Each step is checkpointed into the shared
    checkpoint folder to cut lineage.
    """
    # the inputs are read by every step: materialise them once (reliable checkpoint)
    gold = cut_lineage(sentence_aspect.where(F.col("verified") == 1)
                       .select("sentence_id", "aspect_id", "aspect_term", "ordinal", "polarity"))
    order = [r.aspect_id for r in gold.where(F.col("aspect_id").isNotNull()).groupBy("aspect_id")
             .agg(F.count(F.lit(1)).alias("n")).orderBy("n", "aspect_id").collect()]
    in_genre = reviews.where(has_genre("genre_flag", genre_id)).select(F.col("id").alias("review_id"))
    s_g = cut_lineage(sentences.join(in_genre, "review_id", "left_semi").select("id", "sentence"))
    dataset = None
    for a in order:
        have = 0 if dataset is None else dataset.where(F.col("aspect_id") == a).count()
        cand = gold.where(F.col("aspect_id") == a).select(F.col("sentence_id").alias("id"), "polarity") \
            .join(s_g.select("id"), "id", "left_semi")
        if dataset is not None:
            cand = cand.join(dataset.select("id").distinct(), "id", "left_anti")
        n_pol = cand.select(F.count_distinct("polarity").alias("n")).first().n
        if not n_pol:
            continue
        quota = (target - have) // n_pol
        w = W.partitionBy("polarity").orderBy("id")
        picked = cand.withColumn("__n", F.dense_rank().over(w)).where(F.col("__n") < quota).select("id").distinct()
        ranked = picked.withColumn("nr", F.dense_rank().over(W.orderBy("id")))  # ≤ target rows: bounded
        max_nr = ranked.agg(F.max("nr").alias("m")).first().m
        if max_nr is None:
            continue
        rows = ranked.join(s_g, "id").join(gold.withColumnRenamed("sentence_id", "id"), "id").select(
            "id", F.col("sentence").alias("text"), F.col("aspect_term").alias("span"),
            F.col("polarity").alias("label"), "ordinal",
            F.when(F.col("nr") < F.lit(max_nr * train_split), "train").otherwise("eval").alias("dataset"),
            "aspect_id").distinct()
        dataset = rows if dataset is None else dataset.unionByName(rows)
        dataset = cut_lineage(dataset)
    if dataset is None:
        schema = "id long, text string, span string, label string, ordinal int, dataset string"
        return sentences.sparkSession.createDataFrame([], schema)
    return dataset.drop("aspect_id").distinct()


def split_tag(ids: DataFrame, train_split: float = config.TRAIN_SPLIT) -> DataFrame:
    """W3: 'train' when the id's dense rank is below max rank × split."""
    d = ids.select("id").distinct().withColumn("__one", F.lit(1))
    r = grouped_prefix_sum(d, [], "id", "__one", "nr").drop("__one")   # dense rank without a single-task window
    m = r.agg(F.max("nr").alias("m")).first().m or 0
    return r.withColumn("dataset", F.when(F.col("nr") < F.lit(m * train_split), "train").otherwise("eval"))


def downsample(df: DataFrame, label: str, order: str = "id") -> DataFrame:
    """Keep rows whose 0-based position within their class is ≤ the
    smallest class size (so min+1 rows of larger classes, trap H11).
    Positions are prefix sums over blocks of ``order``: a class is never sorted in one task."""
    m = df.groupBy(label).count().agg(F.min("count").alias("m")).first().m or 0
    ids = df.select(label, order).withColumn("__one", F.lit(1))
    place = grouped_prefix_sum(ids, [label], order, "__one", "__n").where(F.col("__n") <= m + 1)
    return df.join(place.select(label, order), [label, order], "left_semi")


def shuffled(df: DataFrame, seed: int = config.SEED, key: str = "id") -> DataFrame:
    """Deterministic pseudo-random order (global sort on a seeded hash)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def training_set(absa: DataFrame, rating_phrases: DataFrame) -> DataFrame:
    """Balanced gold set plus labelled rating phrases, by dataset tag."""
    return absa.unionByName(rating_phrases, allowMissingColumns=True)
