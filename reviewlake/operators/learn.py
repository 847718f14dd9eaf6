"""Review classifiers and the few-shot label head.

The review classifiers are L1-penalised squared-hinge linear models
(``operators/linear.py``): all models of the regularisation search are fitted
together, one pass over the rows per step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import config
from reviewlake.operators.linear import LinearModel, fit_linear, search, splits_column
from reviewlake.operators.sampling import downsample
from reviewlake.plans.strategy import spread
from reviewlake.session import stage_table
from reviewlake.sources.io import read_features

META = ("id", "class", "binary_class")


def feature_columns(features: DataFrame) -> list[str]:
    """Columns after the targets, in table order (the model's input order)."""
    return [c for c in features.columns if c not in META]


CLASSES = {"class": (1, 2, 3, 4, 5), "binary_class": (0, 1)}


def training_frame(features: DataFrame, label: str, splits: int = 0) -> DataFrame:
    """W4 down-sampling by the label, with the random splits' roles of a row
    when asked for; written once, as the fit passes over it many times, and dealt out
    to all cores, as the files of narrow rows are far fewer than these."""
    d = downsample(features, label, order="id")
    if splits:
        d = d.withColumn("splits", splits_column(F.col("id"), splits))
    return stage_table(spread(d, "id"))


def train_review_classifier(features: DataFrame, label: str = "class", C: float = 1.0) -> LinearModel:
    """M8: a linear model on the down-sampled rows (one against the rest for the 5 classes)."""
    return fit_linear(training_frame(features, label), feature_columns(features), label, list(CLASSES[label]), C)


@dataclass(frozen=True)
class Search:
    """The best C and mean accuracies per C."""

    Cs: tuple[float, ...]
    train: tuple[float, ...]
    test: tuple[float, ...]

    @property
    def best(self) -> float:
        """The first C with the greatest mean test score."""
        return self.Cs[max(range(len(self.Cs)), key=lambda i: (self.test[i], -i))]


def tune(features: DataFrame, label: str = "class", Cs=config.C_GRID, splits: int = config.N_SPLITS, steps: int = 120,
         tolerance: float = 1e-3) -> Search:
    """M9: every C on every random split (70 % train, 20 % test)."""
    got = search(training_frame(features, label, splits), feature_columns(features), label, list(CLASSES[label]),
                 list(Cs), splits, steps=steps, tolerance=tolerance)
    mean = got.mean(axis=0).round(12)
    return Search(tuple(map(float, Cs)), tuple(map(float, mean[:, 0])), tuple(map(float, mean[:, 1])))


def search_and_fit(features: DataFrame, label: str = "class", **options) -> tuple[LinearModel, float]:
    """M9 then M8: the search's best C, and the model fitted with it on all training rows."""
    best = tune(features, label, **options).best
    return train_review_classifier(features, label, best), best


def recreate(spark: SparkSession, path: str) -> dict[str, LinearModel]:
    """M8 from a model file (S13): both models fitted again with the file's C on
    all of its rows (no down-sampling, as when models are recreated elsewhere)."""
    rows, Cs = read_features(spark, path)
    rows = stage_table(spread(rows, "id"))
    return {label: fit_linear(rows, feature_columns(rows), label, list(CLASSES[label]), C) for label, C in Cs.items()}


def predict(model: LinearModel, features: DataFrame) -> DataFrame:
    """A fitted (or loaded) model on feature rows, as column expressions."""
    return features.withColumn("prediction", model.prediction())


def train_label_head(embeddings: DataFrame, label: str = "label", vector: str = "embedding",
                     max_iter: int = 50) -> tuple:
    """M6: multinomial logistic head over embedding vectors, trained and
    evaluated as a job (train/test split by a seeded hash of the id)."""
    d = embeddings.select(F.col("vec_id").alias("id"), array_to_vector(vector).alias("features"),
                          F.col(label).cast("double").alias("label"))
    is_test = (F.pmod(F.xxhash64("id", F.lit(config.SEED)), F.lit(5)) == 0)
    train, test = d.where(~is_test), d.where(is_test)
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, family="multinomial") \
        .fit(train)
    return model, model.transform(test)
