"""Fixed dimensions (S18): genres and aspect categories as small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the original pipeline's: genre (id, name).
GENRES = ((1, "Action"), (2, "Adventure"), (3, "Animation"), (4, "Biography"), (5, "Comedy"), (6, "Crime"),
          (7, "Documentary"), (8, "Drama"), (9, "Family"), (10, "Fantasy"), (11, "History"), (12, "Horror"),
          (13, "Musical"), (14, "Mystery"), (15, "Romance"), (16, "Sci-Fi"), (17, "Sport"), (18, "Thriller"),
          (19, "War"), (20, "Western"))
# Fixed values that must equal the original pipeline's: aspect (id, category).
ASPECTS = ((0, "Other"), (1, "Audio"), (2, "Effects"), (3, "Scene"), (4, "Story"), (5, "Direction"), (6, "Cast"),
           (7, "Message"), (8, "Emotion"), (9, "Comparison"), (10, "General"), (11, "Overall"), (12, "Audience"))


def genre_dim(spark: SparkSession) -> DataFrame:
    """20 genres; broadcast wherever joined (fixed size)."""
    return spark.createDataFrame(list(GENRES), "id int, displayName string")


def aspect_dim(spark: SparkSession) -> DataFrame:
    """13 aspect categories; broadcast wherever joined (fixed size)."""
    return spark.createDataFrame(list(ASPECTS), "id int, category string")
