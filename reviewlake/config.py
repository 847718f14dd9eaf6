"""Job parameters with the defaults of the original pipeline's configuration."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the original pipeline's for equal results.
# Title import filters (types, adult flag, first year, minimum runtime, minimum votes).
TITLE_TYPES = ("movie",)
INCL_ADULT = 0
YEAR_MIN = 2000
RUNTIME_MIN = 45
VOTES_MIN = 50
# Sentences per prediction page.
PREDICT_CHUNK = 7500
# Annotation sample size per (aspect, polarity) and balanced-set parameters.
ASPECT_LIMIT = 42
TARGET_PER_ASPECT = 150
TRAIN_SPLIT = 0.85
# Sentence length above which a sentence is split greedily.
SENTENCE_MAXLENGTH = 1000
# Polarity labels, weakest to strongest, and their numeric scores.
POLARITY_LABELS = ("very negative", "negative", "neutral", "positive", "very positive")
POLARITY_SCORES = {
    "very negative": -1.0,
    "negative": -0.5,
    "neutral": 0.1,
    "positive": 0.5,
    "very positive": 1.0,
    "none": 0.0,
}
# Genres that become +1/-1 features of the review classifiers.
FEATURE_GENRES = ("Adventure", "Comedy", "Drama", "Fantasy", "Sci-Fi")
# Regularisation grid (C values) and random-split search settings of the classifiers.
C_GRID = (0.024, 0.05, 0.12, 0.3, 0.5, 1.0, 1.8, 3.0, 5.0, 9.0, 21.0)
SPLIT_TRAIN = 0.7
SPLIT_TEST = 0.2
N_SPLITS = 128
SEED = 42


@dataclass(frozen=True)
class TitleFilter:
    types: tuple[str, ...] = TITLE_TYPES
    incl_adult: int = INCL_ADULT
    year_min: int = YEAR_MIN
    runtime_min: int = RUNTIME_MIN
    votes_min: int = VOTES_MIN
