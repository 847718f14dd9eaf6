"""X10 with learnt boundaries: abbreviations, collocations and sentence starters
from the corpus itself (the unsupervised method of Kiss and Strunk, 2006).

All three are log-likelihood ratios over counts that are aggregates with
map-side sums; the lists are joined to the places where the rule form of X10
would cut, as rows (text, place, word before, word after) without the text.
A cut goes if the word before is an abbreviation, an initial or an ordinal
number and the word after is no frequent sentence starter, or if the two are a
collocation.

Words are runs of other characters than white space, without quotes and
brackets around them; a type is the word in lower case without its final full
stop, numbers are one type. Null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.columns import col_
from reviewlake.operators.text import split_sentences

#: Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "##number##"
#: Fixed patterns: what is stripped around a word, and what a number looks like.
_AROUND = r"""^[\"'\(\[\{`]+|[\"'\)\]\}`,;:!?]+$"""
_NUMBER = r"^-?[.,]?\d+([.,]\d+)*$"


def word_type(word: Column) -> Column:
    """Lower case without the final full stop; numbers are one type."""
    bare = F.lower(F.regexp_replace(word, r"\.$", ""))
    return F.when(bare.rlike(_NUMBER), F.lit(NUMBER)).otherwise(bare)


def bare_words(c) -> Column:
    """The words of a text, without quotes, brackets and commas around them."""
    words = F.transform(F.split(F.trim(F.regexp_replace(col_(c), r"\s+", " ")), " "),
                        lambda w: F.regexp_replace(w, _AROUND, ""))
    return F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))


def word_pairs(texts: DataFrame, text: str) -> DataFrame:
    """(type, period, next) of every word; ``next`` is the type that follows, null at the end."""
    w = texts.select(bare_words(text).alias("w")).where(F.size("w") > 0)
    rows = w.select("w", F.posexplode("w").alias("i", "word")).select(
        "word", F.get("w", F.col("i") + 1).alias("after"))
    return rows.select(word_type(F.col("word")).alias("type"), F.col("word").endswith(".").alias("period"),
                       word_type(F.col("after")).alias("next"))


def type_counts(pairs: DataFrame) -> DataFrame:
    """Per type: how often it occurs, and how often with a full stop."""
    return pairs.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("period").cast("long")).alias("n_period"))


def _words(counts: DataFrame) -> int:
    return counts.agg(F.sum("n").alias("words")).first().words or 0


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, score) of abbreviations: types that nearly always have their full stop, the shorter the better."""
    total = counts.agg(F.sum("n").alias("words"), F.sum("n_period").alias("ends")).first()
    c = counts.where((F.col("n_period") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}"))
    p1, rest = F.lit((total.ends or 0) / (total.words or 1)), F.col("n") - F.col("n_period")
    null = F.col("n_period") * _log(p1) + rest * _log(1 - p1)
    alt = F.col("n_period") * F.log(F.lit(0.99)) + rest * F.log(F.lit(0.01))
    dots = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    size = (F.length("type") - dots).cast("double")
    score = -2 * (null - alt) * F.exp(-size) * (dots + 1) * F.pow(size, -rest.cast("double"))
    return c.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that b follows a more often than by chance."""
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(1.0)

    def fit(k: Column, m: Column, q: Column) -> Column:
        return k * _log(q) + (m - k) * _log(1 - q)

    return -2 * (fit(ab, a, p) + fit(b - ab, n - a, p) - fit(ab, a, p1) - fit(b - ab, n - a, p2))


def starters(pairs: DataFrame, counts: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """Types that follow a full stop (not an abbreviation's) far more often than by chance."""
    ends = pairs.where(F.col("period") & (F.col("type") != NUMBER)).join(abbrevs.select("type"), "type", "left_anti")
    after = ends.where(F.col("next").isNotNull()).groupBy(F.col("next").alias("type")).agg(F.count("*").alias("ab"))
    total, b = F.lit(float(_words(counts)) or 1.0), F.lit(float(ends.count()) or 1.0)
    j = after.join(counts, "type").where(F.col("type") != NUMBER)
    n, ab = (F.col(x).cast("double") for x in ("n", "ab"))
    j = j.withColumn("score", _ratio(b, n, ab, total)).where((F.col("score") >= STARTER) & (total / b > n / ab))
    return j.select("type", "score")


def collocations(pairs: DataFrame, counts: DataFrame, abbrevs: DataFrame, start: DataFrame) -> DataFrame:
    """Pairs (type, next) whose first word is an abbreviation or a number with a
    full stop and that go together more often than by chance."""
    first = abbrevs.select("type").unionByName(pairs.sparkSession.createDataFrame([(NUMBER,)], "type string"))
    both = pairs.where(F.col("period") & F.col("next").isNotNull()).join(first, "type", "left_semi") \
        .join(start.select(F.col("type").alias("next")), "next", "left_anti") \
        .groupBy("type", "next").agg(F.count("*").alias("ab")).where("ab > 1")
    j = both.join(counts.select("type", F.col("n").alias("a")), "type") \
        .join(counts.select(F.col("type").alias("next"), F.col("n").alias("b")), "next")
    a, b, ab = (F.col(x).cast("double") for x in ("a", "b", "ab"))
    total = F.lit(float(_words(counts)) or 1.0)
    return j.withColumn("score", _ratio(a, b, ab, total)).where(
        (F.col("score") >= COLLOCATION) & (total / a > b / ab)).select("type", "next", "score")


def split_learned(texts: DataFrame, text: str, abbrevs: DataFrame, start: DataFrame, pairs: DataFrame,
                  key: str = "id") -> DataFrame:
    """(key, sentences): the rule form's pieces, joined again where the lists say so."""
    pieces = texts.select(key, split_sentences(text).alias("pieces"))
    ends = pieces.select(key, "pieces", F.posexplode("pieces").alias("i", "piece")).select(
        key, "i", F.regexp_replace(F.regexp_extract("piece", r"(\S+)$", 1), _AROUND, "").alias("last"),
        F.regexp_replace(F.regexp_extract(F.get("pieces", F.col("i") + 1), r"^(\S+)", 1), _AROUND, "").alias("first"))
    cut = ends.where(F.col("first").isNotNull() & F.col("last").endswith(".") & ~F.col("last").endswith("..")).select(
        key, "i", word_type(F.col("last")).alias("type"), word_type(F.col("first")).alias("next"))
    cut = cut.join(abbrevs.select("type", F.lit(True).alias("abbreviated")), "type", "left") \
        .join(start.select(F.col("type").alias("next"), F.lit(True).alias("starts")), "next", "left") \
        .join(pairs.select("type", "next", F.lit(True).alias("together")), ["type", "next"], "left")
    open_end = F.col("abbreviated").isNotNull() | F.col("type").rlike(r"^\p{L}$") | (F.col("type") == NUMBER)
    glued = cut.where(F.col("together").isNotNull() | (open_end & F.col("starts").isNull())) \
        .groupBy(key).agg(F.collect_set("i").alias("glue"))
    j = pieces.join(glued, key, "left").withColumn("glue", F.coalesce("glue", F.array().cast("array<int>")))
    # runs of pieces that stay together: a piece opens a run unless the place before it is glued
    opened = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: ~F.array_contains("glue", i - 1))
    j = j.withColumn("opened", F.when(F.size("pieces") > 0, opened).otherwise(F.array().cast("array<int>")))
    sentences = F.transform("opened", lambda i, k: F.array_join(F.slice(
        "pieces", i + 1, F.coalesce(F.get("opened", k + 1), F.size("pieces")) - i), " "))
    return j.select(key, sentences.alias("sentences"))


def learn(texts: DataFrame, text: str, stage=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(counts, abbreviations, starters, collocations) of a corpus; ``stage``
    writes what several of them read."""
    pairs = stage(word_pairs(texts, text))
    counts = stage(type_counts(pairs))
    abbrevs = stage(abbreviations(counts))
    start = stage(starters(pairs, counts, abbrevs))
    return counts, abbrevs, start, stage(collocations(pairs, counts, abbrevs, start))
