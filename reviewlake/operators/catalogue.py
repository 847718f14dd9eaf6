"""Catalogue: titles, ratings, genres, principals, names; review import.

S2-S7, J1-J5, P1-P6, P14, A1, A2 of the survey. Dimension tables with a
fixed size (genres, aspects) are broadcast outright; catalogue-sized
tables (titles) go through a size check; fact-sized sides shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.config import TitleFilter
from reviewlake.plans.strategy import least_rows
from reviewlake.functions.columns import bit, clean_characters, clean_person_name, short_or_symbolic, trim_chars


def filter_titles(titles: DataFrame, f: TitleFilter = TitleFilter()) -> DataFrame:
    """Year ≥, adult ≤, type in list, runtime ≥ (nulls fail)."""
    return titles.where((F.col("startYear") >= f.year_min) & (F.col("isAdult") <= f.incl_adult)
                        & F.col("titleType").isin(*f.types) & (F.col("runtimeMinutes") >= f.runtime_min))


def split_genres(titles: DataFrame) -> DataFrame:
    """S3: first three comma-separated genres as ``genre_list`` (trap H19)."""
    return titles.withColumn("genre_list", F.slice(F.split("genres", ","), 1, 3))


def filter_ratings(ratings: DataFrame, votes_min: int = TitleFilter().votes_min) -> DataFrame:
    """Votes present and at least ``votes_min``."""
    return ratings.where(F.col("numVotes").isNotNull() & (F.col("numVotes") >= votes_min))


def titles_join_ratings(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """Titles with their rating (inner equi-join)."""
    return titles.join(ratings, "tconst").select(
        F.col("tconst").alias("id"), "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear",
        "runtimeMinutes", "averageRating", "numVotes")


def title_genres(titles_split: DataFrame, genres: DataFrame, known: DataFrame) -> DataFrame:
    """(title_id, genre_id) by membership of the genre name in the first
    three genres — explode, then an equi-join (no theta join); only titles in
    ``known``; unique pairs."""
    t = titles_split.select(F.col("tconst").alias("title_id"), F.explode("genre_list").alias("displayName"))
    g = t.join(genres, "displayName").select("title_id", F.col("id").alias("genre_id"))
    return g.join(known.select(F.col("id").alias("title_id")), "title_id", "left_semi").distinct()


def with_subtitle(titles: DataFrame) -> DataFrame:
    """Subtitle after ' - ' (else after ': '), trimmed of - ' / #;
    null if shorter than 4, without letters, starting with [0-9a-z],
    '(the) movie', 'Part …' or 'Vol. …' (ASCII case-insensitive LIKE)."""
    t = F.col("primaryTitle")
    dash, colon = F.instr(t, " - "), F.instr(t, ": ")
    sub = (F.when(dash > 0, trim_chars(F.substring(t, dash + 3, 1 << 30), "-'/#"))
           .when(colon > 0, trim_chars(F.substring(t, colon + 2, 1 << 30), "-'/#")))
    bad = ((F.length(sub) < 4) | ~sub.rlike("[a-zA-Z]") | F.substring(sub, 1, 1).rlike("^[0-9a-z]$")
           | F.lower(sub).isin("the movie", "movie") | sub.ilike("Part %") | sub.ilike("Vol. %"))
    return titles.withColumn("subtitle", F.when(bad, F.lit(None)).otherwise(sub))


def import_titles(titles_raw: DataFrame, ratings_raw: DataFrame, genres: DataFrame,
                  f: TitleFilter = TitleFilter(), keep=lambda d: d) -> tuple[DataFrame, DataFrame]:
    """(titles, title_genres).

    Titles without any known genre are dropped (P4, a semi-join). ``keep`` may
    store the titles with their ratings, which both results read."""
    t = split_genres(filter_titles(titles_raw, f))
    joined = keep(least_rows(titles_join_ratings(t, filter_ratings(ratings_raw, f.votes_min)), ["id"]))
    tg = title_genres(t, genres, joined)
    titles = with_subtitle(joined.join(tg.select(F.col("title_id").alias("id")).distinct(), "id", "left_semi"))
    return titles, tg


def genre_flags(title_genres_df: DataFrame) -> DataFrame:
    """A1: genre bitmask per title = OR of 1 << genre_id (= SUM(2^id), pairs unique)."""
    return title_genres_df.groupBy("title_id").agg(
        F.bit_or(bit(F.col("genre_id"))).alias("genre_flag"))


def import_reviews(reviews: DataFrame, titles: DataFrame, title_genres_df: DataFrame) -> DataFrame:
    """J3 + A1: keep reviews of known titles, attach the genre bitmask.

    ``titles`` and the per-title flags are catalogue-sized: broadcast after a
    size check, else a shuffle join where AQE splits hot titles."""
    known = titles.select(F.col("id").alias("title_id"))
    flags = genre_flags(title_genres_df)
    r = reviews.join(known, "title_id", "left_semi").join(flags, "title_id", "left")
    return r.withColumn("genre_flag", F.coalesce("genre_flag", F.lit(0).cast("long")))


def import_counts(reviews: DataFrame, titles: DataFrame) -> DataFrame:
    """A2: (total, imported) in one aggregation (a left join on unique ids)."""
    known = titles.select(F.col("id").alias("title_id")).distinct() \
        .withColumn("__k", F.lit(1))
    j = reviews.select("title_id").join(known, "title_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("__k").alias("imported"))


def filter_principals(principals: DataFrame, titles: DataFrame) -> DataFrame:
    """S5 + S6: principals of known titles with cleaned character text."""
    p = principals.join(titles.select(F.col("id").alias("tconst")), "tconst", "left_semi")
    return p.withColumn("characters", clean_characters("characters", "category")) \
        .select("tconst", "nconst", "category", "job", "characters")


def filter_names(names: DataFrame, principals: DataFrame) -> DataFrame:
    """Names of the principals being imported, punctuation cleaned."""
    ids = principals.select("nconst").distinct()
    return names.join(ids, "nconst", "left_semi").withColumn("primaryName", clean_person_name("primaryName")) \
        .select("nconst", "primaryName", "birthYear", "deathYear")


def import_people(principals: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(person_rows, title_people); principals only for imported
    names, empty character text becomes null."""
    person_rows = least_rows(names.select(F.col("nconst").alias("id"), "primaryName", "birthYear", "deathYear"), ["id"])
    p = principals.join(person_rows.select(F.col("id").alias("nconst")), "nconst", "left_semi")
    title_people = p.select(F.col("tconst").alias("title_id"), F.col("nconst").alias("name_id"), "category",
                               "job", F.when(F.col("characters") == "", None).otherwise(F.col("characters"))
                               .alias("character"))
    return person_rows, title_people


def titles_projection(titles: DataFrame) -> DataFrame:
    """P1."""
    return titles.select("id", "primaryTitle", "startYear")


def titles_for_selection(titles: DataFrame, title_genres_df: DataFrame, genre_id: int | None = None) -> DataFrame:
    """P2: 'title (year)' labels, distinct, optionally for one genre, ordered by label."""
    g = title_genres_df if genre_id is None or genre_id < 1 else title_genres_df.where(F.col("genre_id") == genre_id)
    j = titles.join(g.select(F.col("title_id").alias("id")), "id")
    label = F.concat(F.col("primaryTitle"), F.lit(" ("), F.col("startYear").cast("string"), F.lit(")"))
    return j.select("id", label.alias("title")).distinct().orderBy("title", "id")


def genres_for_title(title_genres_df: DataFrame, genres: DataFrame, title_id: str | None = None) -> DataFrame:
    """Genre names of a title (all titles when ``title_id`` is None)."""
    g = title_genres_df if title_id is None else title_genres_df.where(F.col("title_id") == title_id)
    return g.join(genres.withColumnRenamed("id", "genre_id"), "genre_id") \
        .select("title_id", "displayName")


# -- ambiguity flags (P14, J5, N8) --------------------------------------------

def flag_names_ambiguous(names: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """N8 for names: alias short or symbolic, or the ambiguous list holds the
    last name, the alias, or (no last name) the primary name — J5 as one
    explode + equi semi-join instead of a disjunctive nested loop."""
    keys = names.select("id", F.explode(F.array(
        F.col("lastName"), F.col("aliasName"),
        F.when(F.col("lastName").isNull(), F.col("primaryName")))).alias("name")).where(F.col("name").isNotNull())
    hit = keys.join(ambiguous.select("name").distinct(), "name", "left_semi") \
        .select("id").distinct().withColumn("__hit", F.lit(True))
    short = F.col("aliasName").isNotNull() & short_or_symbolic("aliasName")
    return names.join(hit, "id", "left").withColumn(
        "ambiguous", (short | F.coalesce("__hit", F.lit(False))).cast("int")).drop("__hit")


def flag_principals_ambiguous(principals: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """N8 for characters: short or symbolic, or listed."""
    amb = ambiguous.select(F.col("name").alias("character")).distinct() \
        .withColumn("__hit", F.lit(True))
    p = principals.join(amb, "character", "left")
    short = F.col("character").isNotNull() & short_or_symbolic("character")
    return p.withColumn("ambiguous", (short | F.coalesce("__hit", F.lit(False))).cast("int")).drop("__hit")


def flag_titles_ambiguous(titles: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """N8 for titles (reset, then set): one-word title short or symbolic, or
    listed; same for subtitles."""
    amb = ambiguous.select("name").distinct()
    a_t = amb.select(F.col("name").alias("primaryTitle"), F.lit(True).alias("__ht"))
    a_s = amb.select(F.col("name").alias("subtitle"), F.lit(True).alias("__hs"))
    t = titles.join(a_t, "primaryTitle", "left").join(a_s, "subtitle", "left")
    one_word = ~F.col("primaryTitle").contains(" ")
    amb_t = (one_word & short_or_symbolic("primaryTitle")) | F.coalesce("__ht", F.lit(False))
    amb_s = (F.col("subtitle").isNotNull() & short_or_symbolic("subtitle")) | F.coalesce("__hs", F.lit(False))
    return t.withColumn("ambiguous_title", amb_t.cast("int")) \
        .withColumn("ambiguous_subtitle", amb_s.cast("int")).drop("__ht", "__hs")

