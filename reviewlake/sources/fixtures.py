"""Input views derived from the driver's tables.

The SQL below is written once and runs unchanged in Spark SQL and DuckDB
(the DuckDB side is the correctness oracle). Each view turns the generic
test tables into the shapes of the catalogue (titles, ratings, names,
principals) and of the review corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.operators.dims import ASPECTS, GENRES

BASE_TABLES = ("part", "lineitem", "documents", "pages", "embeddings", "labels")

_TT = "concat('tt', lpad(CAST({k} AS STRING), 7, '0'))"
_NM = "concat('nm', lpad(CAST({k} AS STRING), 7, '0'))"

FX_SQL: dict[str, str] = {}

FX_SQL["fx_title"] = f"""
SELECT {_TT.format(k='p_partkey')} AS tconst,
       CASE WHEN p_partkey % 4 = 0 THEN 'short' ELSE 'movie' END AS titleType,
       CASE WHEN p_partkey % 5 = 0 THEN concat('The ', p_name, ': ', p_type)
            WHEN p_partkey % 5 = 1 THEN concat(p_name, ' - ', p_brand)
            WHEN p_partkey % 5 = 2 THEN concat('The ', p_name, ' (or ', p_type, ')')
            ELSE p_name END AS primaryTitle,
       p_name AS originalTitle,
       CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS isAdult,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1980 + p_size END AS startYear,
       CAST(NULL AS INT) AS endYear,
       CAST(30 + p_partkey % 90 AS INT) AS runtimeMinutes,
       CASE WHEN p_partkey % 3 = 0 THEN 'Action,Drama,Sci-Fi'
            WHEN p_partkey % 3 = 1 THEN 'Comedy,Fantasy'
            WHEN p_partkey % 6 = 2 THEN 'Talk-Show'
            ELSE 'Adventure' END AS genres
FROM part"""

FX_SQL["fx_rating"] = f"""
SELECT {_TT.format(k='l_partkey')} AS tconst,
       round(avg(l_quantity) / 5, 1) AS averageRating,
       CAST(count(*) * 4 AS INT) AS numVotes
FROM lineitem GROUP BY l_partkey"""

FX_SQL["fx_name"] = f"""
SELECT {_NM.format(k='p_partkey')} AS nconst,
       CASE p_partkey % 6 WHEN 0 THEN concat(a, ' ''', t, ''' ', b)
                          WHEN 1 THEN concat(a, ' van ', b)
                          WHEN 2 THEN concat(a, ' ', t, ' ', b)
                          WHEN 3 THEN concat(a, ' ', b, ' Jr.')
                          WHEN 4 THEN concat(a, ' ', b)
                          ELSE a END AS primaryName,
       CAST(NULL AS INT) AS birthYear, CAST(NULL AS INT) AS deathYear
FROM (SELECT p_partkey, substring(p_name, 1, instr(p_name, ' ') - 1) AS a,
             substring(p_name, instr(p_name, ' ') + 1) AS b, lower(p_type) AS t FROM part) x"""

FX_SQL["fx_principal"] = f"""
SELECT DISTINCT {_TT.format(k='l_partkey')} AS tconst,
       {_NM.format(k='(1 + (l_suppkey * 7 + l_linenumber + l_partkey) % (SELECT max(p_partkey) FROM part))')} AS nconst,
       CASE l_linenumber WHEN 1 THEN 'actor' WHEN 2 THEN 'actress' WHEN 3 THEN 'director'
                         WHEN 4 THEN 'writer' WHEN 5 THEN 'composer' WHEN 6 THEN 'self'
                         ELSE 'archive_footage' END AS category,
       CAST(NULL AS STRING) AS job,
       CASE WHEN l_linenumber <= 2 THEN concat('["', l_returnflag, ' ', l_linestatus, ' (voice)"]')
            WHEN l_linenumber = 6 THEN '["Self"]' ELSE NULL END AS characters
FROM lineitem"""

FX_SQL["fx_review"] = f"""
SELECT doc_id AS id, text AS originalText,
       {_TT.format(k='(1 + doc_id % (SELECT max(p_partkey) FROM part))')} AS title_id,
       CAST(1 + (doc_id * 7) % 10 AS INT) AS rating,
       CASE WHEN doc_id % 11 = 0 THEN 'exclude' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS usage
FROM documents"""

FX_SQL["fx_genre"] = f"SELECT * FROM (VALUES {', '.join(map(str, GENRES))}) AS g(id, displayName)"
FX_SQL["fx_aspect"] = f"SELECT * FROM (VALUES {', '.join(map(str, ASPECTS))}) AS a(id, category)"

# Test dictionary: tokens that occur in the invented prose, nested terms
# ("the" inside "and the" / "of the"), one id absent from the aspect
# dimension (13) and one duplicate row.
FX_SQL["fx_term"] = """
SELECT * FROM (VALUES (1, 'n', 'with'), (2, 'n', 'of the'), (3, 'n', 'and the'), (4, 'n', 'the'),
  (4, 'n', 'of that'), (5, 'n', 'that'), (6, 'n', 'of'), (6, 'n', 'of'), (7, 'n', 'for'),
  (8, 'v', 'was'), (9, 'n', 'in'), (10, 'a', 'is'), (11, 'n', 'this'), (12, 'n', 'at'),
  (13, 'n', 'from')) AS w(aspect_id, POS, term)"""

# Test valence lexicon over frequent prose tokens.
FX_SQL["fx_lexicon"] = """
SELECT word, CAST(valence AS DOUBLE) AS valence, kind FROM (VALUES
  ('is', 1.9, 'valence'), ('was', -1.3, 'valence'), ('it', 0.8, 'valence'), ('to', -0.6, 'valence'),
  ('on', 1.2, 'valence'), ('be', -2.1, 'valence'), ('as', 0.5, 'valence'), ('are', 2.4, 'valence'),
  ('from', -1.7, 'valence'), ('by', 1.1, 'valence'), ('that', -0.9, 'valence'), ('an', -3.2, 'valence'),
  ('at', 3.1, 'valence'), ('he', 1.4, 'valence'), ('ly', 2.2, 'valence'), ('ble', -2.6, 'valence'),
  ('tion', 1.6, 'valence'), ('ed', -0.8, 'valence'),
  ('this', 0.293, 'booster'), ('very', 0.293, 'booster'), ('with', -0.293, 'booster'),
  ('for', 0.0, 'negation'), ('not', 0.0, 'negation'), ('in', 0.0, 'negation'), ('but', 0.0, 'contrast')
) AS l(word, valence, kind)"""

# Test list of ambiguous names: words of part names.
FX_SQL["fx_ambiguous"] = """
SELECT * FROM (VALUES ('small'), ('red'), ('ring'), ('gear'), ('blue widget')) AS n(name)"""

FX_ORDER = ("fx_title", "fx_rating", "fx_name", "fx_principal", "fx_review",
            "fx_genre", "fx_aspect", "fx_term", "fx_lexicon", "fx_ambiguous")


def register_base(spark: SparkSession, sf_dir: str, tables=BASE_TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        register_base(spark, sf_dir)
        for name in FX_ORDER:
            spark.sql(FX_SQL[name]).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.spark.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_") or name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
