"""Readers and writers (S1, S4-S13, S17) — schema-first, no inference."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.plans.strategy import grouped_prefix_sum
from reviewlake.session import stage_table

TITLE_SCHEMA = ("tconst string, titleType string, primaryTitle string, originalTitle string, isAdult int, "
                "startYear int, endYear int, runtimeMinutes int, genres string")
RATING_SCHEMA = "tconst string, averageRating double, numVotes int"
PRINCIPAL_SCHEMA = "tconst string, ordering int, nconst string, category string, job string, characters string"
NAME_SCHEMA = ("nconst string, primaryName string, birthYear int, deathYear int, primaryProfession string, "
               "knownForTitles string")
TERM_SCHEMA = "aspect_id int, POS string, term string"
RATING_PHRASE_SCHEMA = "aspect_id int, text string, span string, label string, ordinal int, dataset string"
ANNOTATION_SCHEMA = "id long, text string, rating int, aspect array<array<string>>, label array<array<string>>"


def _tsv(spark: SparkSession, path: str, schema: str, quoting: bool = True) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", True).option("nullValue", "\\N").schema(schema)
    if not quoting:
        r = r.option("quote", "")
    return r.csv(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Title dump, typed, '\\N' nulls, quoting off."""
    return _tsv(spark, path, TITLE_SCHEMA, quoting=False)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, RATING_SCHEMA)


def read_principals(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, PRINCIPAL_SCHEMA)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, NAME_SCHEMA)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted fields that hold line ends, and doubled quotes
    (all columns strings), read in parallel also from one large file.

    Spark's multi-line reader gives a file to one task. Here lines are read by
    splits; a line begins a record iff the number of quotes before it in its
    file is even (doubled quotes do not matter), which is a prefix sum over the
    blocks of the file; lines of a record are put together and parsed. Only
    places and counts go through the prefix sums, texts are moved once."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("idx"))
    lines = stage_table(lines)
    at = ["file", "block", "idx"]
    quotes = lines.select(*at, (F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))).cast("long").alias("q"))
    begins = grouped_prefix_sum(quotes, ["file"], "block", "q", "before", tie=["idx"], inclusive=False) \
        .select(*at, (F.col("before") % 2 == 0).cast("long").alias("begins"))
    numbered = grouped_prefix_sum(begins, ["file"], "block", "begins", "record", tie=["idx"]).select(*at, "record")
    own = F.sort_array(F.collect_list(F.struct("block", "idx", "line")))
    records = lines.join(numbered, at).groupBy("file", "record").agg(own.alias("own")).select(
        "record", F.rtrim(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), F.lit("\r")).alias("text"))
    head = records.where("record = 1").select("text").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = next(csv.reader([head.text.removeprefix("\ufeff")]))
    options = {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = records.where((F.col("record") > 1) & (F.col("text") != ""))
    return rows.select(F.from_csv("text", schema, options).alias("r")).select("r.*")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review CSV (multi-line quoted text); requires title_id, text, rating;
    usage defaults to ''."""
    df = read_quoted_csv(spark, path)
    named = [c for c in df.columns if "text" in c.lower()]
    if named:  # the first column that holds "text" in its name is the text
        df = df.withColumnRenamed(named[0], "text")
    missing = {"title_id", "text", "rating"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks required columns {sorted(missing)}")
    if "usage" not in df.columns:
        df = df.withColumn("usage", F.lit(""))
    return df.withColumn("rating", F.col("rating").cast("int"))


def read_labeled_dirs(spark: SparkSession, root: str) -> DataFrame:
    """``{split}/{neg,pos}/{n}_{rating}.txt`` + ``{split}/urls_{pol}.txt``.

    Rating and n come from the file name, split/polarity from the path, the
    title id from the URL on line rank(n) of the folder's URL list; line
    breaks ``<br /><br />`` become newlines. Ranks use the skew-safe prefix sum.
    """
    files = spark.read.text(f"{root}/*/*/*.txt", wholetext=True) \
        .select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    m = r".*/([^/]+)/(neg|pos)/(\d+)_(\d+)\.txt$"
    f = files.select(F.regexp_extract("path", m, 1).alias("usage"), F.regexp_extract("path", m, 2).alias("pol"),
                     F.regexp_extract("path", m, 3).cast("long").alias("n"),
                     F.regexp_extract("path", m, 4).cast("int").alias("rating"),
                     F.replace(F.col("value"), F.lit("<br /><br />"), F.lit("\n")).alias("text"))
    f = grouped_prefix_sum(f.withColumn("__one", F.lit(1)), ["usage", "pol"], "n", "__one", "line",
                           inclusive=False).drop("__one")
    urls = spark.read.text(f"{root}/*/urls_*.txt", wholetext=True) \
        .select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    u = urls.select(F.regexp_extract("path", r".*/([^/]+)/urls_(neg|pos)\.txt$", 1).alias("usage"),
                    F.regexp_extract("path", r".*/([^/]+)/urls_(neg|pos)\.txt$", 2).alias("pol"),
                    F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "url"))
    u = u.withColumn("title_id", F.element_at(F.split("url", "/"), 5))
    return f.join(u, ["usage", "pol", "line"]).select("title_id", "text", "rating", "usage")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Aspect terms CSV (header skipped, so a byte-order mark in it is harmless)."""
    return spark.read.option("header", True).schema(TERM_SCHEMA).csv(path)


def read_rating_phrases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(RATING_PHRASE_SCHEMA).csv(path)


def read_ambiguous(spark: SparkSession, path: str) -> DataFrame:
    """Ambiguous names, CSV with a header and one column."""
    return spark.read.option("header", True).schema("name string").csv(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation JSONL; mixed-type arrays are read as strings."""
    return spark.read.schema(ANNOTATION_SCHEMA).json(path)


def annotation_tasks(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """S12 shape: per sentence, aspect = [start, end, text, context, ordinal]
    and label = [start, end, 'candidate'] arrays (spans_to_labels)."""
    s = spans.select("sentence_id", F.struct("start", "end", "span", "context", "ordinal").alias("a"))
    g = s.groupBy("sentence_id").agg(F.sort_array(F.collect_list("a")).alias("A"))
    g = g.select(F.col("sentence_id").alias("id"),
                 F.transform("A", lambda a: F.array(a["start"].cast("string"), a["end"].cast("string"), a["span"],
                                                    a["context"], a["ordinal"].cast("string"))).alias("aspect"),
                 F.transform("A", lambda a: F.array(a["start"].cast("string"), a["end"].cast("string"),
                                                    F.lit("candidate"))).alias("label"))
    return sentences.select("id", F.col("sentence").alias("text"), "rating").join(g, "id")


def write_annotation_tasks(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.write.mode("overwrite").json(path)


#: Fixed text: the first header line of a model file, and how the C of each label is named in it.
MODEL_FILE_TITLE = "#SVC model inputs"
MODEL_FILE_LABELS = {"class": "multi-class", "binary_class": "binary"}


def write_features(df: DataFrame, path: str, Cs: dict[str, float]) -> None:
    """Feature rows as tab-separated text; every part file starts with the
    three header lines (title, C of both models) and the column names, so that
    each is a whole model file of its own and rows need no single writer."""
    head = [MODEL_FILE_TITLE, *(f"#{MODEL_FILE_LABELS[k]} C:{Cs[k]}" for k in MODEL_FILE_LABELS), "\t".join(df.columns)]
    lines = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))

    def with_head(batches):
        first = True
        for b in batches:
            if b.num_rows:
                rows = b.column("value").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([*head, *rows] if first else rows, pa.string())], ["value"])
                first = False

    lines.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """The rows of a model file (one file or a folder of them) and each label's C."""
    text = spark.read.text(path)
    top = text.where(F.col("value").startswith("#") | F.col("value").startswith("id\t")).distinct().collect()
    found = {r.value for r in top}
    names = [v.split("\t") for v in found if not v.startswith("#")]
    if len(names) != 1:
        raise ValueError(f"{path}: one line of column names is needed, found {len(names)}")
    Cs = {}
    for label, name in MODEL_FILE_LABELS.items():
        own = {v.split(":")[1].strip() for v in found if v.startswith(f"#{name} C:")}
        if len(own) != 1:
            raise ValueError(f"{path}: one C for {name} is needed, found {sorted(own)}")
        Cs[label] = float(own.pop())
    rows = text.where(~F.col("value").startswith("#") & ~F.col("value").startswith("id\t"))
    parts = F.split("value", "\t", -1)
    kind = lambda c: "double" if "mean" in c else "long" if c == "id" or c[0].isupper() else "int"
    return rows.select(*[F.nullif(F.get(parts, k), F.lit("")).cast(kind(c)).alias(c) for k, c in enumerate(names[0])]), Cs


# -- S17: reviews from stored HTML pages ------------------------------------------

def _inner_text(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
                 ("&middot;", "·"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def element_texts(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Inner text of every ``<tag class="…css_class…">…</tag>`` (non-nested)."""
    cls = "" if css_class is None else rf"[^>]*class=\"[^\"]*{css_class}[^\"]*\""
    pat = rf"(?is)<{tag}{cls}[^>]*>(.*?)</{tag}>"
    return F.transform(F.regexp_extract_all(html, F.lit(pat), 1), _inner_text)


def extract_reviews_from_html(pages: DataFrame, title=("h3", "ipc-title__text"),
                              body=("div", "ipc-html-content-inner-div"),
                              rating=("span", "ipc-rating-star--rating")) -> DataFrame:
    """(text = title + newline + body, rating) per review element of a
    stored page; elements are paired by position and pairing stops at the
    shortest list (Python ``zip``). ``rating=None`` pairs titles and bodies only."""
    h = F.col("html")
    t = element_texts(h, *title)
    b = element_texts(h, *body)
    r = element_texts(h, *rating) if rating else None
    n = F.least(F.size(t), F.size(b), *([F.size(r)] if r is not None else []))
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(idx, lambda i: F.struct(
        F.concat(F.element_at(t, i), F.lit("\n"), F.element_at(b, i)).alias("text"),
        (F.element_at(r, i) if r is not None else F.lit(None).cast("string")).alias("rating")))
    return pages.select("page_id", F.posexplode(rows).alias("pos", "r")).select("page_id", "pos", "r.text", "r.rating")
