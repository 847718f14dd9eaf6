"""Aspect terms, spans, categories and aspect polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake.functions.columns import at

from reviewlake.plans.strategy import least_rows
from reviewlake.operators.polarity import lexicon_polarity, with_polarity_bin
from reviewlake.session import stage_table

CONTEXT_WORDS = 3
#: Pieces of a sentence whose runs are looked at together.
CHUNK = 32


def aspect_terms(terms: DataFrame, aspects: DataFrame) -> DataFrame:
    """Terms with their category (inner join drops ids missing from the
    dimension, trap H7), duplicates removed (unique aspect_id, term), longest first."""
    t = terms.select("aspect_id", "term").distinct()
    return t.join(aspects.withColumnRenamed("id", "aspect_id"), "aspect_id") \
        .select("aspect_id", "category", "term") \
        .orderBy(F.length("term").desc(), "aspect_id", "term")


def _grams(pieces: Column, max_words: int, first: Column, last: Column | None = None) -> Column:
    """Runs of 1..max_words consecutive pieces as struct(i, k, text), those that
    begin at the pieces ``first`` to ``last`` (default: all after ``first`` that
    have a piece after them, so that the run is surrounded by blanks, as in SQL
    ``LIKE '% term %'``)."""
    n = F.size(pieces)

    def runs(k):
        hi = n - k - 1 if last is None else F.least(last, n - k)
        starts = F.when(hi >= first, F.sequence(first, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), text(i, k).alias("text")))

    def text(i, k):
        if k == 1:  # most runs: no array is cut and joined for one piece
            return F.get(pieces, i)
        return F.array_join(F.slice(pieces, i + 1, k), " ")

    return F.concat(*[runs(k) for k in range(1, max_words + 1)])


def _max_words(terms: DataFrame) -> int:
    r = terms.select(F.max(F.size(F.split("term", " "))).alias("m")).first()
    return int(r.m or 1)


def term_matches(sentences: DataFrame, terms: DataFrame, id_col: str = "id",
                 text_col: str = "sentence") -> DataFrame:
    """(sentence id, aspect_id, term) for every term found as
    ``lower(sentence) LIKE '% ' || lower(term) || ' %'`` (blank on both sides;
    a term found twice gives one row, trap H3).

    Per-row arrays are projected as columns and carried along, so Catalyst
    does not inline them into the lambdas (which would recompute them per
    array element)."""
    t = terms.select("aspect_id", F.lower("term").alias("term")).distinct()
    k = _max_words(t)
    d = sentences.select(F.col(id_col).alias("sentence_id"), F.split(F.lower(F.col(text_col)), " ").alias("__p"))
    d = d.select("sentence_id", "__p", F.transform(_grams(F.col("__p"), k, F.lit(1)), lambda g: g["text"])
                 .alias("__grams"))
    hits = d.select("sentence_id", F.explode(F.array_distinct("__grams")).alias("term"))
    return hits.join(t, "term").select("sentence_id", "aspect_id", "term")


def _chunks(pieces: Column, max_words: int) -> Column:
    """A sentence's pieces as array<struct(pieces, lead, core, at)>: every ``CHUNK``
    pieces (``core`` of them, from the place ``lead`` on) with as many pieces
    before and after them as their runs and contexts reach; ``at`` is the piece
    number of the chunk's first one."""
    def one(c):
        lo = F.greatest(c * CHUNK - CONTEXT_WORDS, F.lit(0))
        lead = c * CHUNK - lo
        return F.struct(F.slice(pieces, lo + 1, lead + CHUNK + max_words + CONTEXT_WORDS).alias("pieces"),
                        lead.cast("int").alias("lead"), F.least(F.lit(CHUNK), F.size(pieces) - c * CHUNK).alias("core"),
                        lo.cast("int").alias("at"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), one)


def _chunk_offsets(chunks: DataFrame) -> DataFrame:
    """Adds ``off``: per chunk of the array ``__c`` the characters of the sentence
    before its first own piece. Sums over blocks of ``CHUNK`` chunks keep it
    short for a sentence of any length."""
    def width(c):
        return F.length(F.array_join(F.slice(c["pieces"], c["lead"] + 1, c["core"]), " ")) + F.lit(1)

    def total(a, lo, n):
        return F.aggregate(F.slice(a, lo + 1, n), F.lit(0), lambda x, y: x + y)

    d = chunks.withColumn("__w", F.transform("__c", width))
    blocks = F.sequence(F.lit(0), F.floor(F.size("__w") / CHUNK).cast("int"))
    d = d.withColumn("__b", F.transform(blocks, lambda b: total(F.col("__w"), b * CHUNK, F.lit(CHUNK))))
    off = F.transform("__c", lambda c, j: F.when(
        F.size("__b") > 1, total(F.col("__b"), F.lit(0), F.floor(j / CHUNK).cast("int"))).otherwise(0)
                      + total(F.col("__w"), F.floor(j / CHUNK).cast("int") * CHUNK, j % CHUNK))
    return d.withColumn("off", off).drop("__w", "__b")


def aspect_spans(sentences: DataFrame, terms: DataFrame, id_col: str = "id",
                 text_col: str = "sentence", keep: list[str] | None = None) -> DataFrame:
    """M4 (dictionary form): spans of 1..k blank-separated pieces whose lower
    case equals a term, anywhere in the sentence. Columns: sentence_id, start,
    end (0-based char offsets), span (original case), ordinal (W6: earlier
    spans with the same text), context (lower case, up to 3 pieces each side).

    A run of pieces only ever carries its chunk, never its sentence, and earlier
    spans of the same text are counted by a rank over the spans found: the work
    grows with the length of a sentence, not with its square."""
    t = terms.select(F.lower("term").alias("term")).distinct()
    k = _max_words(terms)
    keep = keep or []
    d = sentences.select(F.col(id_col).alias("sentence_id"), F.xxhash64(text_col).alias("__h"),
                         F.split(F.col(text_col), " ").alias("__p"), *keep)
    # per-row arrays as carried columns (never inlined into the lambdas below)
    d = _chunk_offsets(d.select("sentence_id", "__h", *keep, _chunks(F.col("__p"), k).alias("__c")))
    d = d.select("sentence_id", "__h", *keep, F.explode(F.arrays_zip("__c", "off")).alias("__z"))
    d = d.select("sentence_id", "__h", *keep, "__z.__c.*", "__z.off")
    # only pieces that begin a term start runs: the runs of all others are never built
    begins = t.select(F.get(F.split("term", " "), F.lit(0)).alias("__first")).distinct()
    d = d.select("sentence_id", "__h", *keep, "pieces", "lead", "core", "at", "off", F.posexplode("pieces").alias("__i", "__piece"))
    d = d.where((F.col("__i") >= F.col("lead")) & (F.col("__i") < F.col("lead") + F.col("core"))) \
        .join(begins, F.lower("__piece") == F.col("__first"), "left_semi")
    runs = F.array(*[F.when(F.col("__i") + n <= F.size("pieces"), F.struct(
        F.col("__i").alias("i"), F.lit(n).alias("k"),
        (F.col("__piece") if n == 1 else F.array_join(F.slice("pieces", F.col("__i") + 1, n), " ")).alias("text")))
        for n in range(1, k + 1)])
    d = d.select("sentence_id", "__h", *keep, "pieces", "lead", "at", "off", F.explode(runs).alias("__g")) \
        .join(t, F.lower(F.col("__g.text")) == F.col("term"), "left_semi")
    p, i, kk, lead = F.col("pieces"), F.col("__g.i"), F.col("__g.k"), F.col("lead")
    inside = F.array_join(F.slice(p, lead + 1, i - lead), " ")
    start = F.col("off") + F.length(inside) + F.when(i > lead, 1).otherwise(0)
    ctx_from = F.greatest(i - CONTEXT_WORDS, F.lit(0))
    ctx_len = F.least(i + kk + CONTEXT_WORDS, F.size(p)) - ctx_from
    d = d.select("sentence_id", "__h", *keep, start.cast("int").alias("start"), (F.col("at") + i).alias("__i"),
                 (start + F.length("__g.text")).cast("int").alias("end"),
                 F.col("__g.text").alias("span"),
                 F.lower(F.array_join(F.slice(p, ctx_from + 1, ctx_len), " ")).alias("context"))
    # Rows that repeat a sentence share their places
    before = F.dense_rank().over(W.partitionBy("sentence_id", "__h", "span").orderBy("__i")) - 1
    return d.select("sentence_id", *keep, "start", "end", "span", "context", before.cast("int").alias("ordinal"))


GRAM = 3


def _overlapping(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def contained_terms(contexts: DataFrame, terms: DataFrame) -> DataFrame:
    """(context, term) for every term that is a substring of a context.

    A context holds a term only if it holds each run of ``GRAM`` characters of
    it. Every term waits at its rarest one (the term itself, if shorter), the
    contexts' runs are joined with those, and the few pairs that meet are
    verified. So the work is linear in a context's length, whatever the number
    of terms and of their lengths. Contexts travel as hashes of theirs; a
    collision only makes a pair that the verification drops.
    """
    size = F.length("term")
    runs = F.when(size < GRAM, F.array("term")).otherwise(_overlapping(F.col("term"), GRAM))
    waiting = terms.where(size > 0).select("term", F.explode(runs).alias("gram"))
    ctx = contexts.select("context", F.xxhash64("context").alias("cid"))
    every = F.concat(*[_overlapping(F.col("context"), n) for n in range(1, GRAM + 1)])
    grams = ctx.select("cid", F.explode(every).alias("gram")).join(waiting.select("gram").distinct(), "gram", "left_semi")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = waiting.join(counts, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("term", F.col("r.gram").alias("gram"))
    pairs = grams.join(rarest, "gram").select("cid", "term")
    return pairs.join(ctx, "cid").where(F.col("context").contains(F.col("term"))).select("context", "term")


def words_with_terms(contexts: DataFrame, terms: DataFrame, entry: list[str]) -> DataFrame:
    """(word, found): the blank-separated words of distinct contexts that hold a
    term's longest word, with those terms as array<struct(entry)>.

    A context can hold a term only if one of its words holds the term's longest
    one, so that terms are looked up in the vocabulary, which grows far slower
    than the contexts do. Terms of blanks alone wait at the empty word."""
    parts = F.transform(F.split("term", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    keyed = terms.where(F.length("term") > 0).select(F.array_max(parts)["w"].alias("key"), F.struct(*entry).alias("entry"))
    vocabulary = contexts.select(F.explode(F.split("context", " ")).alias("context")).distinct()
    held = contained_terms(stage_table(vocabulary), keyed.select(F.col("key").alias("term")).distinct())
    blank = keyed.where(F.col("key") == "").select(F.lit("").alias("word"), "entry")
    rows = held.select(F.col("context").alias("word"), F.col("term").alias("key")).join(keyed, "key").select("word", "entry")
    return stage_table(rows.unionByName(blank).groupBy("word").agg(F.collect_list("entry").alias("found")))


def context_categories(contexts: DataFrame, terms_with_category: DataFrame, context: str = "context") -> DataFrame:
    """M3 (J7): categories of every distinct context, as (context, categories).

    The terms found (substrings) in a context are taken longest first (ties:
    aspect id, then term — trap H17), skipping a term contained in an already
    accepted one; 'Overall' is dropped when other categories exist; none ->
    ['Other']. A context meets the vocabulary's words that hold a term in one
    join; terms of several words are verified on the context."""
    t = terms_with_category.select("aspect_id", "category", "term", (-F.length("term")).alias("k")).distinct()
    c = stage_table(contexts.select(F.col(context).alias("context")).distinct())
    none = F.array().cast("array<string>")
    words = words_with_terms(c, t, ["k", "aspect_id", "term", "category"])
    keys = F.array_distinct(F.concat(F.split("context", " "), F.array(F.lit(""))))
    met = c.select("context", F.explode_outer(keys).alias("word")).join(words, "word", "left")
    met = met.groupBy("context").agg(F.flatten(F.collect_list("found")).alias("met"))
    held = met.select("context", F.filter("met", lambda e: F.col("context").contains(e["term"])).alias("held"))
    found = held.select("context", F.array_sort(F.array_distinct("held")).alias("found"))

    init = F.struct(none.alias("terms"), none.alias("cats"))

    def step(acc, e):
        take = ~F.exists(acc["terms"], lambda a: a.contains(e["term"]))
        return F.when(take, F.struct(F.concat(acc["terms"], F.array(e["term"])).alias("terms"),
                                     F.array_union(acc["cats"], F.array(e["category"])).alias("cats"))).otherwise(acc)

    cats = F.aggregate("found", init, step, lambda a: a["cats"])
    cats = F.when(F.size(cats) > 1, F.array_remove(cats, "Overall")).otherwise(cats)
    cats = F.when(F.size("found") > 0, F.array_sort(cats)).otherwise(F.array(F.lit("Other")))
    return found.select(F.col("context").alias(context), cats.alias("categories"))


def aspect_polarity(spans: DataFrame, lexicon: DataFrame, terms_with_category: DataFrame,
                    aspects: DataFrame) -> DataFrame:
    """M5: label of a span = polarity bin of its context window (M1 + M2);
    categories by M3; one row per (span, category) with the aspect id."""
    keyed = spans.withColumn("__sid", F.concat_ws(":", "sentence_id", "start", "end"))
    keep = [c for c in spans.columns]
    pol = with_polarity_bin(lexicon_polarity(keyed, "__sid", "context", lexicon, keep=keep))
    d = pol.join(context_categories(spans, terms_with_category), "context").withColumn("category", F.explode("categories"))
    return d.join(aspects.withColumnRenamed("id", "aspect_id"), "category") \
        .select("sentence_id", *[c for c in ("review_id",) if c in spans.columns], "aspect_id", "category",
                F.col("span").alias("aspect_term"), "ordinal", F.lit("").alias("sentiment_term"), "polarity")


def import_annotations(annotations: DataFrame, terms_with_category: DataFrame, aspects: DataFrame,
                       existing: DataFrame | None = None) -> DataFrame:
    """M7: gold labels from annotation records.

    ``annotations``: id, aspect array<array<string>> [start,end,text,context,ordinal],
    label array<array<string>> [start,end,tag]. Pairs are zipped, 'candidate'
    tags dropped, categories from the context (M3), one row per category,
    verified = 1; rows already in ``existing`` (same 5-part key) are skipped (S14).
    """
    z = annotations.select("id", F.explode(F.arrays_zip("aspect", "label")).alias("z"))
    z = z.where(at("z.label", 3) != "candidate").select(
        F.col("id").alias("sentence_id"),
        at("z.label", 3).alias("polarity"),
        at("z.aspect", 3).alias("aspect_term"),
        at("z.aspect", 4).alias("context"),
        at("z.aspect", 5).cast("int").alias("ordinal"))
    z = z.join(context_categories(z, terms_with_category), "context").withColumn("category", F.explode("categories"))
    rows = z.join(aspects.withColumnRenamed("id", "aspect_id"), "category").select(
        "sentence_id", "aspect_id", "aspect_term", "ordinal", F.lit("").alias("sentiment_term"),
        "polarity", F.lit(1).alias("verified"))
    key = ["sentence_id", "aspect_id", "aspect_term", "ordinal", "verified"]
    rows = least_rows(rows, key)
    if existing is not None:
        rows = rows.join(existing.select(*key), key, "left_anti")
    return rows


def label_counts(sentence_aspect: DataFrame) -> DataFrame:
    """A3: gold labels per aspect, rarest first."""
    return sentence_aspect.where((F.col("verified") == 1) & F.col("aspect_id").isNotNull()) \
        .groupBy("aspect_id").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "aspect_id")


def distinct_polarity(sentence_aspect: DataFrame) -> DataFrame:
    """A4: number of distinct polarities per aspect (gold labels)."""
    return sentence_aspect.where(F.col("verified") == 1).groupBy("aspect_id") \
        .agg(F.count_distinct("polarity").alias("n_polarity"))
