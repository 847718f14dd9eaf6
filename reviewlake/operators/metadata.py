"""Replacement dictionary of every title at once.

The original builds one title's dictionary per query inside a driver loop;
here one job builds the dictionaries of all titles: spellings and name
branches become exploded arrays of structs, UNION-distinct becomes
``distinct`` on (title_id, …), and the per-title set tests (character parts
equal to a title, conflicts) become joins / windows keyed by title_id.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake.functions import rules as R
from reviewlake.functions.regex import escape_for_regex, gated_pass
from reviewlake.session import stage_table

ENTRY_COLS = ("title_id", "category", "mdType", "strSearch", "strReplace", "ambiguous")


def _entry(md_type: str, search: Column, replace: Column, ambiguous: Column, when: Column | None = None) -> Column:
    s = F.struct(F.lit(md_type).alias("mdType"), search.alias("strSearch"), replace.alias("strReplace"),
                 ambiguous.cast("boolean").alias("ambiguous"))
    return s if when is None else F.when(when, s)


def title_spellings(titles: DataFrame) -> DataFrame:
    """Nine spellings of the title (and the subtitle), distinct per title."""
    pt = F.replace(F.col("primaryTitle"), F.lit("¡"), F.lit(""))
    amb = F.col("ambiguous_title")
    tm = F.lit("this movie")
    no_colon = F.replace(pt, F.lit(":"), F.lit(""))
    arr = F.array(
        _entry("title", pt, tm, amb),
        _entry("title", F.replace(pt, F.lit("!"), F.lit("")), tm, amb),
        _entry("title", F.replace(pt, F.lit("?"), F.lit("")), tm, amb),
        _entry("title", F.replace(pt, F.lit(" - "), F.lit("- ")), tm, amb),
        _entry("title", F.replace(pt, F.lit(": The Movie"), F.lit("")), tm, amb, pt.ilike("%: The Movie")),
        _entry("title", no_colon, tm, amb),
        _entry("title", F.replace(no_colon, F.lit(" - "), F.lit(" ")), tm, amb),
        _entry("title", F.replace(no_colon, F.lit(" - "), F.lit("- ")), tm, amb),
        _entry("subtitle", F.col("subtitle"), tm, F.col("ambiguous_subtitle"), F.col("subtitle").isNotNull()))
    e = titles.select(F.col("id").alias("title_id"), F.explode(arr).alias("e")).where(F.col("e").isNotNull())
    return e.select("title_id", F.lit("WORK_OF_ART").alias("category"), "e.*").distinct()


def name_branches(principals: DataFrame, names: DataFrame) -> DataFrame:
    """Six name branches per principal (first, primary, alias, no-alias,
    last, character); categories with '_' are skipped; 'self' -> 'the person'."""
    p = principals.where(~F.col("category").contains("_")).select(
        "title_id", F.col("name_id").alias("id"),
        F.when(F.col("category") == "self", F.lit("the person"))
        .otherwise(F.concat(F.lit("the "), F.col("category"))).alias("cat"),
        "character", F.col("ambiguous").alias("amb_char"))
    j = p.join(names.select("id", "primaryName", "firstName", "lastName", "aliasName", "noAliasName",
                            F.col("ambiguous").alias("amb_name")), "id")
    c = F.col
    arr = F.array(
        _entry("firstName", c("firstName"), F.lit("firstName"), F.lit(0), c("firstName").isNotNull()),
        _entry("name", c("primaryName"), c("cat"), F.when(c("lastName").isNull(), c("amb_name")).otherwise(0),
               c("noAliasName").isNull()),
        _entry("name", c("aliasName"), c("cat"), c("amb_name"), c("aliasName").isNotNull()),
        _entry("name", c("noAliasName"), c("cat"), F.lit(0), c("noAliasName").isNotNull()),
        _entry("name", c("lastName"), c("cat"), c("amb_name"), c("lastName").isNotNull()),
        _entry("character", c("character"), F.lit("the character"), c("amb_char"), c("character").isNotNull()))
    e = j.select("title_id", F.explode(arr).alias("e")).where(F.col("e").isNotNull())
    return e.select("title_id", F.lit("PERSON").alias("category"), "e.*").distinct()


def _paren_parts(search: Column) -> Column:
    """N11 pieces of 'A (B)': stripped of ' )', leading 'or', trailing ' or', ', '."""
    def clean(x):
        s = F.btrim(x, F.lit(" )"))
        s = F.when(s.startswith("or"), F.substring(s, 3, 1 << 30)).otherwise(s)
        s = F.when(s.endswith(" or"), F.substring(s, F.lit(1), F.length(s) - 3)).otherwise(s)
        return F.btrim(s, F.lit(", "))
    return F.transform(F.split(search, "\\("), clean)


def _with_paren_split(md: DataFrame) -> DataFrame:
    """Titles 'A (B)' are kept and also added as 'A' and 'B' (one word -> ambiguous)."""
    s = F.col("strSearch")
    applies = s.endswith(")") & (F.col("mdType") == "title") & (F.size(F.split(s, "\\(")) == 2)
    me = F.struct(s.alias("s"), F.col("ambiguous").alias("a"))
    extra = F.transform(_paren_parts(s), lambda x: F.struct(x.alias("s"), (~x.contains(" ")).alias("a")))
    opts = F.when(applies, F.concat(F.array(me), extra)).otherwise(F.array(me))
    cols = [c for c in md.columns if c not in ("strSearch", "ambiguous")]
    return md.select(*cols, F.explode(opts).alias("__o")) \
        .select(*cols, F.col("__o.s").alias("strSearch"), F.col("__o.a").alias("ambiguous"))


def _with_without_the(md: DataFrame) -> DataFrame:
    """Entries starting 'The ' are kept and also added without it."""
    s = F.col("strSearch")
    me = F.struct(s.alias("s"), F.col("ambiguous").alias("a"))
    cut = F.substring(s, 5, 1 << 30)
    opts = F.when(s.startswith("The "), F.array(me, F.struct(cut.alias("s"), (~cut.contains(" ")).alias("a")))) \
        .otherwise(F.array(me))
    cols = [c for c in md.columns if c not in ("strSearch", "ambiguous")]
    return md.select(*cols, F.explode(opts).alias("__o")) \
        .select(*cols, F.col("__o.s").alias("strSearch"), F.col("__o.a").alias("ambiguous"))


def _with_character_words(md: DataFrame) -> DataFrame:
    """N13 (J9): words of a character that equal a title string of its title are added."""
    titles = md.where(F.col("category") == "WORK_OF_ART").select("title_id", "strSearch").distinct()
    words = md.where((F.col("mdType") == "character") & F.col("strSearch").contains(" ")) \
        .withColumn("strSearch", F.explode(F.split("strSearch", " ")))
    return md.unionByName(words.join(titles, ["title_id", "strSearch"], "left_semi").select(*md.columns))


def _with_conflicts(md: DataFrame) -> DataFrame:
    """An entry conflicts when its string is both a title string and another string of its title."""
    is_title = F.col("category") == "WORK_OF_ART"
    same = W.partitionBy("title_id", "strSearch")
    return md.where(F.col("title_id").isNotNull() & F.col("strSearch").isNotNull()) \
        .withColumn("conflicts", F.max(is_title).over(same) & F.max(~is_title).over(same))


#: Per rewriting rule literals of which every match holds one at least.
_REWRITE_NEEDS = {p: needs for (p, _), needs in zip(R.METADATA_REWRITES, (
    (".",), ("ake-u", "ake-U"), ("pt.",), ("Dr.",), ("Mr.",), ("Mrs.", "Ms."), ("ol.",),
    (" vs", " vS", " Vs", " VS", " v/s", " v/S", " V/s", " V/S"), ("o.", "O.", "r."), ("(",), ("(",), ("(",)), strict=True)}


def metadata_dictionary(titles: DataFrame, principals: DataFrame, names: DataFrame,
                        include_first_names: bool = False) -> DataFrame:
    """One row per dictionary entry of every title.

    Columns: title_id, category, mdType, strSearch, strReplace, ambiguous,
    conflicts, strSearchEscaped, lenSearch. Linear plan: U3 union, one gated
    regex pass (N10), two row-local explodes (N11, N12), joins and aggregates
    on (title_id, strSearch) for the per-title set logic (N13, N14). These read
    the entries six times, so they are written once before them.
    """
    md = title_spellings(titles).unionByName(name_branches(principals, names))          # U3
    md = gated_pass(md, "strSearch", R.METADATA_REWRITES, prefilters=_REWRITE_NEEDS)     # N10
    md = stage_table(_with_without_the(_with_paren_split(md)))                            # N11, N12
    md = _with_conflicts(_with_character_words(md))                                       # N13, N14
    if not include_first_names:
        md = md.where(F.col("mdType") != "firstName")
    return md.withColumn("strSearchEscaped", escape_for_regex(F.col("strSearch"), R.ESCAPE_CHARS)) \
        .withColumn("lenSearch", F.length("strSearch"))


def _ordered_entry() -> Column:
    """O1: an entry as a struct that sorts longest first, category descending,
    then by search, replacement and type (trap H17)."""
    cat_rank = F.when(F.col("category") == "WORK_OF_ART", 0).otherwise(1)
    return F.struct((-F.col("lenSearch")).alias("k1"), cat_rank.alias("k2"), F.col("strSearch"),
                    F.col("strReplace"), F.col("mdType"), F.col("category"), F.col("ambiguous"),
                    F.col("conflicts"), F.col("strSearchEscaped"))


def dictionary_arrays(md: DataFrame) -> DataFrame:
    """O1: per title its sorted entries, plus the upper-cased words of all search strings."""
    g = md.groupBy("title_id").agg(F.sort_array(F.collect_list(_ordered_entry())).alias("entries"),
                                   F.collect_set(F.upper("strSearch")).alias("__u"))
    words = F.array_distinct(F.flatten(F.transform("__u", lambda s: F.split(F.trim(s), "\\s+"))))
    return g.withColumn("words", words).drop("__u")


def usable_entries(md: DataFrame) -> DataFrame:
    """(title_id, entry) of the entries that X7 applies."""
    return md.where(~(F.col("conflicts") | F.col("ambiguous"))).select("title_id", _ordered_entry().alias("entry"))


def wanted_entries(md: DataFrame) -> DataFrame:
    """(title_id, entry) of X13: per search string the first entry that conflicts
    or is ambiguous, unless that one is ambiguous."""
    doubtful = md.where(F.col("conflicts") | F.col("ambiguous"))
    first = doubtful.groupBy("title_id", "strSearch").agg(F.min(_ordered_entry()).alias("entry"))
    return first.where(~F.col("entry.ambiguous")).select("title_id", "entry")


def title_facts(md: DataFrame) -> DataFrame:
    """Per title: whether it has a usable entry, the first of them, and the
    abbreviations (X9) that are words of its search strings."""
    usable = ~(F.col("conflicts") | F.col("ambiguous"))
    upper = F.upper("strSearch")
    words = F.array_intersect(F.split(F.trim(upper), "\\s+"), F.array(*[F.lit(a) for a, _ in R.ABBREVIATIONS]))
    own = F.when(reduce(or_, [upper.contains(a) for a, _ in R.ABBREVIATIONS]), words)  # few entries hold one
    return md.groupBy("title_id").agg(
        F.max(usable).alias("usable"), F.min(F.when(usable, _ordered_entry())).alias("first"),
        F.array_distinct(F.flatten(F.collect_set(own))).alias("known"))


def first_replacement(md: DataFrame) -> DataFrame:
    """First entry (sort order of O1) per (title, search string)."""
    cat_rank = F.when(F.col("category") == "WORK_OF_ART", 0).otherwise(1)
    w = W.partitionBy("title_id", "strSearch").orderBy(cat_rank, "strReplace", "mdType")
    return md.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")
