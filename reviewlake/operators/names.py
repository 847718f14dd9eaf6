"""People names: parse cascade, post-parse, capitalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import rules as R
from reviewlake.functions.columns import at, fix_last_name, trim_chars
from reviewlake.functions.regex import java_pattern

PARTS = ("firstName", "middleName", "lastName", "aliasName")


def _strip_names(p: str) -> str:
    return p.replace("?P<firstName>", "").replace("?P<aliasName>", "").replace("?P<lastName>", "") \
        .replace("?P<middleName>", "")


def _candidate(name: Column, rule) -> Column:
    (kind, arg), extract, groups = rule
    if kind == "match":
        applies = name.rlike(java_pattern("^(?:" + arg + ")"))
    else:
        applies = (F.size(F.split(name, " ")) - 1) == arg
    pat = java_pattern(_strip_names(extract))
    found = name.rlike(pat)
    # group numbers of the named groups, in pattern order (nested groups counted)
    order = [m for m in ("firstName", "aliasName", "middleName", "lastName") if f"?P<{m}>" in extract]
    order.sort(key=lambda g: extract.index(f"?P<{g}>"))
    idx = {}
    pos = 0
    for i, ch in enumerate(extract):
        if ch == "(" and (i == 0 or extract[i - 1] != "\\"):
            pos += 1
            for g in order:
                if extract.startswith(f"(?P<{g}>", i):
                    idx[g] = pos
    vals = {g: F.when(found, F.regexp_extract(name, pat, idx[g])) for g in groups}
    last = vals.get("lastName")
    rejected = F.coalesce((F.length(last) < 3) | F.lower(last).endswith("iii"), F.lit(False)) if last is not None \
        else F.lit(False)
    return F.struct(applies.alias("applies"), (~rejected).alias("ok"),
                    *[(vals[g] if g in vals else F.lit(None).cast("string")).alias(g) for g in PARTS])


def parse_names(names: DataFrame, name_col: str = "primaryName") -> DataFrame:
    """The first rule that selects a name and whose extraction is not
    rejected (last name shorter than 3 or ending 'iii') gives its parts; a
    rejected name falls through to the next rule (one pass, no flags)."""
    name = F.col(name_col)
    cands = F.array(*[_candidate(name, r) for r in R.NAME_RULES])
    win = at(F.filter(cands, lambda c: c["applies"] & c["ok"]), 1)
    d = names.withColumn("__w", win)
    return d.select(*names.columns, *[F.col("__w")[p].alias(f"raw_{p}") for p in PARTS],
                    F.col("__w").isNotNull().cast("int").alias("processed"))


def post_parse(parsed: DataFrame) -> DataFrame:
    """Last names with digits become null, others are trimmed of - ' /;
    noAliasName = first + ' ' + last (raw) when there is an alias."""
    last = F.col("raw_lastName")
    d = parsed.withColumn("firstName", F.col("raw_firstName")).withColumn("middleName", F.col("raw_middleName")) \
        .withColumn("lastName", F.when(last.isNull() | last.rlike("[0-9]"), None).otherwise(trim_chars(last, "-'/"))) \
        .withColumn("aliasName", F.col("raw_aliasName")) \
        .withColumn("noAliasName", F.when(F.col("raw_aliasName").isNotNull(),
                                          F.concat(F.col("raw_firstName"), F.lit(" "), last)))
    return d.drop(*[f"raw_{p}" for p in PARTS])


def capitalise_last_names(names: DataFrame) -> DataFrame:
    """P15."""
    return names.withColumn("lastName", fix_last_name("lastName"))


def preprocess_names(names: DataFrame) -> DataFrame:
    """N1-N7 + P15 in order."""
    return capitalise_last_names(post_parse(parse_names(names)))
