"""Regex rule chains as Spark expressions.

Patterns are kept in Python ``re`` syntax (see :mod:`rules`) and converted
here: ``(?Ud)`` gives Python's Unicode ``\\s \\d \\w`` and its newline-only
line terminator, ``\\v`` becomes ``\\x0B`` (Java reads ``\\v`` as all vertical
space), and replacement back-references ``\\1`` become ``$1``.

A *gated pass* follows pandas ``Series.replace(regex={...})``: every rule is
tested against the text as it was at the start of the pass, and rule *i* is
only applied to rows that matched then (trap H1). Each rule becomes one
projection that reads the pass's start text and the previous rule's output
by column reference, so the expression tree stays linear in the number of
rules (Catalyst does not collapse projections that would duplicate a
non-trivial expression) and every pattern is a constant compiled once per task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BACKREF = re.compile(r"\\(\d)")


_UNICODE_CLASS = re.compile(r"(?<!\\)(?:\\\\)*\\[sSdDwWbB]")


def java_pattern(p: str, ignore_case: bool = False) -> str:
    p = re.sub(r"(?<!\\)((?:\\\\)*)\\v", r"\1\\x0B", p)
    # Unicode classes only where the pattern uses \s \d \w \b (they cost time).
    flags = "d" + ("U" if _UNICODE_CLASS.search(p) else "") + ("iu" if ignore_case else "")
    return f"(?{flags}){p}"


def java_replacement(r: str) -> str:
    r = r.replace("$", "\\$")
    return _BACKREF.sub(lambda m: "$" + m.group(1), r)


def replace(c: Column, pattern: str, repl: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, java_pattern(pattern, ignore_case), java_replacement(repl))


NON_ASCII = object()


def _prefilter(start: Column, needs) -> Column:
    """Necessary condition for a match: the text holds one of ``needs``
    (literal substrings, cheaper patterns, or NON_ASCII = some multi-byte
    character). Literals are byte-level tests on the UTF-8 value, no decoding
    and no regex scan."""
    cond = F.lit(False)
    for n in needs:
        if isinstance(n, re.Pattern):
            cond = cond | start.rlike(java_pattern(n.pattern))
        else:
            cond = cond | ((F.length(start) != F.octet_length(start)) if n is NON_ASCII else start.contains(n))
    return cond


def gated_pass(df: DataFrame, column: str, rules, ignore_case: bool = False, prefilters: dict | None = None) -> DataFrame:
    """One pandas-style gated pass over ``column`` (see module docstring).

    ``prefilters`` maps a rule pattern to literals of which every match
    contains at least one; the regex gate then only runs on texts that have
    one (exact: the prefilter is a necessary condition of the gate)."""
    start = f"__{column}_start"
    out = df.withColumn(start, F.col(column))
    for p, r in rules:
        jp, jr = java_pattern(p, ignore_case), java_replacement(r)
        gate = F.col(start).rlike(jp)
        if prefilters and p in prefilters:
            gate = _prefilter(F.col(start), prefilters[p]) & gate
        out = out.withColumn(
            column, F.when(gate, F.regexp_replace(F.col(column), jp, jr)).otherwise(F.col(column)))
    return out.drop(start)


def escape_for_regex(c: Column, chars_pattern: str) -> Column:
    """Backslash-escape the characters matched by ``chars_pattern`` (one group)."""
    return F.regexp_replace(c, java_pattern(chars_pattern), "\\\\$1")


# -- whole texts through many rules --------------------------------------------

def passes(c: Column, rule_passes, prefilters: dict) -> Column:
    """Gated passes over a text, then NFKC and ``strip``: one Arrow-batched
    function, which scans a text once per rule that can match and keeps no
    copy per rule (per core about five times the speed of a projection per
    """
    needs = [[tuple(prefilters.get(p, ())) for p, _ in rules] for rules in rule_passes]
    tables = [[(p, r, tuple(x for x in need if isinstance(x, str)), tuple(x for x in need if isinstance(x, re.Pattern)),
                NON_ASCII in need) for (p, r), need in zip(rules, own, strict=True)]
              for rules, own in zip(rule_passes, needs, strict=True)]

    @F.pandas_udf(StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [[(re.compile(p), *rest) for p, *rest in rules] for rules in tables]
        for s in texts:
            yield s.map(lambda t: None if t is None else _through(t, compiled))

    return run(c)


def _through(text: str, compiled) -> str:
    for rules in compiled:
        start = text
        plain = start.isascii()
        for pattern, repl, words, parts, wide in rules:
            if words or parts or wide:
                for w in words:
                    if w in start:
                        break
                else:
                    if not (wide and not plain) and not any(p.search(start) for p in parts):
                        continue
            if pattern.search(start):
                text = pattern.sub(repl, text)
    return unicodedata.normalize("NFKC", text).strip()


# -- Unicode normal form -----------------------------------------------------

_PY_STRIP = "[\\s\\x1c-\\x1f]"


@F.pandas_udf(StringType())
def _nfkc_strip(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC").str.strip()


def nfkc_strip(c: Column) -> Column:
    """Unicode NFKC + Python ``str.strip()``.

    ASCII-only text is already in NFKC, so only rows with a non-ASCII
    character are sent through the (Arrow-batched) Python function; the rest
    stay in the JVM. Python's strip on ASCII text removes blanks, tabs,
    line breaks and the \\x1c-\\x1f separators.
    """
    non_ascii = c.rlike("[^\\x00-\\x7F]")
    ascii_path = F.regexp_replace(c, f"^{_PY_STRIP}+|{_PY_STRIP}+$", "")
    py_path = _nfkc_strip(F.when(non_ascii, c))
    return F.when(non_ascii, py_path).otherwise(ascii_path)
