"""Quality rules, line first.

Each line of a text is judged on its own: by its punctuation, as navigation,
and as boilerplate.  Failing lines are removed; a document that loses more than
``max_lost`` of its word characters that way is rejected, as is one that fails
the base rules on the whole text (too few words, too much repetition).

Words are runs of characters other than blank and ASCII white space (as
UTF-8 bytes: ``bytes.split``), lines are split at ``\\n``.

A line fails if it has words and
* **punctuation**: its symbols ``#*$%&|<>`` exceed ``max_symbols`` per word, or
  its exclamation and question marks exceed ``max_marks`` per word, or, with
  ``min_shout`` words or more, over ``max_upper`` of its cased letters are capitals;
* **navigation**: it has ``min_separators`` separators (``|``, ``»``, ``>``, ``•``,
  ``·`` standing alone) or more, at least one for every four words; or, with ``min_run``
  words or more, fewer than ``min_distinct`` of its words differ;
* **boilerplate**: it is short (``max_boiler`` words at most) and holds a stock phrase.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; repeated rows are judged alike; an empty table gives no rows;
only doc_id and text are read.  Texts of any length are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Stock phrases of boilerplate lines, lower case.
STOCK_PHRASES = (
    "all rights reserved", "cookie policy", "cookies to", "privacy policy", "terms of use", "terms of service",
    "sign in", "log in", "subscribe to", "click here", "read more", "share this", "follow us", "back to top",
    "enable javascript", "lorem ipsum", "skip to content", "licensed under", "copyright (c)", "©",
    "spdx-license-identifier",
)
STOCK = re.compile("|".join(map(re.escape, STOCK_PHRASES)))
SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"[!?]")
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_chars long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
BOOLEANS = ("base_failed", "kept")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules above."""

    min_words: int = 10
    max_repeat: float = 0.2
    max_lost: float = 0.5
    max_symbols: float = 0.25
    max_marks: float = 0.5
    max_upper: float = 0.7
    min_shout: int = 5
    min_separators: int = 3
    min_run: int = 10
    min_distinct: float = 0.3
    max_boiler: int = 20


def line_fails(line: str, words: list[bytes], r: LineRules) -> bool:
    """Whether a line that has words fails one of the rules."""
    n = len(words)
    if len(SYMBOLS.findall(line)) > r.max_symbols * n or len(MARKS.findall(line)) > r.max_marks * n:
        return True
    if n >= r.min_shout and not line.islower():
        upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
        if upper > r.max_upper * (upper + lower):
            return True
    separators = sum(words.count(s) for s in (b"|", b">", "»".encode(), "•".encode(), "·".encode()))
    if separators >= r.min_separators and 4 * separators >= n:
        return True
    if n >= r.min_run and len(set(words)) < r.min_distinct * n:
        return True
    return n <= r.max_boiler and STOCK.search(line.lower()) is not None


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    key = ids[:n]
    for k in range(1, width):  # rank windows of k + 1 words by (rank of k words, next word)
        key = np.unique(key * len(number) + ids[k:n + k], return_inverse=True)[1].astype(np.int64)
        if k < width - 1 and key.max() == n - 1:
            return 0  # all shorter windows differ already
    twice = np.bincount(key)[key] > 1
    step = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step) > 0).sum())


def judge(text: str, r: LineRules) -> tuple[tuple, str]:
    """(the columns of SCHEMA, the text without its failing lines)."""
    words: list[bytes] = []
    seen: set[bytes] = set()
    good, dup, lines, failed, lost = [], 0, 0, 0, 0
    for raw in text.split("\n"):
        own = (b := raw.encode("utf-8")).split()
        if own:
            lines += 1
            dup += b in seen
            seen.add(b)
            words += own
            if line_fails(raw, own, r):
                failed += 1
                lost += len(b"".join(own).decode("utf-8"))
                continue
        good.append(raw)
    chars = len(b"".join(words).decode("utf-8"))
    repeat = repeated_words(words)
    base_failed = len(words) < r.min_words or repeat > r.max_repeat * len(words)
    kept = not base_failed and lost <= r.max_lost * chars
    return (len(words), chars, len(SYMBOLS.findall(text)), dup, repeat, base_failed, kept, lines, failed,
            lost), "\n".join(good)


def assess(docs: DataFrame, rules: LineRules = LineRules(), keep_columns: bool = False) -> DataFrame:
    """doc_id and the judgement's columns; with ``keep_columns`` the rows of
    ``docs`` that are kept, their text without the failing lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t, rules)[0] for t in b.column("text").to_pylist()]
            columns = [pa.array(c, pa.bool_() if k in BOOLEANS else pa.int64()) for k, c in
                       zip(NAMES, zip(*found, strict=True), strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *NAMES])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t or "", rules) for t in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            b = b.set_column(at, b.schema.field(at), pa.array([t for _, t in found], b.schema.field(at).type))
            yield b.filter(pa.array([v[6] for v, _ in found], pa.bool_()))

    if keep_columns:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")) \
        .mapInArrow(run, f"doc_id long, {SCHEMA}")
