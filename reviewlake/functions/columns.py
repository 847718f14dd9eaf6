"""Scalar Column expressions shared by the operators.

Everything here is a built-in Catalyst expression (JVM, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake import config


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_chars(c, chars: str) -> Column:
    """SQL TRIM(x, chars): strip any of ``chars`` from both ends."""
    return F.btrim(col_(c), F.lit(chars))


def glob_has_letter(c) -> Column:
    """SQLite ``x GLOB '*[a-zA-z]*'``; note the range A-z also admits [\\]^_`."""
    return col_(c).rlike("[a-zA-z]")


def bit(n) -> Column:
    """1 << n as a long (n may be a column)."""
    g = n if isinstance(n, Column) else F.lit(int(n))
    return F.call_function("shiftleft", F.lit(1).cast("long"), g)


def has_genre(flag, genre_id) -> Column:
    """P5: bit ``genre_id`` of the genre bitmask is set."""
    return col_(flag).bitwiseAND(bit(genre_id)) != 0


def short_or_symbolic(c) -> Column:
    """Fewer than 3 characters once blanks and dots are removed, or one
    word without any letter."""
    x = col_(c)
    short = F.length(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("."), F.lit(""))) < 3
    symbolic = (~x.contains(" ")) & (~glob_has_letter(x))
    return short | symbolic


def fix_last_name(c) -> Column:
    """Capitalise a last name unless it starts with d/D or holds '-', ' ' or a quote."""
    x = col_(c)
    eligible = (x.isNotNull() & ~F.lower(x).startswith("d") & ~x.rlike("[- ']")
                & F.substring(x, 1, 1).rlike("^[a-z]$"))
    return F.when(eligible, F.concat(F.upper(F.substring(x, 1, 1)), substring_from(x, 2))).otherwise(x)


def round_half_up(c, digits: int) -> Column:
    """Round on the binary value (floor(|x|·10^d + 0.5)); engine-independent,
    unlike ``round`` which rounds the shortest decimal string of a double."""
    x = col_(c)
    scale = float(10 ** digits)
    # snap to 1e-9 first so that sums taken in a different order agree on ties
    snapped = F.floor(F.abs(x) * 1e9 + 0.5) / 1e9
    # "+ 0.0" turns -0.0 into 0.0 (equal values must hash equal)
    return F.signum(x) * F.floor(snapped * scale + 0.5) / scale + 0.0


def substring_from(c, pos: int) -> Column:
    """substr(x, pos) with open length."""
    x = col_(c)
    return F.substring(x, pos, 1 << 30)


def polarity_bin(c) -> Column:
    """M2: CASE ladder on the compound score (evaluated top-down, BETWEEN inclusive)."""
    x = col_(c)
    return (F.when(x > 0.6, 5).when(x.between(0.2, 0.6), 4).when(x.between(-0.2, 0.2), 3)
            .when(x.between(-0.6, -0.2), 2).otherwise(1))


def polarity_label(c) -> Column:
    """Bin 1..5 -> label very negative .. very positive."""
    labels = config.POLARITY_LABELS
    x = col_(c)
    out = F.when(x == 1, labels[0])
    for i, lab in enumerate(labels[1:], start=2):
        out = out.when(x == i, lab)
    return out


def label_score(c) -> Column:
    """Polarity label -> numeric score (literal map lookup)."""
    m = F.create_map(*[a for k, v in config.POLARITY_SCORES.items() for a in (F.lit(k), F.lit(v))])
    return F.element_at(m, col_(c))


def star_bucket(c) -> Column:
    """Right-closed bins (-1,-0.6], (-0.6,-0.2], (-0.2,0.2], (0.2,0.6], (0.6,1]; -1 included."""
    x = col_(c)
    return (F.when(x.isNull(), None).when(x < -1, None).when(x <= -0.6, 1).when(x <= -0.2, 2)
            .when(x <= 0.2, 3).when(x <= 0.6, 4).when(x <= 1.0, 5))


def rating_class(c) -> Column:
    """Five classes from ten stars, integer division."""
    return F.floor((col_(c) + 1) / 2).cast("int")


def binary_class(c) -> Column:
    """Rating above 6 is positive."""
    return F.when(col_(c) > 6, 1).otherwise(0)


def clean_characters(characters, category) -> Column:
    """Clean the character text of a principal.

    Steps (each a regex pass over the text as a whole; in this chain every
    rule's match set is unaffected by the earlier rules of its pass, so the
    per-pass gating of the original has no effect and plain replacement is exact):
    strip [ ] " from both ends; null for 'self' rows or text starting with
    segment/(segment/self (any case); drop bracketed parts; cut ' - …' and
    '[,:]…'; '_' -> ' '; map quote variants; drop remaining brackets, quotes,
    backslashes and stars; strip quotes and blanks from both ends.
    """
    x = trim_chars(characters, '][""')
    x = F.when((col_(category) == "self") | x.rlike("(?i)^(segment|\\(segment|self)"), F.lit(None)).otherwise(x)
    x = F.regexp_replace(x, "[\\(\\{\\[].+[\\)\\}\\]]", "")
    x = F.regexp_replace(x, " - .+", "")
    x = F.regexp_replace(x, "[,:].+", "")
    x = F.regexp_replace(x, "_", " ")
    x = F.regexp_replace(x, "¨", '"')
    x = F.regexp_replace(x, "[’´]", "'")
    x = F.regexp_replace(x, "[\\\\\\)\\(\\{\\}\\[\\]\"*]", "")
    return trim_chars(x, "' ")


def clean_person_name(c) -> Column:
    """Stars, parentheses and quote variants in names become an apostrophe."""
    return F.regexp_replace(col_(c), "[*\\(\\)\"’´¨]", "'")


def at(arr, i) -> Column:
    """1-based element (negative from the end); null when out of range."""
    return F.try_element_at(col_(arr), i if isinstance(i, Column) else F.lit(i))
