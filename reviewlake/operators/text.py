"""Review text: normalise, replace catalogue names, split, repair, tokenise.

X1-X16 of the survey. All steps are Catalyst expressions over whole review
texts (no prefixes); the only Python step is the NFKC normal form, and only
for rows that contain a non-ASCII character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake import config
from reviewlake.functions import rules as R
from reviewlake.functions.columns import at, col_
from reviewlake.functions.regex import NON_ASCII, java_pattern, passes, replace
from reviewlake.plans.strategy import grouped_prefix_sum, spread
from reviewlake.session import stage_table

SEP = "\u0001"


def _once(c: Column, f) -> Column:
    """``f`` of the value of ``c``: inside lambdas Spark shares no expressions, so one
    that ``f`` names several times would be computed as often per element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# A blank between two initials that belongs to a run of three or more
# initials "A. B. C." (the same blanks the callback of the original removes).
_SPACED_INITIAL_BLANK = (r"(?<=[A-Z]\.)(?= [A-Z]\.)(?:(?<=[A-Z]\. [A-Z]\.)|(?= [A-Z]\. [A-Z]\.)) ")


def collapse_spaced_initials(c) -> Column:
    """X1: 'A. B. C.' -> 'A.B.C.'."""
    return F.regexp_replace(col_(c), java_pattern(_SPACED_INITIAL_BLANK), "")


_NO_STOP = r"\n(?<=[^\.,:;!\?]\n)"  # a line that ends without a stop
_LINE = tuple(re.compile(p) for p in (_NO_STOP + " ?[A-Z]", _NO_STOP + " ?[>-]", r"\n ?[>-]", _NO_STOP + r" ?\d", r"\n ?\d"))
#: Per normalisation rule, in the order of its pass, what every match holds: literals, a
#: cheaper pattern or a multi-byte character, one of them at least; empty: the rule is always tried.
_NORMALIZE_NEEDS = (
    (("://", "www."), (".com", ".net", ".htm"), ("#", "@"), *((p,) for p in _LINE), ("...",), ("\\",), ("==",), ("----",),
     ("++++",), ("******",), ("??", "?."), ("!!", "!."), (",,",), ("..", ". ."), (NON_ASCII,),
     (":)", ";)", ":|", ";|", ": )", "; )", ": |", "; |"), (":(",), (" ^",), ("=)",), ("<)", "<3"),
     ("*sigh*", "*cough*", "*yawn*", "*rolls eyes*"), (), ("r@", "R@"), ("b@", "B@"), ("h@", "H@"), (NON_ASCII,),
     ("''", "`", NON_ASCII), (NON_ASCII,), (" @ ",), ("(=",)),
    (("_", "~", "{", "}", ">", "<", NON_ASCII), ("\nwebsite", "\n(website"), ("@",), ("*", "'"), (), ("(",), ("(R.I.P.)",),
     ("tl", "tL", "Tl", "TL"), ("(",), ("(",), ("(",)),
    (("website website",), (",",), (re.compile(r"\.[A-Z]"),), ("...",), (";",), ("!", "?"), ("(",), (")",),
     (re.compile(":[^ ]"),), (".g.", ".e."), ("etc. ",), ("--",), (" Im ",), (" isnt ",), (" arnt ",), (" didnt ",),
     (" back ground ",), ("ake-u", "ake-U"), ("low-m", "low-M"), ("riter",), ("master piece",), (" alround ",), ("pt.",),
     ("Dr.",), ("Mr.",), ("Mrs.", "Ms."), (".g.", ".G."), ("ol.",), ("R.I.P.",), ("b/c ",), ("w/ ",), ("w/o ",),
     (" vs", " vS", " Vs", " VS", " v/s", " v/S", " V/s", " V/S"), ("ontd.",), (" no. ", " nr. ", " No. ", " Nr. "),
     ("appr.",), ("pp.",)),
    ((" -",), ("-",), (".. ",), (". . ",), (" , ",), ("  ",)))


def _normalize_prefilters() -> dict:
    """What every match of a normalisation rule must contain (derived from the
    patterns; each is a necessary condition)."""
    return {p: needs for rules, own in zip(R.NORMALIZE_PASSES, _NORMALIZE_NEEDS, strict=True)
            for (p, _), needs in zip(rules, own, strict=True) if needs}


def normalize_text(df: DataFrame, src: str, out: str = "normalizedText") -> DataFrame:
    """Spaced initials, four gated regex passes, NFKC + strip."""
    return df.withColumn(out, passes(collapse_spaced_initials(src), R.NORMALIZE_PASSES, _normalize_prefilters()))


# -- X7-X9, X13: dictionary replacement --------------------------------------

_PREFIX = R.SEARCH_PREFIX
_SUFFIX = R.SEARCH_SUFFIX


def _bounded(p: str, first: str = "") -> str:
    """``first``: the characters with which ``p`` begins (any case if the pattern is
    so), looked at before the bound: most places of a text fail at one comparison."""
    return f"{f'(?=[{first}])' if first else ''}{_PREFIX}{p}{_SUFFIX}"


def _collapse(c: Column) -> Column:
    return F.regexp_replace(c, "  +", " ")


def _literal_braces(escaped: Column) -> Column:
    """Braces of a search string for a Java pattern (Python takes them literally)."""
    return F.regexp_replace(escaped, r"([{}])", r"\\$1")


def _apply_entry(acc: Column, e: Column) -> Column:
    """Replace one dictionary entry in ``acc`` (quotes, parentheses for people,
    then the bounded form; case-sensitive iff the escaped search has no blank)."""
    esc = _literal_braces(e["strSearchEscaped"])
    repl = F.regexp_replace(e["strReplace"], r"([\\$])", r"\\$1")
    quoted = F.regexp_replace(acc, F.concat(F.lit("(?iu)['\"]"), esc, F.lit("['\"]")), repl)
    paren_pat = F.when(e["category"] == "PERSON", F.concat(F.lit("(?iu)\\( ?"), esc, F.lit(" ?\\)"))) \
        .otherwise(F.lit("(?!)"))
    no_paren = F.regexp_replace(quoted, paren_pat, F.lit(""))
    flags = F.when(esc.contains(" "), F.lit("(?iu)")).otherwise(F.lit("(?u)"))
    bounded = F.regexp_replace(no_paren, F.concat(flags, F.lit(_PREFIX), esc, F.lit(_SUFFIX)), repl)
    return _collapse(bounded)


def _step(acc: Column, e: Column) -> Column:
    """One entry; a search string that does not occur (in any case) cannot match its patterns."""
    return F.when(F.lower(acc).contains(F.lower(e["strSearch"])), _apply_entry(acc, e)).otherwise(acc)


def replace_with_dictionary(text: Column, entries: Column, lead: Column | None = None) -> Column:
    """Fold the title's dictionary (longest first) over the review text.

    Entries flagged ``conflicts`` or ``ambiguous`` are skipped. Blanks are
    collapsed after every entry, also one that does not occur, so all but the
    title's first usable entry see a collapsed text; ``lead`` says whether the
    first one here is that entry (default: yes).
    """
    usable = F.filter(entries, lambda e: ~(e["conflicts"] | e["ambiguous"]))
    lead = (F.lit(True) if lead is None else lead) & (F.size(usable) > 0)
    start = _collapse(F.when(lead, _step(text, F.get(usable, F.lit(0)))).otherwise(text))
    rest = F.when(lead, F.slice(usable, F.lit(2), F.greatest(F.size(usable), F.lit(1)))).otherwise(usable)
    return F.aggregate(rest, start, _step)


#: Characters that may stand before or after a search string in a text: the
#: entries' words and a text's words are what lies between them.
_BOUNDS = r""" \t\n\r\f\x0B('"/.,;!?)"""
_WORD_RUN = f"[^{_BOUNDS}]+"
#: Taking out bracketed names here joins the words on both sides to a new one.
_JOINING = rf"[^{_BOUNDS}](?:\([^()]*\))+[^{_BOUNDS}]"
#: Keys that are no words: entries that any text may hold, and what is known of a title.
_FREE, _FACTS = "", "\u0001"


def word_runs(c) -> Column:
    """The distinct lower-case words between possible bounds of a search string."""
    folded = F.replace(F.lower(col_(c)), F.lit("\u03c2"), F.lit("\u03c3"))  # a final sigma depends on its neighbours
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(_WORD_RUN), 0))


def keyed_entries(entries: DataFrame) -> DataFrame:
    """Dictionary rows (title_id, entry) with the word a text must hold for the
    entry to be able to match (``token``).

    A search string stands between bounds, so each of its words is a word of
    the text at that time: one of the review's, or one that an earlier
    replacement has brought. So the key is the longest word that no
    replacement of the title can bring; words that begin or end with a word of
    a replacement are no keys either, as a quoted name inside a word leaves its
    replacement glued to the rest. Entries without such a word get the key of
    all texts.
    """
    says = F.collect_set("says").over(W.partitionBy("title_id"))
    own = entries.withColumn("says", word_runs("entry.strReplace")).withColumn("brought", F.array_distinct(F.flatten(says)))
    own = own.withColumn("runs", F.filter(word_runs("entry.strSearch"), lambda t: ~F.exists(
        "brought", lambda w: t.startswith(w) | t.endswith(w))))
    longest = F.array_max(F.transform("runs", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return own.select("title_id", "entry", F.coalesce(longest, F.lit(_FREE)).alias("token"))


@dataclass(frozen=True)
class KeyedDictionary:
    """Stored tables: the entries of some titles by (title_id, token), with their
    titles' facts under a token of their own, and the distinct tokens."""

    rows: DataFrame
    tokens: DataFrame

    @property
    def facts(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("title_id", "entry", "token")]


def keyed_dictionary(entries: DataFrame, titles: DataFrame, facts: DataFrame | None = None) -> KeyedDictionary:
    """The ``entries`` (title_id, entry) and ``facts`` (columns beside title_id) of
    ``titles`` (title_id, distinct), keyed and written once for all texts that meet them."""
    rows = keyed_entries(entries.join(titles, "title_id", "left_semi"))
    if facts is not None:
        rows = rows.unionByName(facts.join(titles, "title_id", "left_semi").withColumn("token", F.lit(_FACTS)),
                                allowMissingColumns=True)
    rows = stage_table(rows)
    return KeyedDictionary(rows, stage_table(rows.select("token").distinct()))


def titles_of(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("title_id").isNotNull()).select("title_id").distinct()


def occurring_entries(texts: DataFrame, entries: DataFrame, text: str, facts: DataFrame | None = None,
                      out: str = "entries") -> DataFrame:
    """:func:`meet_dictionary` with the ``entries`` and ``facts`` of the texts' titles.
    Titles without texts take no part."""
    return meet_dictionary(texts, keyed_dictionary(entries, titles_of(texts), facts), text, out)


def meet_dictionary(texts: DataFrame, dictionary: KeyedDictionary, text: str, out: str = "entries") -> DataFrame:
    """Texts (id, title_id, ...) with the entries of their title that can occur in
    them, in the dictionary's order, and the title's facts.  The join is on
    (title, word): a hot title's texts are spread over their words, and a text
    only ever carries what it holds; words that are no entry's key are dropped
    before it, where they were read.  The few texts in which a bracket that is
    taken out joins two words get all entries of their title."""
    titled = texts.where(F.col("title_id").isNotNull())
    joining = col_(text).contains("(") & col_(text).rlike(_JOINING)
    words = titled.where(~joining).select("id", "title_id", F.explode(word_runs(text)).alias("token")) \
        .join(dictionary.tokens, "token", "left_semi").select("id", "title_id", "token")
    always = F.when(joining, F.array(F.lit(_FACTS))).when(~joining, F.array(F.lit(_FREE), F.lit(_FACTS)))
    words = words.unionByName(titled.select("id", "title_id", F.explode(always).alias("token")))
    met = words.join(dictionary.rows, ["title_id", "token"]).select("id", "entry", *dictionary.facts)
    every = titled.where(joining).select("id", "title_id") \
        .join(dictionary.rows.where(F.col("token") != _FACTS).select("title_id", "entry"), "title_id").select("id", "entry")
    found = met.unionByName(every, allowMissingColumns=True).groupBy("id").agg(
        F.sort_array(F.collect_list("entry")).alias(out), *[F.max(c).alias(c) for c in dictionary.facts])
    empty = F.array().cast(found.schema[out].dataType)
    # the stages after this are heavy on the CPU: texts are dealt out by the key of the join
    return spread(texts, "id").join(found, "id", "left").withColumn(out, F.coalesce(out, empty))


def replace_occurring(df: DataFrame, text: str, out: str) -> DataFrame:
    """X7-X9 on texts with the entries that occur in them and their title's
    facts: ``usable`` (any entry that is not skipped), ``first`` (the first of
    them) and ``known`` (abbreviations that are words of its search strings)."""
    lead = F.coalesce(F.get("entries", F.lit(0)).eqNullSafe(F.col("first")), F.lit(False))
    d = df.withColumn("lead", lead)
    d = d.withColumn(out, F.when(F.coalesce("usable", F.lit(False)),
                                 replace_with_dictionary(F.col(text), F.col("entries"), F.col("lead"))).otherwise(F.col(text)))
    return _repetitions_and_abbreviations(d, out, "known", F.col("title_id").isNotNull())


def replace_metadata(df: DataFrame, text: str, entries: str, words: str, out: str | None = None,
                     titled: Column | None = None) -> DataFrame:
    """X7-X9 over a DataFrame carrying the title dictionary as an array column.

    ``words`` is the array of upper-cased words of all search strings of the
    title (including skipped entries); an abbreviation is only rewritten when
    it is not one of them (X9). The repetition and abbreviation rules run for
    every review that has a title (``titled``; default: a non-null
    ``title_id``), also when the title's dictionary is empty.
    """
    out = out or text
    if titled is None:
        titled = F.col("title_id").isNotNull() if "title_id" in df.columns else F.size(F.col(entries)) > 0
    d = df.withColumn(out, F.when(F.size(F.col(entries)) > 0,
                                  replace_with_dictionary(F.col(text), F.col(entries)))
                      .otherwise(F.col(text)))
    return _repetitions_and_abbreviations(d, out, words, titled)


#: Characters that match an ASCII letter in any case without having it as their lower case.
_ODD_CASE = "[\u017f\u212a\u0130\u0131]"
#: Per rule of REPETITIONS_1 what every match holds in lower case, one of them at least.
REPETITION_1_WORDS = (
    ("this movie",), (" movie ",), ("director ",), ("composer ",), ("editor ",), ("character ",), ("actress ",),
    ("writer ",), ("actor ",), ("(played by the actress)",), ("(played by the actor)",),
    tuple(f"{t} the " for t in ("captain", "doctor", "dr", "mister", "mr", "lady", "ms")),
    ("this this",), ("this the",), ("the this",), ("the the",))
#: The first characters of each rule of REPETITIONS_1.
_REPETITION_1_FIRST = ("d", "ta", "d", "c", "e", "c", "a", "w", "a", "(", "(", "cdml", "t", "t", "t", "t")


def _repetitions_and_abbreviations(d: DataFrame, out: str, known: str, has_dict: Column) -> DataFrame:
    # Repetitions, ungated, case-insensitive, inside the word bounds; blanks collapsed after each.
    # A rule is skipped on texts without a literal that all its matches hold.
    d = d.withColumn("__odd", F.col(out).rlike(_ODD_CASE)).withColumn("__raw", F.col(out))

    def holds(words) -> Column:
        return reduce(or_, [F.col("__low").contains(w) for w in words], F.col("__odd"))

    # the text in lower case is taken again where a rule was applied, not once a rule
    d = d.withColumn("__low", F.lower(F.col(out)))
    for i, ((p, r), words, first) in enumerate(zip(R.REPETITIONS_1, REPETITION_1_WORDS, _REPETITION_1_FIRST, strict=True)):
        c = F.col(out)
        new = replace(c, _bounded(p, first), r, ignore_case=True)
        if i == 0:  # the texts are collapsed from here on
            d = d.withColumn(out, _collapse(F.when(holds(words), new).otherwise(c))).withColumn("__low", F.lower(F.col(out)))
        else:
            d = d.withColumn("__hit", holds(words)).withColumn(out, F.when(F.col("__hit"), _collapse(new)).otherwise(c)) \
                .withColumn("__low", F.when(F.col("__hit"), F.lower(F.col(out))).otherwise(F.col("__low")))
    d = d.withColumn(out, F.when(has_dict, F.col(out)).otherwise(F.col("__raw")))
    # Abbreviations unless part of a title or name; one projection each.
    for abb, r in R.ABBREVIATIONS:
        cur = F.col(out)
        step = replace(cur, f"['\"]{abb}['\"]", r, ignore_case=True)
        step = replace(step, f"\\( ?{abb} ?\\)", "", ignore_case=True)
        step = _collapse(replace(step, _bounded(abb), r, ignore_case=True))
        cond = has_dict & ~F.coalesce(F.array_contains(F.col(known), abb), F.lit(False))
        d = d.withColumn("__hit", cond & holds([abb.lower()])).withColumn(out, F.when(F.col("__hit"), step).otherwise(cur)) \
            .withColumn("__low", F.when(F.col("__hit"), F.lower(F.col(out))).otherwise(F.col("__low")))
    return d.drop("__odd", "__raw", "__low", "__hit")


def conflict_entries(entries) -> Column:
    """The first entry of every search string that conflicts or is
    ambiguous; a string whose first entry is ambiguous is left out."""
    doubtful = F.filter(col_(entries), lambda e: e["conflicts"] | e["ambiguous"])
    names = F.transform(doubtful, lambda e: e["strSearch"])
    first = F.filter(doubtful, lambda e, i: F.array_position(names, e["strSearch"]) == i + 1)
    return F.filter(first, lambda e: ~e["ambiguous"])


def resolve_conflicts(sentences, entries) -> Column:
    """X13 on a title's whole dictionary: :func:`resolve_wanted` with its :func:`conflict_entries`."""
    return resolve_wanted(sentences, conflict_entries(entries))


def resolve_wanted(sentences, wanted) -> Column:
    """X13 per sentence, as the fallback without entity types: a search string
    that occurs (in any case if it holds a blank) is replaced by its phrase; a
    sentence that changed loses the quotes around the title phrase and gets
    the X8 rules. ``wanted`` are the entries to be tried, in order."""
    wanted = col_(wanted)

    def step(acc: Column, e: Column) -> Column:
        blank = e["strSearch"].contains(" ")
        there = F.when(blank, F.lower(acc).contains(F.lower(e["strSearch"]))).otherwise(acc.contains(e["strSearch"]))
        pattern = F.concat(F.when(blank, F.lit("(?iu)")).otherwise(F.lit("(?u)")), F.lit(_PREFIX),
                           _literal_braces(e["strSearchEscaped"]), F.lit(_SUFFIX))
        phrase = F.regexp_replace(e["strReplace"], r"([\\$])", r"\\$1")
        return F.when(there, F.regexp_replace(acc, pattern, phrase)).otherwise(acc)

    def tidy(x: Column) -> Column:
        c = F.regexp_replace(x, "['\"]this movie['\"]", "this movie")
        for p, r in R.REPETITIONS_1:
            c = replace(c, _bounded(p), r, ignore_case=True)
        return _collapse(c)

    def one(sentence: Column) -> Column:
        new = F.aggregate(wanted, sentence, step)
        return F.when(new == sentence, sentence).otherwise(tidy(new))

    return F.when(F.size(wanted) == 0, col_(sentences)).otherwise(F.transform(col_(sentences), one))


# -- X10-X11: sentences ----------------------------------------------------------

def split_sentences(c) -> Column:
    """X10 (rule form): break after . ! ? followed by white space and a capital;
    blanks inside a sentence are collapsed and empty pieces dropped."""
    marked = F.regexp_replace(col_(c), r"([.!?])\s+([A-Z])", f"$1{SEP}$2")
    pieces = F.transform(F.split(marked, SEP), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(pieces, lambda s: s != "")


_LIST_NUMBER = r"(?<! is)(?<! the)(?<! of)(?<! Volume) (\d)\. "


def _none_sentences() -> Column:
    return F.array(*[F.lit(s) for s in R.NONE_SENTENCES])


def _glue(out: Column, pieces: Column) -> Column:
    """Append list pieces: capitalised or first -> new sentence, else glued to
    the previous one with ', ' (or ' ' after punctuation)."""
    nonempty = F.filter(pieces, lambda s: s != "")

    def add(acc, s):
        last = at(acc, -1)
        sep = F.when(F.substring(last, -1, 1).isin(".", ",", ":", ";", "!", "?"), F.lit(" ")).otherwise(F.lit(", "))
        glued = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, sep, s)))
        return F.when((F.size(acc) == 0) | s.rlike("^[A-Z]"), F.concat(acc, F.array(s))).otherwise(glued)

    return F.aggregate(nonempty, out, add)


def repair_sentences(c) -> Column:
    """X11: clean the raw split (noise pieces, list numbers, inline lists,
    stray punctuation, one-word pieces, over-long pieces, open parentheses).

    One ``aggregate`` over the pieces with state (sentences, open_paren);
    branches in the order of the original.
    """
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("out"), F.lit(False).alias("open"))
    maxlen = config.SENTENCE_MAXLENGTH

    def looked_at(raw):
        """What decides on a piece and does not depend on those before it, each looked at once."""
        s = F.regexp_replace(raw, r"^(\d){1,2}[\.\)]+ ", "")
        skip = F.array_contains(_none_sentences(), raw) | raw.rlike(r"^#?(\d){1,2}[\.\)]+$")
        return _once(s, lambda s: F.struct(
            s.alias("s"), skip.alias("skip"),
            (s.contains(". ") & s.rlike(java_pattern(_LIST_NUMBER))).alias("numbered"),
            (s.contains(") ") & s.rlike(r" \d\) ") & ~s.rlike(r"\(.* \d\) ")).alias("paren_list"),
            (s.startswith("'s ") | s.rlike(r"^['\"]?[\.,:;!\?\)]")).alias("punct"),
            ((~s.contains(" ")) & s.rlike(r"\p{L}")).alias("one_word"),
            (F.length(s) > maxlen).alias("too_long")))

    def add(st, f):
        out, op, s = st["out"], st["open"], f["s"]
        has = F.size(out) > 0
        numbered, one_word, too_long = f["numbered"], f["one_word"], f["too_long"]
        paren_list, punct = (~op) & f["paren_list"], has & f["punct"]
        num_parts = F.split(F.regexp_replace(s, java_pattern(_LIST_NUMBER), f"{SEP}$1{SEP}"), SEP)
        paren_parts = F.split(s, r" \d\) ")
        last = at(out, -1)
        init_out = F.slice(out, 1, F.size(out) - 1)
        long_parts = F.transform(F.split(s, r"[\.;](?=[ a-dfh-zA-Z])"), lambda p: F.concat(F.trim(p), F.lit(".")))
        # sentence text used by the trailing parenthesis test (the last list piece for list branches)
        tail = (F.when(numbered, at(num_parts, -1))
                .when(paren_list, at(paren_parts, -1)).otherwise(s))
        new_out = (F.when(numbered, _glue(out, num_parts))
                   .when(paren_list, _glue(out, paren_parts))
                   .when(punct, F.concat(init_out, F.array(F.concat(last, s))))
                   .when(one_word & has, F.concat(init_out, F.array(F.concat(last, F.lit(" "), s))))
                   .when(one_word, F.array(s))
                   .when(too_long, F.concat(out, long_parts))
                   .when(op & has, F.concat(init_out, F.array(F.concat(last, F.lit(" "), s))))
                   .otherwise(F.concat(out, F.array(s))))
        new_open = (F.when(numbered, F.lit(False)).when(paren_list, op).when(punct, F.lit(False))
                    .when(one_word & has, F.lit(False)).when(one_word, F.lit(True))
                    .when(too_long, F.lit(False)).when(op & has, F.lit(False)).otherwise(op))
        # one-word review start skips the parenthesis test
        paren_open = tail.contains("(") & ~tail.contains(")") & ~(one_word & ~has & ~numbered & ~paren_list & ~punct)
        new_open = new_open | paren_open
        return F.struct(new_out.alias("out"), new_open.alias("open"))

    # the pieces are looked at before the fold: its state, all sentences so far, is never copied
    pieces = F.transform(col_(c), looked_at)
    return F.aggregate(pieces, init, lambda st, f: F.when(f["skip"], st).otherwise(add(st, f)), lambda st: st["out"])


# -- X12, X14, X15 ---------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"


def tokens(c) -> Column:
    """X12 (rule form): tokens with their trailing-blank flag, as array<struct<word, ws>>."""
    words = F.regexp_extract_all(col_(c), F.lit(f"({TOKEN})( ?)"), 1)
    blanks = F.regexp_extract_all(col_(c), F.lit(f"({TOKEN})( ?)"), 2)
    return F.arrays_zip(words.alias("word"), blanks.alias("ws"))


# Words at least one of which every REPETITIONS_2 rule requires (derived from the rules).
REPETITION_2_WORDS = ("another", "director", "writer", "act", "10 ", "the character", "other persons",
                      "other features", "the the")


def sentence_from_tokens(toks) -> Column:
    """Join tokens (word + blank, empty words dropped), collapse blanks,
    repetition clean-up (REPETITIONS_2, case-insensitive, bounded)."""
    joined = F.array_join(F.transform(col_(toks), lambda t: F.when(t["word"] != "", F.concat(t["word"], t["ws"]))), "")

    def cleaned(s: Column) -> Column:
        chain = s
        for p, r in R.REPETITIONS_2:
            chain = _collapse(replace(chain, _bounded(p), r, ignore_case=True))
        # every rule needs one of these words (any case); other sentences only get the blank collapse
        # the last of them is the word of one rule alone, and what it leaves begins no other
        *most, twice = REPETITION_2_WORDS
        only = _collapse(replace(s, _bounded(twice, twice[0]), dict(R.REPETITIONS_2)[twice], ignore_case=True))
        gate = _once(F.replace(F.replace(F.lower(s), F.lit("\u017f"), F.lit("s")), F.lit("\u212a"), F.lit("k")),
                     lambda folded: F.when(reduce(or_, [folded.contains(w) for w in most]), 2)
                     .when(folded.contains(twice), F.when(s.rlike(_ODD_CASE), 2).otherwise(1)).otherwise(0))
        return _once(gate, lambda g: F.when(g == 0, s).when(g == 1, only).otherwise(chain))

    return _once(_collapse(joined), cleaned)


def keep_sentence(c) -> Column:
    """Drop the empty / noise sentences."""
    return ~col_(c).isin(*R.EMPTY_SENTENCES)


def sentence_case(c) -> Column:
    """Upper-case the first character."""
    x = col_(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def add_aspect_term(c) -> Column:
    """A sentence that is a rating phrase gets the prefix 'Overall: '."""
    x = col_(c)
    is_rating = x.rlike("(?iu)^(?:" + R.RATING_PHRASE + r")\z")
    stripped = F.regexp_replace(F.regexp_replace(x, "(?iu)" + R.RATING_PREFIX, ""), "(?iu)stars", "")
    return F.when(is_rating, F.concat(F.lit("Overall: "), stripped)).otherwise(x)


# -- P17, W5: ids and sentence parts ---------------------------------------------

def number_sentences(parts: DataFrame, start: int = 1, sentences: str = "parts") -> DataFrame:
    """One row per sentence of rows (review_id, ..., array of sentences),
    with its position and a dense id in (review_id, pos) order from ``start``.

    The number of sentences per review -> skew-safe prefix sum over review
    ids -> offsets joined to the reviews before their sentences are exploded."""
    counts = parts.select("review_id", F.size(sentences).cast("long").alias("n"))
    offs = grouped_prefix_sum(counts, [], "review_id", "n", "off", inclusive=False).select("review_id", "off")
    rest = [c for c in parts.columns if c not in ("review_id", sentences)]
    rows = parts.join(offs, "review_id").select("review_id", *rest, "off", F.posexplode(sentences).alias("pos", "sentence"))
    return rows.withColumn("id", (F.lit(start) + F.col("off") + F.col("pos")).cast("long")).drop("off")


def sentence_parts(words: DataFrame, batch: str = "title_id") -> DataFrame:
    """Running count of ',' ':' ';' words over the batch ordered by
    (sentence_id, pos) — never reset per sentence (trap H16)."""
    w = words.withColumn("__sep", _separator())
    return grouped_prefix_sum(w, [batch], "sentence_id", "__sep", "sentencePart", tie=["pos"]).drop("__sep")


def _separator() -> Column:
    return F.col("word").isin(*R.PART_SEPARATORS).cast("long")


def sentence_words(sentences: DataFrame, batch: str = "title_id") -> DataFrame:
    """The tokens of sentences (sentence_id, ``batch``, sentence) with
    their position, blank and part.  Each separator is a token of its own, so what
    stands before a sentence in its batch is a prefix sum over sentences; words are
    made once, where their sentence lies, and are never moved."""
    separators = F.coalesce(F.regexp_count("sentence", F.lit(f"[{''.join(R.PART_SEPARATORS)}]")), F.lit(0)).cast("long")
    counts = sentences.groupBy(batch, "sentence_id").agg(F.sum(separators).alias("__n"))
    before = grouped_prefix_sum(counts, [batch], "sentence_id", "__n", "__before", inclusive=False) \
        .select(batch, "sentence_id", "__before")
    d = spread(sentences.select("sentence_id", batch, "sentence"), "sentence_id").join(before, [batch, "sentence_id"])
    d = d.select("sentence_id", batch, "__before", F.posexplode(tokens("sentence")).alias("pos", "t"))
    d = d.select("sentence_id", batch, "__before", "pos", "t.word", "t.ws")
    own = F.sum(_separator()).over(W.partitionBy("sentence_id", batch).orderBy("pos")
                                   .rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn("sentencePart", (F.col("__before") + own).cast("long")).drop("__before")
