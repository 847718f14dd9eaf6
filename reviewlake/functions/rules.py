"""Text rules as data.

Every table in this module holds FIXED VALUES that must equal the original
pipeline's for equal results: regular expressions and their replacements,
written in Python ``re`` syntax exactly as the original states them, in their
original order. :mod:`reviewlake.functions.regex` converts them to Java regex
syntax (``\\1`` -> ``$1``, Unicode classes) when building Spark expressions.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (patterns, replacements, word lists) — natural order, unchanged.
# ---------------------------------------------------------------------------

# Emoji ranges (pass 1 replaces runs by '. ').
EMOJI = ("[\U0001F1E0-\U0001F1FF\U0001F300-\U0001F5FF\U0001F600-\U0001F64F\U0001F680-\U0001F6FF"
         "\U0001F700-\U0001F77F\U0001F780-\U0001F7FF\U0001F800-\U0001F8FF\U0001F900-\U0001F9FF"
         "\U0001FA00-\U0001FA6F\U0001FA70-\U0001FAFF\U00002700-\U000027BF\U00002300-\U000023FF]+")

# Word bounds of dictionary replacement.
SEARCH_PREFIX = r"""((?<=^)|(?<=[ \('"/]))"""
SEARCH_SUFFIX = r"""(?=[\.,;!\?\) '"/]|$)"""

# Abbreviations replaced unless they are part of a title or name.
ABBREVIATIONS = (("OG", "original"), ("OMG", ""), ("LOL", ""))

# Pass 0: spaced initials "A. B. C." lose their blanks.
SPACED_INITIALS = r'(([A-Z]\. )([A-Z]\. )+([A-Z]\.))'

# Pass 1 (gated).
NORMALIZE_PASS_1 = (
    (r'(https?://|www\.).*?(?=$|[\s\)\'"])', 'website'),
    (r'([\s\(\'"])[^\s\(\'"]+\.(com|net|html?)(?=$|[\s\)\'"])', r'\1website'),
    (r'(^|[\s\(])[#@][^\d\'" ].*?(?=$|[\s\)])', r'\1'),
    (r'([^\.,:;!\?]) ?\n ?([A-Z])', r'\1. \2'),
    (r'([^\.,:;!\?]) ?\n ?[>-]+', r'\1. '),
    (r'([\.,:;!\?]) ?\n ?[>-]+', r'\1 '),
    (r'([^\.,:;!\?]) ?\n ?[\d]{1,2}[\.\)]+(?!\d)', r'\1. '),
    (r'([\.,:;!\?]) ?\n ?[\d]{1,2}[\.\)]+(?!\d)', r'\1 '),
    (r'^\.\.\.', ''),
    (r'\\', '/'),
    (r'==+', ' '),
    (r'-{4,}', ' '),
    (r'\+{4,}', ' '),
    (r'\*{6,}', ' '),
    (r'\?[\?\.]+', '?'),
    (r'![!\.]+', '!'),
    (r',,+', ','),
    (r' ?\.( ?\. ?)+\.', '...'),
    (EMOJI, '. '),
    (r' ?[:;] ?[\)\|]+', '. '),
    (r' ?:[\(]+(?=$|[\s\.])', '. '),
    (r' \^[-_]?\^ ?', '. '),
    (r':?=\)', ''),
    (r'(<\)|<3)', ''),
    (r'\*(sigh|cough|yawn|rolls eyes)\*', ' '),
    (r'[Ff][*#@Uu-][*#@Cc-][*#@Kk]', 'f*ck'),
    (r'[Cc][Rr]@[Pp]', 'cr*p'),
    (r'[Bb]@[Ll][Ll][Ss]', 'balls'),
    (r'[Ss][Hh]@[Tt]', 'sh*t'),
    (r'[”¨“]', '"'),
    (r"(’|´|''|`|‘)", "'"),
    (r'[★☆⭐]', '*'),
    (r' @ ', ' at '),
    (r'\(=', '('),
)

# Pass 2 (gated).
NORMALIZE_PASS_2 = (
    (r'[_¡~\{\}><°♥﻿￼]', ' '),
    (r'\n\(?website\)?$', ''),
    (r'(^|[\s\(\'"])[a-zA-Z][a-zA-Z0-9]*@[a-zA-Z0-9]*(?=$|[\s\)\'"])', r'\1website'),
    (r'(^|\s)[*\']([^\s\*]+?)[*\']($|[\.,:;\s!\?])', r'\1\2\3'),
    (r'[\r\n\t\f\v]', ' '),
    (r'\( ?\d{4}[\!\? ]?\)', ''),
    (r'\(R\.I\.P\.\)', ''),
    (r'[Tt][Ll];?[Dd][Rr](:| - )?', 'In summary, '),
    (r'([a-zA-Z])\(([a-zA-Z])\)', r'\1\2'),
    (r'\(([d-zD-Z])\)([a-zA-Z])', r'\1\2'),
    (r'\(([a-zA-Z]{2})\)([a-zA-Z])', r'\1\2'),
)

# Pass 3 (gated).
NORMALIZE_PASS_3 = (
    (r'website website', 'website'),
    (r',([a-zA-Z])', r', \1'),
    (r'([a-z])\.([A-Z])', r'\1. \2'),
    (r'\.\.\.([^ \)\'"])', r'... \1'),
    (r';([^ ])', r'; \1'),
    (r'([!\?])([^!\?\)\'" ])', r'\1 \2'),
    (r'([^ ])(\()', r'\1 \2'),
    (r'(\)[,:;\.]?)([^ ,:;\.])', r'\1 \2'),
    (r'(\D:)([^ ])', r'\1 \2'),
    (r'([eE]\.g\.|[iI]\.e\.)[ :]', r'\1, '),
    (r'(etc\.) ([a-z])', r'\1, \2'),
    (r' ?--+ ?', ', '),
    (r' Im ', " I'm "),
    (r' isnt ', " isn't "),
    (r' arnt ', " are not "),
    (r' didnt ', " didn't "),
    (r' back ground ', ' background '),
    (r'[Mm]ake-[Uu]p', 'makeup'),
    (r'[Ss]low-[Mm]o(tion)?', 'slow motion'),
    (r'[Ss](cript|creen)( -)?[Ww]riter', 'writer'),
    (r'master piece', 'masterpiece'),
    (r' alround ', ' all-round '),
    (r'[Cc]a?pt\.', 'Captain'),
    (r'Dr\.', 'Doctor'),
    (r'Mr\.', 'Mister'),
    (r'Mr?s\.', 'Lady'),
    (r'[Cc]\.[Gg]\.[Ii]\.?', 'CGI'),
    (r'([ \(\'":])[Vv]ol\. ?', r'\1Volume '),
    (r'R\.I\.P\.(?!D\.)', 'farewell,'),
    (r'[\., ]+b/c ', ', because '),
    (r'( |\()w/ ', r'\1with '),
    (r'( |\()w/o ', r'\1without '),
    (r' [Vv]/?[Ss]\.? ', ' versus '),
    (r'[Cc]ontd\.', 'continued'),
    (r' [Nn][or]\. (?=\d)', ' number '),
    (r'appr\.', 'approximately'),
    (r'( |\()pp\.', r'\1pages'),
)

# Pass 4 (gated).
NORMALIZE_PASS_4 = (
    (r' -(?=[^ \d])', ' '),
    (r'(?<=[^ A-F])-( |$)', ' '),
    (r'\.?\.\. +([A-Z])', r'. \1'),
    (r'\. (\. )+', '. '),
    (r' , ', ', '),
    (r'  +', ' '),
)

NORMALIZE_PASSES = (NORMALIZE_PASS_1, NORMALIZE_PASS_2, NORMALIZE_PASS_3, NORMALIZE_PASS_4)

# Rewrites of dictionary search strings, to match normalised text (one gated pass).
METADATA_REWRITES = (
    (r'([a-z])\.([A-Z])', r'\1. \2'),
    (r'[Mm]ake-[Uu]p', 'makeup'),
    (r'[Cc]a?pt\.', 'Captain'),
    (r'Dr\.', 'Doctor'),
    (r'Mr\.', 'Mister'),
    (r'Mr?s\.', 'Lady'),
    (r'([ \(\'":])[Vv]ol\. ?', r'\1Volume '),
    (r' [Vv]/?[Ss]\.? ', ' versus '),
    (r'[Nn][Oor]\.', 'number'),
    (r'([a-zA-Z])\(([a-zA-Z])\)', r'\1\2'),
    (r'\(([d-zD-Z])\)([a-zA-Z])', r'\1\2'),
    (r'\(([a-zA-Z]{2})\)([a-zA-Z])', r'\1\2'),
)

# Word combinations removed or reduced after dictionary replacement
# (applied in order, case-insensitive, inside the word bounds above).
REPETITIONS_1 = (
    (r'director(\'s)? this movie', 'this movie'),
    (r'(the|a|this) movie (the |this )?movie', 'this movie'),
    (r'director (the )?director', 'the director'),
    (r'composer (the )?composer', 'composer'),
    (r'editor (the )?editor', 'editor'),
    (r'character (the )?character', 'character'),
    (r'actress (the )?actress', 'actress'),
    (r'writer (the )?writer', 'writer'),
    (r'actor (the )?actor', 'actor'),
    (r'\(played by the actress\)', ''),
    (r'\(played by the actor\)', ''),
    (r'(Captain|Doctor|Dr|Mister|Mr|Lady|Ms) the (director|editor|writer|composer|character|actor|actress)', r'the \3'),
    ('this this', 'this'),
    ('this the', 'this'),
    ('the this', 'this'),
    ('the the', 'the'),
)

# Word combinations removed after joining tokens back to sentences.
REPETITIONS_2 = (
    ('anotherperson', 'another person'),
    ('anotherfeature', 'another feature'),
    ('another another', 'another'),
    ('another feature-?another feature', 'another feature'),
    ('another person(\'s |-)?another person', 'another person'),
    (r'(Captain|Doctor|Dr|Mister|Mr|Lady|Ms) another (feature|person)', r'another \3'),
    (r'[\'\"]another (feature|person)[\'\"]', 'another feature'),
    (r'another person(\'s)? (another feature|movie|film)', 'another feature'),
    (r'(director )?another person the director', 'the director'),
    (r'(writer )?another person the writer', 'the writer'),
    (r'the director\'s? direction', 'the direction'),
    (r'the writer\'s? writing', 'the writing'),
    (r'the (actor|actress)\'s? acting', 'the acting'),
    (r'another person ((the )?(character|actress|actor))', r'\2'),
    (r'character another person', 'character'),
    (r'another person character', 'character'),
    (r'(?<!was )(?<!is )(?<!calls )(?<!called )(?<!calling )this movie another feature', 'another feature'),
    (r'\((from )?another feature ?\)', ''),
    (r'\((by)? ?another person ?\)', ''),
    (r'10 (another person|website)', '10'),
    (r'(another person)((, |, and | and )(another person))+', 'other persons'),
    (r'(the actor|the actress|another person|other persons)((, |, and | and )(the actor|the actress|another person|other persons)){2,}', 'the actors'),
    (r'(the character|another person|other persons)((, |, and | and )(the character|another person|other persons))+', 'the characters'),
    (r'("?another feature"?)((, |, and | and )("?another feature"?))+', 'other features'),
    (r'(another feature|other features) (films|movies|features)', 'other features'),
    ('the the', 'the'),
    (r'(the|a|an) another', 'another'),
)

# Sentences dropped after joining tokens back.
EMPTY_SENTENCES = ('', '.', '(', 'another person')

# Split "sentences" that are ignored.
NONE_SENTENCES = ('.', '/.', ' .', '..', '...', '!', '?', '?!', '(!)', '(?)', '*', '**', '***',
                  'website', 'website.')

# Rating phrases that get the aspect prefix "Overall: " (full match, any case).
RATING_PHRASE = (r'[\(\[]?((my )?(final )?(rating ?(: ?|- |is )?))?((\d[\d\.,]{0,2}\+?)|([\*]+))'
                 r'(/| out of )(5\*?|10\*?|100|([\*]+))[\)\]]? ?(stars|for me|from me)?[\.!]?')
RATING_PREFIX = r'((my )?(final )?(rating ?(: ?|- |is )?))'

# Escaping applied to dictionary search strings before they enter a pattern.
ESCAPE_CHARS = r'([\]\[\(\)\?\*\+\.\$])'

# Punctuation words that start a new sentence part.
PART_SEPARATORS = (',', ':', ';')

# Name parsing cascade: (selection test, extraction pattern, group names).
# A rule takes the names its test selects (prefix match; or an exact blank
# count) that no earlier rule accepted.
NAME_RULES = (
    (("match", r".* '.*' .*"), r"(?P<firstName>.+) '(?P<aliasName>.+)' (?P<lastName>.+)",
     ("firstName", "aliasName", "lastName")),
    (("match", r".+ ([dD][eai] |[dD]el |[vV][ao]n )"), r"(?P<firstName>.+) (?P<lastName>([dD][eai] |[dD]el |[vV][ao]n ).*)",
     ("firstName", "lastName")),
    (("match", r".* .* .*\."), r"(?P<firstName>.+) (?P<lastName>.+ .+\.)", ("firstName", "lastName")),
    (("blanks", 2), r"(?P<firstName>.+) (?P<middleName>.+) (?P<lastName>.+)", ("firstName", "middleName", "lastName")),
    (("blanks", 1), r"(?P<firstName>.+) (?P<lastName>.+)", ("firstName", "lastName")),
)
