"""Rules skipped on texts that cannot match, expressions computed once per element."""

import random

from pyspark.sql import functions as F

from reviewlake.functions import rules as R
from reviewlake.functions.regex import replace
from reviewlake.operators import text as tx


def plan_of(spark, f) -> str:
    d = spark.createDataFrame([(["a b."],)], "s array<string>").select(f("s").alias("o"))
    return d._jdf.queryExecution().analyzed().toString()


def test_tokens_are_taken_once_per_sentence(spark):
    plan = plan_of(spark, lambda s: F.transform(s, lambda x: tx.sentence_from_tokens(tx.tokens(x))))
    assert plan.count("regexp_extract_all") == 2  # words and blanks


def test_pieces_are_tested_once(spark):
    plan = plan_of(spark, tx.repair_sentences)
    assert plan.count(r"(?<! Volume)") <= 4  # one test, and the split in the branches that need it


def test_skipped_repetitions_equal_all_rules(spark):
    rnd = random.Random(3)
    words = ["the", "The", "THE", "this", "thıs", "thİs", "thiſ", "movie", "Movie", "director", "dırector",
             "director's", "actor", "actreſs", "(played by the actress)", "(PLAYED BY THE ACTOR)", "Captain", "mſ",
             "Dr", "OG", "'LOL'", "(omg)", "LoL", "and", "writer", "x"]
    rows = [(k, "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", ". "]) for _ in range(rnd.randrange(0, 14))))
            for k in range(1500)] + [(1500, None), (1501, "")]
    d = spark.createDataFrame(rows, "id long, t string").withColumn("known", F.array(F.lit("OMG")))
    got = {r.id: r.t for r in tx._repetitions_and_abbreviations(d, "t", "known", F.lit(True)).collect()}
    want = F.col("t")
    for p, r in R.REPETITIONS_1:
        want = F.regexp_replace(replace(want, tx._bounded(p), r, ignore_case=True), "  +", " ")
    d = d.withColumn("t", want).localCheckpoint()
    for abb, r in R.ABBREVIATIONS:
        if abb == "OMG":
            continue
        c = replace(replace(F.col("t"), f"['\"]{abb}['\"]", r, ignore_case=True), f"\\( ?{abb} ?\\)", "", ignore_case=True)
        d = d.withColumn("t", F.regexp_replace(replace(c, tx._bounded(abb), r, ignore_case=True), "  +", " "))
    found = {r.id: r.t for r in d.collect()}
    assert got == found
    assert sum(got[k] != t for k, t in rows) > 700


def test_normalisation_rules_are_tried_where_they_can_match():
    """Most rules wait for a literal of theirs; skipping them changes no text."""
    import re

    from reviewlake.functions import regex

    class Counted:
        tried = 0

        def __init__(self, p):
            self.p, self.sub = re.compile(p), re.compile(p).sub

        def search(self, t):
            Counted.tried += 1
            return self.p.search(t)

    needs = tx._normalize_prefilters()

    def table(needs):
        return [[(Counted(p), r, tuple(x for x in needs.get(p, ()) if isinstance(x, str)),
                  tuple(x for x in needs.get(p, ()) if isinstance(x, re.Pattern)), regex.NON_ASCII in needs.get(p, ()))
                 for p, r in rules] for rules in R.NORMALIZE_PASSES]

    regex._through("Words of a line.\nThey go on, and end.", table(needs))
    assert Counted.tried <= 12
    rnd = random.Random(9)
    parts = ["https://x.y", "a.com", "#tag", "@me", "\n", "\n-", "\n1)", "...", "\\", "==", "----", "++++", "******", "??", "!!",
             ",,", " . . .", "☆", ": )", ";|", ":(", " ^_^ ", ":=)", "<3", "*sigh*", "f*ck", "Fu@k", "cR@p", "B@lls", "sh@t", "”", "´",
             "''", " @ ", "(=", "_", "~", "website", "me@you", "'so'", "\t", "(1999)", "(R.I.P.)", "TL;dr: ", "a(b)", "(s)he", "(un)do",
             ",a", "a.B", ";x", "!x", "x(", ")x", "x:y", "e.g. ", "I.E.:", "etc. a", "--", " Im ", " isnt ", "Make-Up", "slow-motion",
             "Screen-Writer", "script writer", "capt.", "Dr.", "Mrs.", "Ms.", "C.G.I.", " Vol. 2", "R.I.P.D.", ", b/c ", " w/o ", " V/S. ",
             "Contd.", " No. 7", "appr.", "(pp.", " -x", "- ", "... A", ". . ", " , ", "é", "word", "The"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) + rnd.choice(["", " ", "a"]) for _ in range(rnd.randrange(0, 12)))
        assert regex._through(t, table(needs)) == regex._through(t, table({})), t


def test_repair_looks_at_pieces_before_its_fold(spark):
    """The fold's state holds all sentences so far: nothing in it may copy them piece by piece."""
    assert "aggregate(transform(" in plan_of(spark, tx.repair_sentences)
    long = spark.range(1).select(F.expr("transform(sequence(1, 20000), x -> concat('Sentence ', x, ' here.'))").alias("s"))
    assert long.select(F.size(tx.repair_sentences("s"))).first()[0] == 20000


def test_polarity_keeps_no_lists(spark):
    from reviewlake.operators.polarity import lexicon_polarity
    lexicon = spark.createDataFrame([("good", 2.0, "valence"), ("very", 0.293, "booster"), ("not", 0.0, "negation"),
                                     ("but", 0.0, "contrast")], "word string, valence double, kind string")
    d = spark.createDataFrame([(1, "not very good but x GOOD"), (2, "good"), (3, "very very x good"), (4, None), (5, "no")],
                              "id long, t string")
    got = lexicon_polarity(d, "id", "t", lexicon)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    s = {1: (2 + 0.293) * -0.74 * 0.5 + (2 + 0.733) * 1.5, 2: 2.0, 3: 2 + 0.293 * 0.95 + 0.293 * 0.9, 4: 0.0, 5: 0.0}
    for r in got.collect():
        assert abs(r.compound - s[r.id] / (s[r.id] ** 2 + 15) ** 0.5) < 6e-5, r


def test_dictionaries_are_shared_by_batches(spark, pipeline, monkeypatch):
    """a batch that is given its titles' dictionaries does not key them again."""
    from reviewlake.operators import metadata as md
    dictionaries = pipeline.dictionaries(pipeline.reviews)
    want = pipeline.preprocess(pipeline.reviews)
    monkeypatch.setattr(md, "usable_entries", None)
    with pipeline.sharing(dictionaries):
        got = pipeline.preprocess(pipeline.reviews)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ratings_are_summed_up_once(pipeline):
    """Titles and their genres read the stored titles with ratings, not the line items."""
    for d in pipeline._titles:
        assert "l_partkey" not in d._jdf.queryExecution().optimizedPlan().toString()
