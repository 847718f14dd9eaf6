"""X7 and X13 with the entries that occur in a text against the whole dictionary per title."""

import random

from pyspark.sql import functions as F

from reviewlake.operators import metadata as md
from reviewlake.operators import text as tx

MD = ("title_id string, category string, mdType string, strSearch string, strReplace string, ambiguous boolean, "
      "conflicts boolean, strSearchEscaped string, lenSearch int")


def made_up(seed, titles, texts):
    rnd = random.Random(seed)
    words = ["Red", "Rum", "movie", "this", "the", "actor", "Mary", "ann", "Doe", "John", "son", "Johnson", "moviegoer",
             "athis", "OG", "x", "Übel", "ΟΔΟΣ", "M*A*S*H", "Jr.", "{Proof}", "$5", "A\\B"]
    bounds = [" ", " ", " ", " ", "  ", ". ", "' ", " '", "(", ")", ") ", " (", "\"", "'", "/", ", ", "!", ""]
    entries = []
    for t in range(titles):
        for _ in range(rnd.randrange(0, 9)):
            s = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))
            work = rnd.random() < 0.5
            entries.append((f"t{t}", "WORK_OF_ART" if work else "PERSON", "title" if work else "name", s,
                            "this movie" if work else "the actor", rnd.random() < 0.15, rnd.random() < 0.25, s, len(s)))
    entries += entries[:4]  # repeated entries are applied twice
    rows = [(k, rnd.choice([None, *[f"t{t}" for t in range(titles + 2)]]),
             "".join(rnd.choice(words) + rnd.choice(bounds) for _ in range(rnd.randrange(0, 25)))) for k in range(texts)]
    rows += [(texts + 1, "t1", "a(John Doe)b and a(Doe)(Mary)b"), (texts + 2, "t0", ""), (texts + 3, "t0", None)]
    return entries, rows


def test_occurring_entries_equal_whole_dictionary(spark):
    from reviewlake.functions.regex import java_pattern  # noqa: F401  (patterns are escaped as in the pipeline)
    from reviewlake.operators.metadata import escape_for_regex
    from reviewlake.functions import rules as R
    entries, rows = made_up(5, 12, 900)
    d = spark.createDataFrame(entries, MD).withColumn("strSearchEscaped", escape_for_regex(F.col("strSearch"), R.ESCAPE_CHARS))
    texts = spark.createDataFrame(rows, "id long, title_id string, t string")

    arrays = md.dictionary_arrays(d)
    j = texts.join(arrays, "title_id", "left")
    j = j.withColumn("entries", F.coalesce("entries", F.array().cast(arrays.schema["entries"].dataType))) \
        .withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    want = {r.id: (r.o, r.s) for r in tx.replace_metadata(j, "t", "entries", "words", out="o").select(
        "id", "o", tx.resolve_conflicts(F.array("t"), "entries").alias("s")).collect()}

    a = tx.occurring_entries(texts, md.usable_entries(d), "t", md.title_facts(d))
    carried = a.select(F.sum(F.size("entries"))).first()[0]
    got_o = {r.id: r.o for r in tx.replace_occurring(a, "t", "o").collect()}
    b = tx.occurring_entries(texts, md.wanted_entries(d), "t", out="wanted")
    got_s = {r.id: r.s for r in b.select("id", tx.resolve_wanted(F.array("t"), "wanted").alias("s")).collect()}
    assert set(got_o) == set(want) == set(got_s)
    for k, (o, s) in want.items():
        assert got_o[k] == o, (rows[k] if k < len(rows) else k, o)
        assert got_s[k] == s, k
    texts_by = {k: t for k, _, t in rows}
    assert sum(o != texts_by[k] for k, (o, _) in want.items()) > 300  # the dictionary is at work
    assert carried < 0.75 * j.select(F.sum(F.size("entries"))).first()[0]


def test_dictionary_rewrites_each_entry_once(spark, pipeline):
    """The set logic of N13 and N14 reads stored entries: no rewriting rule is left in its plan."""
    from reviewlake.operators.metadata import metadata_dictionary
    d = metadata_dictionary(pipeline.titles_flagged, pipeline.people_principals, pipeline.people)
    assert "RLIKE" not in d._jdf.queryExecution().optimizedPlan().toString()
