"""M3 golden cases, J6 against brute-force LIKE, polarity bins."""
from reviewlake.functions.columns import polarity_bin, star_bucket
from reviewlake.operators.aspects import context_categories, term_matches


def test_context_categories(spark):
    terms = spark.createDataFrame([(2, "Effects", "special effects"), (2, "Effects", "effects"), (4, "Story", "plot"),
                                   (11, "Overall", "overall"), (6, "Cast", "cast")],
                                  "aspect_id int, category string, term string")
    cases = {"the special effects were great": ["Effects"], "overall the plot": ["Story"], "": ["Other"],
             "overall good": ["Overall"], "nothing here": ["Other"], "cast and plot": ["Cast", "Story"]}
    df = spark.createDataFrame([(k,) for k in [*cases, "overall good"]], "c string")
    got = {r.c: r.categories for r in context_categories(df, terms, "c").collect()}
    assert got == cases
    assert context_categories(df, terms.limit(0), "c").where("categories != array('Other')").count() == 0


def test_term_match_equals_like(spark):
    sents = ["The plot was thin", "a plot twist", "plot", "the special effects were fine", "my plot, again"]
    df = spark.createDataFrame(list(enumerate(sents)), "id int, sentence string")
    terms = spark.createDataFrame([(4, "n", "plot"), (2, "n", "special effects")], "aspect_id int, POS string, term string")
    got = {(r.sentence_id, r.term) for r in term_matches(df, terms).collect()}
    exp = {(i, t) for i, s in enumerate(sents) for t in ("plot", "special effects") if f" {t} " in s.lower()}
    assert got == exp


def test_bins_at_edges(spark):
    vals = [0.7, 0.6, 0.2, -0.2, -0.6, -0.61, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [(r.b, r.s) for r in df.select(polarity_bin("x").alias("b"), star_bucket("x").alias("s")).collect()]
    assert [g[0] for g in got] == [5, 4, 4, 3, 2, 1, 1]            # SQL CASE ladder (H6)
    assert [g[1] for g in got] == [5, 4, 3, 2, 1, 1, None]         # right-closed bins (H6)


def test_contained_terms_equal_brute_force(spark):
    import random

    from reviewlake.operators.aspects import contained_terms
    rnd = random.Random(2)
    alphabet = ["a", "b", "c", " ", "é", "ß", "\U0001f600", "\n", "."]
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    contexts = {make(rnd.randrange(0, 60)) for _ in range(200)} | {make(30_000), "aaaa", ""}
    terms = {make(rnd.randrange(1, 7)) for _ in range(150)} | {"a", "ab", "aaa", "never there"}
    c = spark.createDataFrame([(x,) for x in contexts] + [(None,)], "context string")
    t = spark.createDataFrame([(x,) for x in terms] + [("",)], "term string")
    got = sorted((r.context, r.term) for r in contained_terms(c, t).collect())
    assert got == sorted((x, y) for x in contexts for y in terms if y in x)


def test_spans_of_long_sentences_equal_brute_force(spark):
    import random

    from reviewlake.operators.aspects import CHUNK, aspect_spans
    rnd = random.Random(5)
    words = ["of", "Of", "the", "and", "x", "", "é", "\U0001f600y", "of\n"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in [0, 1, 2, 3, CHUNK - 1, CHUNK, CHUNK + 1, CHUNK + 4,
                                                                     3 * CHUNK, CHUNK * CHUNK + 40, 2500]] + [None]
    terms = spark.createDataFrame([(1, "n", "of"), (2, "n", "OF the"), (3, "n", "of the and"), (4, "n", ""), (5, "n", " ")],
                                  "aspect_id int, POS string, term string")
    rows = [(j, 7 * j, s) for j, s in enumerate(texts)] + [(1, 99, texts[1]), (4, 28, texts[4]), (None, 1, "of x of")]
    df = spark.createDataFrame(rows, "id long, review_id long, sentence string")
    found = {"of", "of the", "of the and", "", " "}
    want = []
    for j, r, s in rows:
        if s is None:
            continue
        p, seen = s.split(" "), {}
        for i in range(len(p)):
            for k in (1, 2, 3):
                t = " ".join(p[i:i + k])
                if i + k <= len(p) and t.lower() in found:
                    start = len(" ".join(p[:i])) + (i > 0)
                    ctx = " ".join(p[max(i - 3, 0):i + k + 3]).lower()
                    want.append((j, r, start, start + len(t), t, ctx, seen.get(t, 0)))
                    seen[t] = seen.get(t, 0) + 1
    got = [tuple(x) for x in aspect_spans(df, terms, keep=["review_id"])
           .select("sentence_id", "review_id", "start", "end", "span", "context", "ordinal").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_spans_carry_no_sentence(spark):
    """What a run of pieces takes along is bounded: a sentence of 60,000 words is no square of work."""
    from reviewlake.operators.aspects import aspect_spans
    terms = spark.createDataFrame([(1, "n", "the")], "aspect_id int, POS string, term string")
    df = spark.range(1).selectExpr("id", "array_join(array_repeat('the cat', 30000), ' ') AS sentence")
    r = aspect_spans(df, terms).selectExpr("count(*) AS n", "max(ordinal) AS o", "max(start) AS s").first()
    assert (r.n, r.o, r.s) == (30_000, 29_999, 29_999 * 8)


def test_categories_by_words(spark):
    from reviewlake.operators.aspects import context_categories
    terms = spark.createDataFrame([(1, "A", "of the"), (2, "B", "f t"), (3, "C", " "), (4, "D", "ab"), (4, "D", "abc")],
                                  "aspect_id int, category string, term string")
    cases = {"xof the": ["A"], "of they": ["A"], "of  the": ["C"], "f t": ["B"], "fit": ["Other"], "zabcz": ["D"],
             "leaf tab": ["B", "D"], None: ["Other"]}
    df = spark.createDataFrame([(x,) for x in cases], "context string")
    assert {r.context: r.categories for r in context_categories(df, terms).collect()} == cases


def test_single_pieces_are_not_cut_and_joined(spark):
    from pyspark.sql import functions as F
    from reviewlake.operators.aspects import _grams
    d = spark.createDataFrame([(["a", "", "b", "c"],), ([],)], "p array<string>")
    for most, joins in ((1, 0), (2, 1)):
        g = d.select(_grams(F.col("p"), most, F.lit(0), F.size("p") - 1).alias("g"))
        assert g._jdf.queryExecution().analyzed().toString().count("array_join") == joins
    a, b = ([(x.i, x.k, x.text) for x in r.g] for r in g.collect())
    assert a == [(0, 1, "a"), (1, 1, ""), (2, 1, "b"), (3, 1, "c"), (0, 2, "a "), (1, 2, " b"), (2, 2, "b c")] and b == []


def test_runs_begin_where_a_term_begins(spark):
    """Pieces that begin no term are dropped before runs are built of them."""
    from reviewlake.operators.aspects import aspect_spans
    terms = spark.createDataFrame([(1, "n", "of the"), (2, "n", "Of")], "aspect_id int, POS string, term string")
    df = spark.createDataFrame([(1, "x of the y OF"), (2, "the of")], "id long, sentence string")
    spans = aspect_spans(df, terms)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "posexplode" in plan
    got = sorted((r.sentence_id, r.start, r.span) for r in spans.collect())
    assert got == [(1, 2, "of"), (1, 2, "of the"), (1, 11, "OF"), (2, 4, "of")]
