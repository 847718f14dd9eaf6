"""Learnt sentence boundaries: abbreviations, numbers, initials, ellipses, starters, and the counts by hand."""

import math

from reviewlake.operators import boundaries as bd


def corpus(spark):
    texts = []
    for k in range(120):
        texts.append(f"I saw Dr. Miller in town{k}. The film{k} was good. It ran long etc. and so on. The end came. We left{k}.")
        texts.append(f"We met Mr. Jones there. It was approx. two hours. The plot{k} held. The cast did well. It worked.")
        texts.append(f"They like film{k}. The town is old. A doctor came. It rained on Mister{k}. The rest is quiet.")
        # the words that end sentences above stand inside one here
        texts.append(f"some good town came there and held on well worked old quiet hours left it did film{k} day")
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def test_lists_and_splits(spark):
    docs = corpus(spark)
    counts, abbrevs, start, pairs = bd.learn(docs, "t", lambda d: d.cache())
    by = {r.type: (r.n, r.n_period) for r in counts.collect()}
    assert by["dr"] == (120, 120) and by["mr"] == (120, 120) and by["film7"] == (3, 1)
    short = {r.type for r in abbrevs.collect()}
    assert {"dr", "mr", "etc", "approx"} <= short and not short & {"town", "good", "came", "there", "film7"}
    first = {r.type for r in start.collect()}
    assert {"the", "it"} <= first and not first & {"miller", "jones", "film7"}
    assert ("dr", "miller") in {(r.type, r.next) for r in pairs.collect()}
    cases = {
        "I saw Dr. Miller. He left.": ["I saw Dr. Miller.", "He left."],
        "It ran long etc. The end came.": ["It ran long etc.", "The end came."],         # a starter ends it
        "It ran long etc. Nobody stayed.": ["It ran long etc. Nobody stayed."],
        "It was by J. Smith. Good.": ["It was by J. Smith.", "Good."],                      # an initial
        "See part 5. Chapter two. The end.":
        ["See part 5. Chapter two.", "The end."],                                            # an ordinal
        "Well... Then it ended. Fine!": ["Well...", "Then it ended.", "Fine!"],
        "He called (Mr. Jones). The end.": ["He called (Mr. Jones).", "The end."],
        "": [], "no end": ["no end"],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "id int, t string")
    got = {r.id: r.sentences for r in bd.split_learned(df, "t", abbrevs, start, pairs).collect()}
    for k, (t, want) in enumerate(cases.items()):
        assert got[k] == want, t
    assert got[99] in (None, [])


def test_ratio_by_hand(spark):
    from pyspark.sql import functions as F
    a, b, ab, n = 120.0, 130.0, 118.0, 5000.0
    ll = lambda k, m, p: k * math.log(p) + (m - k) * math.log(1 - p)
    want = -2 * (ll(ab, a, b / n) + ll(b - ab, n - a, b / n) - ll(ab, a, ab / a) - ll(b - ab, n - a, (b - ab) / (n - a)))
    got = spark.range(1).select(bd._ratio(F.lit(a), F.lit(b), F.lit(ab), F.lit(n)).alias("x")).first().x
    assert abs(got - want) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "id int, t string")
    counts, abbrevs, start, pairs = bd.learn(docs, "t")
    assert counts.count() == abbrevs.count() == start.count() == pairs.count() == 0
