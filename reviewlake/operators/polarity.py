"""M1-M2: sentence polarity from a valence lexicon (VADER-type rules).

The lexicon is an input table ``(word, valence, kind)`` with kinds
``valence``, ``booster``, ``negation`` and ``contrast``. Per token *i*:

* ``v0`` = valence of the lower-cased token (0 when absent);
* boosters among the three previous tokens add ``b·(1, .95, .9)`` in the
  direction of ``v0``; an all-caps token in a mixed-case sentence adds 0.733;
* each negation (listed, or with "n't") among the three previous tokens multiplies by -0.74;
* tokens before the first contrast word weigh 0.5, after it 1.5.

Sentence score ``s`` = Σv, plus '!' (≤4 × 0.292) and '?' (2-3 × 0.18, more:
0.96) emphasis in the direction of ``s``; ``compound = s/√(s²+15)``
(4 decimals); ``pos``/``neg``/``neu`` are the shares of (v+1), (v-1) and
neutral tokens (3 decimals).

Plan: (id, position, word) rows meet the lexicon in one join; no text is
exploded or part of a key, and the lexicon may have any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake.functions.columns import polarity_bin, polarity_label, round_half_up

BOOST_FACTORS = (1.0, 0.95, 0.9)
N_SCALAR = -0.74
CAPS_INCR = 0.733
EXCL_INCR = 0.292
QM_INCR = 0.18
QM_MAX = 0.96
ALPHA = 15.0
WORD = r"\p{L}+(?:'\p{L}+)*"


def _lexicon_rows(lexicon: DataFrame) -> DataFrame:
    """One row per word: its valence, booster weight, and whether it negates or contrasts."""
    kind = F.col("kind")
    return lexicon.groupBy("word").agg(
        F.max(F.when(kind == "valence", F.col("valence"))).alias("v0"),
        F.max(F.when(kind == "booster", F.col("valence"))).alias("boost"),
        F.coalesce(F.max(kind == "negation"), F.lit(False)).alias("negates"),
        F.coalesce(F.max(kind == "contrast"), F.lit(False)).alias("contrasts"))


def lexicon_polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                     keep: list[str] | None = None) -> DataFrame:
    """Return ``(id_col, *keep, neg, neu, pos, compound)`` for every row of ``df``
    (ids are unique).

    Texts stay where they are: (id, position, word) rows meet the lexicon,
    which can be of any size, and only words in it (and those with ``n't``) go on.
    A word looks at the three known words before it for boosters and negations; the
    sums of a text are joined back to it by its id.
    """
    keep = [c for c in (keep or []) if c != id_col]
    text = F.col(text_col)
    toks = F.regexp_extract_all(text, F.lit(WORD), 0)
    d = df.select(F.col(id_col).alias("__id"), toks.alias("__tok"))
    # all-caps tokens beside others; both tests stop at the first token that decides
    d = d.withColumn("__capdiff", F.exists("__tok", lambda t: t != F.upper(t)) & F.exists("__tok", lambda t: t == F.upper(t)))
    tokens = d.select("__id", F.posexplode("__tok").alias("__i", "__t"), "__capdiff")
    tokens = tokens.select("__id", "__i", F.lower("__t").alias("word"),
                           (F.col("__capdiff") & (F.col("__t") == F.upper("__t"))).alias("caps"))
    known = tokens.join(_lexicon_rows(lexicon), "word", "left").withColumn("n_t", F.col("word").contains("n't")) \
        .where(F.col("v0").isNotNull() | F.col("boost").isNotNull() | F.col("negates") | F.col("contrasts") | F.col("n_t"))
    # all that follows is per text: dealt out by it once, one row per known position
    known = known.repartition("__id")
    off, scored = F.lit(0.0), F.col("v0") != 0
    placed = known.groupBy("__id", "__i").agg(
        F.max(F.when(scored, F.col("v0"))).alias("v0"), F.max(F.when(scored, F.col("caps"))).alias("caps"),
        F.sum(F.coalesce("boost", off)).alias("boost"),
        F.sum((F.coalesce("negates", F.lit(False)) | F.col("n_t")).cast("int")).alias("neg"),
        F.max("contrasts").alias("contrasts"))
    # the three known words before a word hold all that stand among the three positions before it
    order, whole_text = W.partitionBy("__id").orderBy("__i"), W.partitionBy("__id").orderBy("__i").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    placed = placed.withColumns({f"__{c}{j}": F.lag(c, j).over(order) for j in (1, 2, 3) for c in ("__i", "boost", "neg")}
                                | {"but": F.min(F.when(F.col("contrasts"), F.col("__i"))).over(whole_text)})

    def before(c: str, weights) -> Column:
        """What the words of the three positions before send: ``c`` by its distance."""
        def one(j: int) -> Column:
            gap = F.col("__i") - F.col(f"____i{j}")
            return F.coalesce(reduce(lambda x, d: x.when(gap == d, F.col(f"__{c}{j}") * weights[d - 1]), (2, 3),
                                     F.when(gap == 1, F.col(f"__{c}{j}") * weights[0])), F.lit(0))
        return one(1) + one(2) + one(3)

    i, v0, but = F.col("__i"), F.col("v0"), F.col("but")
    weight = F.when(but.isNull(), 1.0).when(i < but, 0.5).when(i > but, 1.5).otherwise(1.0)
    value = ((v0 + F.signum(v0) * (before("boost", BOOST_FACTORS) + F.when(F.col("caps"), CAPS_INCR).otherwise(0.0)))
             * F.pow(F.lit(N_SCALAR), before("neg", (1, 1, 1))) * weight)
    vs = placed.where(v0.isNotNull()).select("__id", value.alias("v"))
    v = F.col("v")
    sums = vs.groupBy("__id").agg(
        F.sum(v).alias("s"), F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("ps"),
        F.sum(F.when(v < 0, v - 1).otherwise(0.0)).alias("ns"), F.count(F.when(v != 0, v)).alias("__scored"))
    ex = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(4)) * EXCL_INCR
    qm = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    qamp = F.when(qm > 1, F.when(qm <= 3, qm * QM_INCR).otherwise(QM_MAX)).otherwise(0.0)
    whole = df.select(F.col(id_col).alias("__id"), *keep, (ex + qamp).alias("__punct"),
                      F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).alias("__n"))
    j = whole.join(sums, "__id", "left")
    s, ps, ns = (F.coalesce(c, off) for c in ("s", "ps", "ns"))
    nu = F.col("__n") - F.coalesce("__scored", F.lit(0))
    return j.select(F.col("__id").alias(id_col), *keep, *_scores(s, ps, ns, nu, F.coalesce("__punct", off)))


def _scores(s: Column, ps: Column, ns: Column, nu: Column, punct: Column) -> list[Column]:
    s2 = F.when(s > 0, s + punct).when(s < 0, s - punct).otherwise(s)
    comp = F.greatest(F.least(s2 / F.sqrt(s2 * s2 + ALPHA), F.lit(1.0)), F.lit(-1.0))
    comp = F.when(s == 0, 0.0).otherwise(comp)
    ps2 = F.when(ps > -ns, ps + punct).otherwise(ps)
    ns2 = F.when(ps < -ns, ns - punct).otherwise(ns)
    total = ps2 - ns2 + nu
    share = lambda x: F.when(total == 0, 0.0).otherwise(round_half_up(F.abs(x / total), 3))
    return [share(ns2).alias("neg"), share(nu.cast("double")).alias("neu"), share(ps2).alias("pos"),
            round_half_up(comp, 4).alias("compound")]


def with_polarity_bin(df: DataFrame, compound: str = "compound") -> DataFrame:
    """M2: add the 5-bin polarity and its label."""
    return df.withColumn("polarity_bin", polarity_bin(compound)) \
        .withColumn("polarity", polarity_label(F.col("polarity_bin")))
