"""Quality classifier: a sparse ensemble of rules over text statistics.

1. **Statistics.**  Numbers that describe a whole text (``STATISTICS``), each a
   Spark column expression over counts that are projected first, so that no
   text is scanned twice for the same count.
2. **Rules.**  Small gradient-boosted trees are grown on samples of the labelled
   rows; every node but a root gives a rule, the conjunction of the comparisons
   on its path (``symbol_ratio > 0.2 AND dup_lines <= 0.1``).  Rules that hold for
   the same rows are kept once.
3. **Weights.**  A lasso logistic regression (accelerated proximal gradient)
   weighs the rules; the penalty is the strongest one on the path whose
   loss on validation rows is within ``slack`` of the best, so few rules stay.
4. **Scoring.**  The remaining rules are compiled to one Spark column: a sum
   of ``CASE WHEN rule THEN weight`` inside the logistic function.  No Python
   runs on the documents.

Labels are learnt only outside the held-out fold, from at most ``Training.docs``
rows, taken in the order of a hash of their id; statistics and scores cover all
documents.  ``doc_id``, ``lang``, ``source`` and labels are no inputs.

Defined results: a null text is empty; an empty text has zeros for statistics
and a score like any other; repeated rows score alike; an id without text
teaches nothing, one with several texts or labels counts once (its least
statistics, the highest label); without labels of both kinds every score is the share of
ones (0 without labels); an empty table gives no rows; further columns are
ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

FOLDS = 5
WORD = r"[^\x20\x09-\x0D]+"
#: Frequent words of the languages that the statistics know.
STOP_WORDS = ("the of and to in a is that for it as was with be by on not he i this are or his from at which "
              "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont "
              "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an "
              "el los del las por con no su para al lo como").split()

#: Counts of a whole text, each read in one pass over it or its words and lines.
COUNTS: dict[str, str] = {
    "chars": "char_length(text)",
    "letters": r"char_length(regexp_replace(text, '[^\\p{L}]+', ''))",
    "capitals": r"regexp_count(text, '\\p{Lu}')",
    "digits": "regexp_count(text, '[0-9]')",
    "symbols": r"regexp_count(text, '[#*$%&|<>{}\\[\\]\\\\^~=+_@]')",
    "marks": "regexp_count(text, '[!?]')",
    "stops": "regexp_count(text, '[.,;:]')",
    "separators": "regexp_count(text, '[|>»•·]')",
    "words": "size(tokens)",
    "distinct_words": "size(array_distinct(tokens))",
    "stop_words": "size(filter(tokens, w -> w IN ({stop})))",
    "one_char_words": "size(filter(tokens, w -> char_length(w) = 1))",
    "lines": "size(lines)",
    "distinct_lines": "size(array_distinct(lines))",
    "short_lines": "size(filter(lines, l -> char_length(l) < 30))",
    "ended_lines": "size(filter(lines, l -> right(l, 1) IN ('.', '!', '?', '\"', ')')))",
}
#: Statistics over the counts; the divisor of an empty text is one.
STATISTICS: dict[str, str] = {
    "n_words": "words",
    "mean_word": "letters / greatest(words, 1)",
    "letter_ratio": "letters / greatest(chars, 1)",
    "capital_ratio": "capitals / greatest(letters, 1)",
    "digit_ratio": "digits / greatest(chars, 1)",
    "symbol_ratio": "symbols / greatest(words, 1)",
    "mark_ratio": "marks / greatest(words, 1)",
    "stop_ratio": "stops / greatest(words, 1)",
    "separator_ratio": "separators / greatest(words, 1)",
    "distinct_ratio": "distinct_words / greatest(words, 1)",
    "stop_word_ratio": "stop_words / greatest(words, 1)",
    "one_char_ratio": "one_char_words / greatest(words, 1)",
    "n_lines": "lines",
    "words_per_line": "words / greatest(lines, 1)",
    "repeated_lines": "(lines - distinct_lines) / greatest(lines, 1)",
    "short_line_ratio": "short_lines / greatest(lines, 1)",
    "ended_line_ratio": "ended_lines / greatest(lines, 1)",
}
NAMES = list(STATISTICS)


@dataclass(frozen=True)
class Training:
    """Labelled rows, trees and penalties."""

    docs: int = 8_000
    trees: int = 40
    depth: int = 3
    leaf: int = 8
    sample: float = 0.5
    rate: float = 0.2
    cuts: int = 32
    validation: float = 0.25
    slack: float = 0.005
    penalties: tuple[float, ...] = (0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)
    steps: int = 200
    seed: int = 7


#: One comparison: (statistic, whether above, threshold).  A rule is a tuple of them.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    """Intercept and weighted rules."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the statistics of every text (column ``text``), as doubles."""
    tokens = F.regexp_extract_all("text", F.lit(WORD), 0)
    # blank lines say nothing; lines are stripped so that a trailing blank hides no stop
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    held = docs.select(*keep, text_of().alias("text")).withColumns({"tokens": tokens, "lines": lines})
    counts = held.select(*keep, *[F.expr(e.replace("{stop}", stop)).alias(f"n_{k}") for k, e in COUNTS.items()])
    any_count = re.compile(rf"\b({'|'.join(COUNTS)})\b")
    return counts.select(*keep, *[F.expr(any_count.sub(r"n_\1", e)).cast("double").alias(f"s_{k}")
                                  for k, e in STATISTICS.items()])


def matches(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` for which a rule holds."""
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def compiled(rule: Rule) -> Column:
    """The same rule as a Spark condition."""
    out = F.lit(True)
    for j, above, t in rule:
        c = F.col(f"s_{NAMES[j]}")
        out &= (c > F.lit(t)) if above else (c <= F.lit(t))
    return out


def thresholds(x: np.ndarray, cuts: int) -> list[np.ndarray]:
    """Cut points per statistic: midpoints between quantiles that differ."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)))
        # ratios of bad texts are rare: the upper tail gets cuts of its own
        tail = np.unique(np.quantile(x[:, j], 1 - 0.5 ** np.arange(2, 9)))
        q = np.unique(np.concatenate([q, tail, np.unique(x[:, j])[:2]]))
        out.append(np.round((q[1:] + q[:-1]) / 2, 9))
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, t: Training, cut: list[np.ndarray],
         rule: Rule = ()) -> list[tuple[Rule, float, np.ndarray]]:
    """Leaves (rule, step, rows) of a tree on gradients ``g`` and curvatures ``h``."""
    at = np.arange(len(g)) if not rule else np.flatnonzero(matches(rule, x))
    value = g[at].sum() / (h[at].sum() + 1.0)
    if len(rule) >= t.depth or len(at) < 2 * t.leaf:
        return [(rule, value, at)]
    own = x[at]
    base, best = g[at].sum() ** 2 / (h[at].sum() + 1.0), (1e-6, None)
    for j, points in enumerate(cut):
        if not len(points):
            continue
        slot = np.searchsorted(points, own[:, j], side="left")  # slot s: value is above the first s points
        sums = [np.bincount(slot, weights=w, minlength=len(points) + 1)[::-1].cumsum()[::-1][1:] for w in (g[at], h[at])]
        many = np.bincount(slot, minlength=len(points) + 1)[::-1].cumsum()[::-1][1:]
        gain = (sums[0] ** 2 / (sums[1] + 1.0) + (g[at].sum() - sums[0]) ** 2 / (h[at].sum() - sums[1] + 1.0) - base)
        gain[(many < t.leaf) | (len(at) - many < t.leaf)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (j, float(points[k])))
    if best[1] is None:
        return [(rule, value, at)]
    j, point = best[1]
    return [leaf for above in (True, False) for leaf in grow(x, g, h, t, cut, (*rule, (j, above, point)))]


def tree_rules(x: np.ndarray, y: np.ndarray, t: Training) -> list[Rule]:
    """Rules of all nodes of boosted trees, each set of matching rows once."""
    rnd = np.random.default_rng(t.seed)
    cut, z = thresholds(x, t.cuts), np.full(len(y), np.log((y.mean()) / (1 - y.mean())))
    rules: dict[bytes, Rule] = {}
    for _ in range(t.trees):
        some = np.sort(rnd.permutation(len(y))[:max(2 * t.leaf, int(t.sample * len(y)))])
        p = 1 / (1 + np.exp(-z[some]))
        for rule, step, _ in grow(x[some], y[some] - p, p * (1 - p), t, cut):
            if not rule:
                continue
            z[matches(rule, x)] += t.rate * step
            for k in range(1, len(rule) + 1):
                part = simplified(rule[:k])
                rules.setdefault(np.packbits(matches(part, x)).tobytes(), part)
    return sorted(rules.values(), key=lambda r: (len(r), r))


def simplified(rule: Rule) -> Rule:
    """One comparison per statistic and side: the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for j, above, point in rule:
        k = (j, above)
        best[k] = point if k not in best else max(best[k], point) if above else min(best[k], point)
    return tuple(sorted((j, above, point) for (j, above), point in best.items()))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int, start: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression (the
    intercept is free), by accelerated proximal gradient with restarts."""
    w, b = start[0].copy(), start[1]
    rate = 4.0 / (np.linalg.norm(np.column_stack([a, np.ones(len(a))]), 2) ** 2 / len(a))
    v, c, momentum = w.copy(), b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ v + c))) - y) / len(y)
        new = v - rate * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        level = c - rate * r.sum()
        if ((v - new) @ (new - w)) + (c - level) * (level - b) > 0:
            momentum = 1.0
        grown = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v, c = new + (momentum - 1) / grown * (new - w), level + (momentum - 1) / grown * (level - b)
        w, b, momentum = new, level, grown
    return w, b


def log_loss(a: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> float:
    z = a @ w + b
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, t: Training = Training()) -> Ensemble:
    """Rules and weights from statistics ``x`` and labels ``y``."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Ensemble(float("inf") if share == 1 else float("-inf"), ())
    rules = tree_rules(x, y, t)
    a = np.column_stack([matches(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    check = np.random.default_rng(t.seed).random(len(y)) < t.validation
    if not (0 < y[check].sum() < check.sum()) or not (0 < y[~check].sum() < (~check).sum()):
        check[:] = False
    if check.any():
        path, start = [], (np.zeros(a.shape[1]), 0.0)
        for penalty in t.penalties:
            start = lasso(a[~check], y[~check], penalty, t.steps, start)
            path.append(log_loss(a[check], y[check], *start))
        chosen = next(p for p, loss in zip(t.penalties, path, strict=True) if loss <= min(path) + t.slack)
    else:
        chosen = t.penalties[len(t.penalties) // 2]
    start = (np.zeros(a.shape[1]), 0.0)
    for penalty in t.penalties[:t.penalties.index(chosen) + 1]:
        start = lasso(a, y, penalty, t.steps, start)
    w, b = start
    return Ensemble(round(float(b), 9), tuple((r, round(float(v), 9)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Ensemble:
    """An ensemble from at most ``t.docs`` labelled rows outside the held-out
    fold; the statistics are computed by Spark, only they come to the driver."""
    known = (labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    chosen = (known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(t.docs))
    own = texts.join(F.broadcast(chosen), "doc_id")
    rows = (statistics(own, "doc_id", "quality").groupBy("doc_id", "quality")
            .agg(F.min(F.struct(*[f"s_{k}" for k in NAMES])).alias("s")).select("doc_id", "quality", "s.*")
            .toArrow().sort_by("doc_id"))
    x = np.column_stack([np.asarray(rows[f"s_{k}"], float) for k in NAMES])
    return fit(x, np.asarray(rows["quality"], float), t)


def score_column(e: Ensemble) -> Column:
    """The logistic function of the weighted rules, rounded to 9 places."""
    if not np.isfinite(e.intercept):
        return F.lit(1.0 if e.intercept > 0 else 0.0)
    z = F.lit(e.intercept)
    for rule, weight in e.rules:
        z = z + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 9)


def score(docs: DataFrame, e: Ensemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    scored = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(e).alias("score"))
    return scored.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def as_text(e: Ensemble) -> list[str]:
    """The rules in words, strongest first."""
    def one(rule: Rule) -> str:
        return " AND ".join(f"{NAMES[j]} {'>' if above else '<='} {t:g}" for j, above, t in rule)

    return [f"{w:+.3f} {one(r)}" for r, w in sorted(e.rules, key=lambda x: -abs(x[1]))]
