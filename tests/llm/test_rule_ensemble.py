"""Quality rules learnt from labels: held-out accuracy, compiled rules against numpy, lasso, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import rule_ensemble as re_
from reviewlake.llm.common import table
from reviewlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ensemble(spark):
    return re_.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_fold(spark):
    got = QUERIES["op12_quality_classifier"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    rows = got.join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.quality == 0 for r in rows) >= 5
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) >= 0.98 and np.mean([1 - r.predicted for r in bad]) >= 0.9
    auc = np.mean([(g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad])
    assert auc >= 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_compiled_rules_equal_numpy(spark, ensemble):
    docs = table(spark, SF, "documents")
    rows = re_.statistics(docs, "doc_id").toPandas().sort_values("doc_id")
    x = rows[[f"s_{k}" for k in re_.NAMES]].to_numpy(float)
    z = np.full(len(x), ensemble.intercept)
    for rule, weight in ensemble.rules:
        z += weight * re_.matches(rule, x)
    got = re_.score(docs, ensemble).toPandas().sort_values("doc_id")
    assert np.abs(got["score"].to_numpy() - 1 / (1 + np.exp(-z))).max() < 1e-8
    assert ensemble.rules and len(re_.as_text(ensemble)) == len(ensemble.rules)


def test_statistics_by_hand(spark):
    text = "The cat, the DOG!\n\n  a|b 12 #x  \nThe cat, the DOG!"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "é" * 200_000, 5)],
                                 "doc_id long, text string, n_words long")
    by = {r.doc_id: r for r in re_.statistics(docs, "doc_id").collect()}
    r = by[1]
    assert (r.s_n_words, r.s_n_lines) == (11, 3) and r.s_repeated_lines == pytest.approx(1 / 3)
    assert r.s_symbol_ratio == pytest.approx(2 / 11) and r.s_mark_ratio == pytest.approx(2 / 11)
    assert r.s_distinct_ratio == pytest.approx(7 / 11) and r.s_stop_word_ratio == pytest.approx(2 / 11)
    assert r.s_ended_line_ratio == pytest.approx(2 / 3) and r.s_digit_ratio == pytest.approx(2 / len(text))
    assert all(v == 0 for v in by[2][1:]) and by[2][1:] == by[3][1:]
    assert by[4].s_mean_word == 200_000 and by[4].s_letter_ratio == 1


def test_lasso_is_optimal():
    rnd = np.random.default_rng(3)
    a = (rnd.random((300, 12)) < 0.4).astype(float)
    y = (a[:, 0] + a[:, 1] - a[:, 2] + rnd.normal(0, 0.5, 300) > 0.5).astype(float)
    w, b = re_.lasso(a, y, 0.02, 20_000, (np.zeros(12), 0.0))
    r = (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    g = a.T @ r
    assert abs(r.sum()) < 1e-5  # the intercept is free
    assert np.abs(g[w != 0] + 0.02 * np.sign(w[w != 0])).max() < 1e-5 and np.abs(g[w == 0]).max() <= 0.02 + 1e-5
    assert 0 < (w != 0).sum() < 12


def test_edges(spark, ensemble, documents):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000), (None, "Text.")]
    got = re_.score(documents(rows), ensemble).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert re_.score(documents([]), ensemble).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    one = re_.train(documents(rows), labels)
    assert not one.rules and re_.score(documents(rows), one).where("score = 1").count() == 5
    none = re_.train(documents(rows), labels.limit(0))
    assert re_.score(documents(rows), none).where("score = 0").count() == 5


def test_held_out_labels_are_not_read(spark, ensemble):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(re_.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert re_.train(docs, flipped) == ensemble
