"""Joint fits of linear classifiers against a plain solver on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import learn
from reviewlake.operators.linear import (TRAIN, LinearModel, Problem, fit_linear, proximal_step, search, splits_column)

NAMES = [f"f{k}" for k in range(7)]


def plain(x, y, C, sweeps=4000):
    """Coordinate descent with one-dimensional Newton steps and halving, from scratch."""
    w, margin = np.zeros(x.shape[1]), np.zeros(len(x))

    def cost(w, margin):
        return np.abs(w).sum() + C * (np.maximum(0, 1 - y * margin) ** 2).sum()

    now = cost(w, margin)
    for _ in range(sweeps):
        before = now
        for j in range(len(w)):
            slack = np.maximum(0, 1 - y * margin)
            g, h = -2 * C * (y * slack * x[:, j]).sum(), 2 * C * ((slack > 0) * x[:, j] ** 2).sum() + 1e-9
            free = w[j] - g / h
            target = np.sign(free) * max(abs(free) - 1 / h, 0)
            step = target - w[j]
            while abs(step) > 1e-12:
                trial = w.copy()
                trial[j] += step
                new = margin + step * x[:, j]
                if (c := cost(trial, new)) <= now:
                    w, margin, now = trial, new, c
                    break
                step /= 2
        if before - now < 1e-10 * max(now, 1):
            break
    return w, now


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(4)
    x = np.column_stack([rnd.integers(-1, 2, 240), rnd.poisson(3, 240), rnd.normal(0, 1, (240, 4)), np.zeros(240)])
    score = x[:, 1] - 3 + 2 * x[:, 2] - x[:, 0] + rnd.normal(0, 1.5, 240)
    five = np.clip(np.floor(score + 3), 1, 5).astype(int)
    rows = [(k, int(five[k]), int(score[k] > 0), *map(float, x[k])) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, class int, binary_class int, " + ", ".join(f"{n} double" for n in NAMES))
    df = df.withColumn("splits", splits_column(F.col("id"), 6)).repartition(3).cache()
    return df, np.column_stack([x, np.ones(240)]), five, (score > 0).astype(int)


@pytest.mark.parametrize("C", [0.024, 0.5, 21.0])
def test_objective_of_the_plain_solver(data, C):
    df, x, _, y = data
    m = fit_linear(df, NAMES, "binary_class", [0, 1], C)
    _, want = plain(x, 2.0 * y - 1, C)
    assert m.objective[0] <= want * 1.001 and m.objective[0] >= want * 0.999
    w = np.array(m.weights[0])
    margin = x @ w
    assert np.abs(w).sum() + C * (np.maximum(0, 1 - (2 * y - 1) * margin) ** 2).sum() == pytest.approx(m.objective[0], rel=1e-9)
    if C == 0.024:
        assert (w == 0).sum() > 1  # the penalty is L1


def test_search_equals_fitting_each_alone(data):
    df, x, five, two = data
    Cs = [0.024, 0.5, 5.0]
    for label, y, classes in (("binary_class", two, [0, 1]), ("class", five, [1, 2, 3, 4, 5])):
        got = search(df, NAMES, label, classes, Cs, splits=6, steps=300, tolerance=1e-7)
        fold = {r.id: r.splits for r in df.select("id", "splits").collect()}
        splits = np.array([fold[k] for k in range(240)])
        for s in range(6):
            assert 0.55 < (splits[:, s] == TRAIN).mean() < 0.85
            for c, C in enumerate(Cs):
                inside, other = splits[:, s] == TRAIN, splits[:, s] == 2
                own = classes[1:] if len(classes) == 2 else classes
                w = np.column_stack([plain(x[inside], np.where(y[inside] == k, 1.0, -1.0), C)[0] for k in own])
                margin = x @ w
                guess = (margin[:, 0] > 0).astype(int) if len(classes) == 2 else np.array(classes)[margin.argmax(1)]
                assert got[s, c, 0] == pytest.approx((guess == y)[inside].mean(), abs=0.013)
                assert got[s, c, 1] == pytest.approx((guess == y)[other].mean(), abs=0.045)


def test_tune_refit_predict_and_file(spark, data, tmp_path):
    df = data[0].drop("splits")
    found = learn.tune(df, "class", Cs=[0.024, 1.0], splits=8)
    assert len(found.test) == len(found.train) == 2 and found.best == [0.024, 1.0][int(np.argmax(found.test))]
    model, best = learn.search_and_fit(df, "binary_class", Cs=[0.024, 1.0], splits=8)
    assert model.C == best
    model.save(spark, str(tmp_path / "model"))
    again = LinearModel.load(spark, str(tmp_path / "model"))
    assert again == model
    a, b = ([r.prediction for r in learn.predict(m, df).orderBy("id").collect()] for m in (model, again))
    assert a == b and set(a) == {0, 1}
    assert np.mean(np.array(a) == data[3]) > 0.8


def test_proximal_step_is_a_minimum():
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 1, (30, 5))
    gram, at, g, c = x.T @ x, rnd.normal(0, 1, (5, 3)), rnd.normal(0, 20, (5, 3)), np.array([0.1, 1.0, 9.0])
    w = proximal_step(gram, at, g, c, sweeps=500)

    def cost(w):
        d = w - at
        return (g * d).sum(0) + c * np.einsum("jm,jk,km->m", d, gram, d) + np.abs(w).sum(0)

    for _ in range(300):
        assert (cost(w) <= cost(w + rnd.normal(0, 0.05, w.shape)) + 1e-9).all()


def test_empty_and_one_class(spark, data):
    df = data[0]
    none = Problem(df.limit(0), NAMES, "binary_class", [0, 1], [1.0]).fit()
    assert (none[0] == 0).all()
    m = fit_linear(df.where("binary_class = 1"), NAMES, "binary_class", [0, 1], 1.0)
    assert set(r.prediction for r in learn.predict(m, df.where("binary_class = 1")).collect()) == {1}


def test_training_rows_are_dealt_out(spark, data):
    """The fit's tasks are the files of its rows: few narrow rows still go to all cores."""
    frame = learn.training_frame(data[0].drop("splits").coalesce(1), "binary_class", 3)
    assert len(frame.inputFiles()) >= 2 * spark.sparkContext.defaultParallelism


def test_gradients_of_pieces_equal_plain_sums(data, monkeypatch):
    from reviewlake.operators import linear
    monkeypatch.setattr(linear, "COLUMNS", 7)
    df, x, five, _ = data
    problem = Problem(df, NAMES, "class", [1, 2, 3, 4, 5], [0.5, 2.0], 6)
    rnd = np.random.default_rng(3)
    active = np.sort(rnd.choice(problem.models, 23, replace=False))
    w = rnd.normal(0, 0.3, (x.shape[1], len(active)))
    g, loss = problem.gradients(w, active)
    fold = {r.id: r.splits for r in df.select("id", "splits").collect()}
    train = np.array([fold[k] for k in range(240)]) == TRAIN
    y = np.where(five[:, None] == np.arange(1, 6)[None, :], 1.0, -1.0)
    for m, place in enumerate(active):
        s, own = place // 10, place % 5
        slack = np.maximum(1 - y[:, own] * (x @ w[:, m]), 0) * train[:, s]
        assert loss[m] == pytest.approx((slack ** 2).sum()) and g[:, m] == pytest.approx(-2 * x.T @ (y[:, own] * slack))
