"""Many linear classifiers in one pass over the rows.

A model minimises ``|w|_1 + C * sum(max(0, 1 - y * (w.x + b))^2)`` over its
training rows, with the intercept penalised like a weight; five classes are
five such problems, one against the rest.  A search fits every random split
with every ``C`` for every class: some thousand models over the same rows.

They are fitted together.  The weights of all models are one matrix; a step is
one job in which each task multiplies its rows with that matrix and returns the
sums of all gradients, so a row is read once a step, however many models there
are.  The split is a seeded hash of the row's id, kept as one small array
column (``splits_column``): no row is copied per split.

A search's step is a proximal one in the metric of the Gram matrix of the rows
(one job; an upper bound of the curvature of every split, as a split holds a
part of the rows), with Nesterov's momentum and restarts.  It is solved by
coordinate descent for all models at once; its size is features x models and
does not grow with the rows.  A few models alone (the refit) take Newton steps
instead: their Hessians are summed like the gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import config

TRAIN, TEST = 1, 2
#: Models of a step that are looked at together.
COLUMNS = 256


def splits_column(key: Column, splits: int, train: float = config.SPLIT_TRAIN, test: float = config.SPLIT_TEST,
                  seed: int = config.SEED) -> Column:
    """array<tinyint>: per split, whether a row trains (1), tests (2) or rests (0)."""
    def one(s: Column) -> Column:
        u = F.pmod(F.xxhash64(key, s, F.lit(seed)), F.lit(1_000_000))
        return (F.when(u < round(train * 1_000_000), TRAIN).when(u < round((train + test) * 1_000_000), TEST)
                .otherwise(0).cast("tinyint"))

    return F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), one)


@dataclass(frozen=True)
class LinearModel:
    """Weights by class and feature; the last weight of a class is its intercept.

    ``classes`` has one entry per row of ``weights``; with two classes there is
    one row, positive for the second class."""

    features: tuple[str, ...]
    classes: tuple[int, ...]
    weights: tuple[tuple[float, ...], ...]
    C: float
    objective: tuple[float, ...] = field(default=(), compare=False)

    def margins(self) -> list[Column]:
        out = []
        for w in self.weights:
            m = F.lit(w[-1])
            for name, v in zip(self.features, w, strict=False):
                if v != 0.0:
                    m = m + F.lit(v) * F.col(name)
            out.append(m)
        return out

    def prediction(self) -> Column:
        """The class of the greatest margin (the first one on ties); two classes: the sign."""
        m = self.margins()
        if len(self.classes) == 2:
            return F.when(m[0] > 0, self.classes[1]).otherwise(self.classes[0])
        margins = F.array(*m)
        place = F.array_position(margins, F.array_max(margins)).cast("int")
        return F.element_at(F.array(*map(F.lit, self.classes)), place)

    def save(self, spark: SparkSession, path: str) -> None:
        """A small Parquet table: a row per class and feature (null: intercept)."""
        names = (*self.features, None)
        rows = [(k, j, n, float(w[j]), self.C, list(self.classes)) for k, w in enumerate(self.weights)
                for j, n in enumerate(names)]
        (spark.createDataFrame(rows, "model int, place int, feature string, weight double, C double, classes array<int>")
         .coalesce(1).write.mode("overwrite").parquet(path))

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.parquet(path).orderBy("model", "place").collect()
        models = sorted({r.model for r in rows})
        names = tuple(r.feature for r in rows if r.model == models[0])[:-1]
        return LinearModel(names, tuple(rows[0].classes), tuple(
            tuple(r.weight for r in rows if r.model == k) for k in models), rows[0].C)


def signs(y: np.ndarray, classes: list[int]) -> np.ndarray:
    """+1 or -1 per row and one-against-rest problem."""
    own = classes[1:] if len(classes) == 2 else classes
    return np.where(y[:, None] == np.array(own)[None, :], 1.0, -1.0)


class Problem:
    """Rows (features array, label, splits) and the models to be fitted on them.

    Models are laid out as (split, C, class): ``m = (s * len(Cs) + c) * k + j``.
    Without ``splits`` every row trains the only split."""

    def __init__(self, rows: DataFrame, features: list[str], label: str, classes: list[int], Cs: list[float],
                 splits: int = 0, block: int = 512) -> None:
        self.features, self.classes, self.Cs, self.splits, self.block = features, classes, list(Cs), splits, block
        self.k = 1 if len(classes) == 2 else len(classes)
        self.models = max(splits, 1) * len(self.Cs) * self.k
        vector = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
        fold = F.col("splits") if splits else F.array(F.lit(TRAIN).cast("tinyint"))
        self.rows = rows.select(vector.alias("x"), F.col(label).cast("int").alias("y"), fold.alias("splits"))

    def _sums(self, work, shape: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
        """Sums over all rows of the arrays that ``work(x, y, splits)`` returns
        per block.  A task returns one row per array row; those are added by key
        in Spark, so that the driver gets each sum once."""
        width, block = len(self.features) + 1, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(s) for k, s in shape.items()}
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                x = np.asarray(b.column("x").flatten(), float).reshape(n, width)
                splits = np.asarray(b.column("splits").flatten()).reshape(n, -1)
                y = np.asarray(b.column("y"))
                for i in range(0, n, block):
                    for k, v in work(x[i:i + block], y[i:i + block], splits[i:i + block]).items():
                        total[k] += v
            keys, values = [], []
            for k, v in total.items():
                for j, line in enumerate(v.reshape(v.shape[0], -1)):
                    keys.append(f"{k}:{j}")
                    values.append(line.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values, pa.binary())], ["key", "sum"])

        def add(group: pa.Table) -> pa.Table:
            parts = [np.frombuffer(v.as_py()) for v in group.column("sum")]
            return pa.table({"key": group.column("key")[:1], "sum": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

        schema = "key string, sum binary"
        added = self.rows.mapInArrow(run, schema).groupBy("key").applyInArrow(add, schema).collect()
        out = {k: np.zeros(s) for k, s in shape.items()}
        for r in added:
            k, j = r.key.rsplit(":", 1)
            out[k].reshape(out[k].shape[0], -1)[int(j)] = np.frombuffer(r.sum)
        return out

    def gram(self) -> np.ndarray:
        d = len(self.features) + 1
        return self._sums(lambda x, y, splits: {"gram": x.T @ x}, {"gram": (d, d)})["gram"]

    def gradients(self, w: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient (features x models) and sum of squared hinges of the models
        ``active`` with weights ``w``, without C."""
        shared = self.rows.sparkSession.sparkContext.broadcast((w, active // (len(self.Cs) * self.k), active % self.k))
        classes, k = self.classes, self.k

        def work(x: np.ndarray, y: np.ndarray, splits: np.ndarray) -> dict[str, np.ndarray]:
            w, split, own = shared.value
            sign, train = signs(y, classes), splits == TRAIN
            g, loss = np.empty_like(w), np.empty((1, w.shape[1]))
            for a in range(0, w.shape[1], COLUMNS):  # in place, in pieces that stay in the processor's cache
                part = slice(a, a + COLUMNS)
                s = sign if k == 1 else sign[:, own[part]]
                slack = x @ w[:, part]
                slack *= s
                np.subtract(1.0, slack, out=slack)
                np.maximum(slack, 0.0, out=slack)
                slack *= train[:, split[part]]
                loss[0, part] = np.einsum("ij,ij->j", slack, slack)
                slack *= s
                g[:, part] = x.T @ slack
            g *= -2.0
            return {"g": g, "loss": loss}

        got = self._sums(work, {"g": w.shape, "loss": (1, w.shape[1])})
        shared.unpersist()
        return got["g"], got["loss"][0]

    def fit(self, steps: int = 200, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        """(weights, objectives) of all models.  A model is done when its objective
        has moved by less than ``tolerance`` of itself in three steps running."""
        c = np.repeat(np.tile(np.array(self.Cs), max(self.splits, 1)), self.k)
        gram = self.gram()
        w = np.zeros((len(self.features) + 1, self.models))
        v, momentum, last = w.copy(), np.ones(self.models), np.full(self.models, np.inf)
        quiet, active = np.zeros(self.models, int), np.arange(self.models)
        for _ in range(steps):
            at = v[:, active]
            g, loss = self.gradients(at, active)
            new = proximal_step(gram, at, c[active] * g, c[active])
            objective = np.abs(at).sum(0) + c[active] * loss  # where the gradient was taken
            uphill = objective > last[active] * (1 + 1e-12)
            grown = (1 + np.sqrt(1 + 4 * momentum[active] ** 2)) / 2
            push = np.where(uphill, 0.0, (momentum[active] - 1) / grown)
            moved = np.abs(last[active] - objective) / np.maximum(np.abs(objective), 1e-12)
            quiet[active] = np.where(moved < tolerance, quiet[active] + 1, 0)
            momentum[active] = np.where(uphill, 1.0, grown)
            v[:, active], w[:, active], last[active] = new + push * (new - w[:, active]), new, objective
            active = active[quiet[active] < 3]
            if not len(active):
                break
        _, loss = self.gradients(w, np.arange(self.models))
        return w, np.abs(w).sum(0) + c * loss

    def curvature(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient, sum of squared hinges and Hessian (model, feature, feature) of
        all models, without C; for few models."""
        shared = self.rows.sparkSession.sparkContext.broadcast(w)
        classes, n_c, k = self.classes, len(self.Cs), self.k

        def work(x: np.ndarray, y: np.ndarray, splits: np.ndarray) -> dict[str, np.ndarray]:
            own = np.arange(shared.value.shape[1])
            sign = signs(y, classes)[:, own % k]
            slack = np.maximum(1.0 - sign * (x @ shared.value), 0.0) * (splits == TRAIN)[:, own // (n_c * k)]
            bend = np.stack([x.T @ (x * (slack[:, m] > 0)[:, None]) for m in own])
            return {"g": -2.0 * (x.T @ (sign * slack)), "loss": (slack * slack).sum(0)[None, :], "h": 2.0 * bend}

        d = len(w)
        got = self._sums(work, {"g": w.shape, "loss": (1, w.shape[1]), "h": (w.shape[1], d, d)})
        shared.unpersist()
        return got["g"], got["loss"][0], got["h"]

    def fit_few(self, steps: int = 40, tolerance: float = 1e-7, halvings: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """(weights, objectives) of a few models by proximal Newton steps: two jobs
        a step, one for the curvature, one that tries all step lengths at once."""
        c = np.repeat(np.tile(np.array(self.Cs), max(self.splits, 1)), self.k)
        w = np.zeros((len(self.features) + 1, self.models))
        lengths = 0.5 ** np.arange(halvings)
        every = np.tile(np.arange(self.models), halvings)
        objective = np.full(self.models, np.inf)
        for _ in range(steps):
            g, loss, h = self.curvature(w)
            objective = np.abs(w).sum(0) + c * loss
            to = np.column_stack([newton_point(h[m], w[:, m], g[:, m], c[m]) for m in range(self.models)])
            trial = np.concatenate([w + t * (to - w) for t in lengths], axis=1)
            _, losses = self.gradients(trial, every)
            found = (np.abs(trial).sum(0) + np.tile(c, halvings) * losses).reshape(halvings, self.models)
            best = found.argmin(0)
            gain = objective - found[best, np.arange(self.models)]
            better = gain > 0
            w = np.where(better, trial.reshape(len(w), halvings, self.models)[:, best, np.arange(self.models)], w)
            objective = objective - np.maximum(gain, 0)
            if (gain <= tolerance * np.maximum(np.abs(objective), 1e-12)).all():
                break
        return w, objective

    def accuracies(self, w: np.ndarray) -> np.ndarray:
        """(split, C, [train, test]): the share of rows that a split's model gets right."""
        shared = self.rows.sparkSession.sparkContext.broadcast(w)
        n_c, k, classes, n_splits = len(self.Cs), self.k, np.array(self.classes), max(self.splits, 1)

        def work(x: np.ndarray, y: np.ndarray, splits: np.ndarray) -> dict[str, np.ndarray]:
            margin = (x @ shared.value).reshape(len(x), n_splits, n_c, k)
            best = (margin[..., 0] > 0).astype(int) if k == 1 else margin.argmax(-1)
            right = classes[best] == y[:, None, None]
            out = {}
            for name, kind in (("train", TRAIN), ("test", TEST)):
                inside = splits == kind
                out[name] = (right & inside[:, :, None]).sum(0)
                out[f"n_{name}"] = inside.sum(0)[:, None]
            return out

        shape = {name: (n_splits, n_c) for name in ("train", "test")} | {f"n_{name}": (n_splits, 1) for name in ("train", "test")}
        got = self._sums(work, shape)
        shared.unpersist()
        return np.stack([got[n] / np.maximum(got[f"n_{n}"], 1) for n in ("train", "test")], axis=-1)


def proximal_step(gram: np.ndarray, at: np.ndarray, gradient: np.ndarray, c: np.ndarray, sweeps: int = 8) -> np.ndarray:
    """For every model the minimum over w of
    ``gradient.(w - at) + c * (w - at)' gram (w - at) + |w|_1``, by coordinate
    descent (the curvature of ``c * sum(hinge^2)`` is at most ``2 c gram``)."""
    moved = np.zeros_like(at)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(gram)):
            if gram[j, j] <= 0:  # a feature that is zero in all rows
                moved[j] = -at[j]
                continue
            bend = 2 * c * gram[j, j]
            now = at[j] + moved[j]
            free = now - (gradient[j] + 2 * c * (gram[j] @ moved)) / bend
            new = np.sign(free) * np.maximum(np.abs(free) - 1 / bend, 0)
            most = max(most, float(np.abs(new - now).max(initial=0.0)))
            moved[j] = new - at[j]
        if most < 1e-9:
            break
    return at + moved


def newton_point(h: np.ndarray, at: np.ndarray, gradient: np.ndarray, c: float, sweeps: int = 200) -> np.ndarray:
    """The minimum over w of ``c * (g.(w - at) + (w - at)' h (w - at) / 2) + |w|_1``
    for one model, by coordinate descent."""
    h = h + 1e-9 * np.eye(len(h)) * max(float(np.trace(h)) / len(h), 1.0)
    w, moved = at.copy(), np.zeros_like(at)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            bend = c * h[j, j]
            free = w[j] - c * (gradient[j] + h[j] @ moved) / bend
            new = np.sign(free) * max(abs(free) - 1 / bend, 0.0)
            most = max(most, abs(new - w[j]))
            w[j] = new
            moved[j] = new - at[j]
        if most < 1e-8:
            break
    return w


def fit_linear(rows: DataFrame, features: list[str], label: str, classes: list[int], C: float,
               steps: int = 40, tolerance: float = 1e-7) -> LinearModel:
    """M8: one model on all rows."""
    w, objective = Problem(rows, features, label, classes, [C]).fit_few(steps, tolerance)
    return LinearModel(tuple(features), tuple(classes), tuple(tuple(float(x) for x in col) for col in w.T), float(C),
                       tuple(map(float, objective)))


def search(rows: DataFrame, features: list[str], label: str, classes: list[int], Cs=config.C_GRID,
           splits: int = config.N_SPLITS, **fit) -> np.ndarray:
    """M9: accuracies (split, C, [train, test]) of all models; ``rows`` have the column ``splits``."""
    problem = Problem(rows, features, label, classes, list(Cs), splits)
    return problem.accuracies(problem.fit(**fit)[0])
