"""Contrastive pairs and the learnt metric of the few-shot model's first stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import fewshot
from reviewlake.operators.features import evaluate
from reviewlake.operators.learn import train_label_head


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(5)
    n, rows = 200, []  # few rows, many dimensions that say nothing: where a head alone overfits
    centre = rnd.normal(0, 2, (4, 3))
    for k in range(n):
        label = int(rnd.choice(4, p=[0.4, 0.25, 0.2, 0.15]))
        signal = centre[label] + rnd.normal(0, 0.5, 3)
        rows.append((k, label, [*map(float, np.concatenate([signal, rnd.normal(0, 12, 60)]))]))
    return spark.createDataFrame([(k, x, y) for k, y, x in rows], "id long, features array<double>, label int").cache()


def test_pairs(spark, data):
    label = {r.id: r.label for r in data.collect()}
    pairs = [tuple(r) for r in fewshot.contrastive_pairs(data, 4).collect()]
    assert len(pairs) == len(set(pairs)) <= 8 * len(label)
    assert all(a < b and (label[a] == label[b]) == s for a, b, s in pairs)
    assert {x for a, b, s in pairs if s for x in (a, b)} == set(label)  # every row has a partner of its own
    over = [tuple(r) for r in fewshot.contrastive_pairs(data, 4, "oversampling").collect()]
    n = [sum(s == k for *_, s in over) for k in (True, False)]
    assert set(over) == set(pairs) and abs(n[0] - n[1]) < 0.1 * max(n)
    with pytest.raises(ValueError):
        fewshot.contrastive_pairs(data, 4, "all")


def test_pairs_grow_with_the_rows(spark):
    one = spark.range(3000).select("id", F.lit(1).alias("label"))
    assert fewshot.contrastive_pairs(one, 2).count() <= 6000
    assert fewshot.contrastive_pairs(one.limit(1), 2).count() == 0 and fewshot.contrastive_pairs(one.limit(0), 2).count() == 0


def test_metric_helps_the_head(spark, data):
    train = data.where(F.pmod(F.xxhash64("id", F.lit(42)), F.lit(5)) != 0)  # the head's own split
    pairs = fewshot.contrastive_pairs(train, 8, "oversampling")
    metric = fewshot.learn_metric(train, pairs, out_dim=4)
    assert metric.shape == (63, 4)
    assert np.abs(metric[:3]).mean() > 5 * np.abs(metric[3:]).mean()  # the three dimensions that tell labels apart
    score = {}
    for name, rows in (("head", data), ("both", fewshot.apply_metric(data, metric))):
        _, pred = train_label_head(rows.select(F.col("id").alias("vec_id"), F.col("features").alias("embedding"), "label"))
        score[name] = evaluate(pred.select("label", "prediction")).first().balanced_accuracy
    assert score["both"] > score["head"], score
    with pytest.raises(ValueError):
        fewshot.learn_metric(train, pairs.where("similar"))
