"""M6, first stage: a linear metric learnt from contrastive pairs of labelled vectors.

``contrastive_pairs`` meets every row with a few others of its own label
(similar) and of other labels (dissimilar), by seeded places inside the
labels: pairs grow with the rows, never with their square.  ``unique`` keeps each
pair once; ``oversampling`` repeats the rarer kind until both are as many.

``learn_metric`` sums the outer products of the pairs' differences, one matrix
for similar and one for dissimilar pairs (one job, map-side sums; their size is
dimensions squared), and takes the directions in which dissimilar pairs lie far
apart compared with similar ones.  ``apply_metric`` maps vectors; the second
stage (``learn.train_label_head``) fits its head on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import config
from reviewlake.plans.strategy import grouped_prefix_sum
from reviewlake.session import stage_table


def contrastive_pairs(rows: DataFrame, per_row: int = 4, strategy: str = "unique", key: str = "id", label: str = "label",
                      seed: int = config.SEED) -> DataFrame:
    """(a, b, similar): ids of pairs; ``a < b``, so a pair has one form."""
    if strategy not in ("unique", "oversampling"):
        raise ValueError(f"unknown strategy {strategy}")
    known = rows.select(F.col(key).alias("id"), F.col(label).alias("label")).where(F.col("label").isNotNull())
    mixed = known.withColumns({"mix": F.xxhash64("id", F.lit(seed)), "one": F.lit(1).cast("long")})
    within = grouped_prefix_sum(mixed, ["label"], "mix", "one", "place", tie=["id"], inclusive=False)
    overall = stage_table(grouped_prefix_sum(within, [], "mix", "one", "rank", tie=["id"], inclusive=False))
    sizes = overall.groupBy("label").agg(F.count("*").alias("size"))
    total = overall.count()
    draws = overall.join(sizes, "label").select("id", "label", "place", "size", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("k"))
    shift = F.pmod(F.xxhash64("id", "k", F.lit(seed + 1)), F.greatest(F.col("size") - 1, F.lit(1))) + 1
    same = draws.where("size > 1").select("id", "label", F.pmod(F.col("place") + shift, F.col("size")).alias("place")) \
        .join(overall.select("label", "place", F.col("id").alias("other")), ["label", "place"]) \
        .select("id", "other", F.lit(True).alias("similar"))
    target = F.pmod(F.xxhash64("id", "k", F.lit(seed + 2)), F.lit(max(total, 1)))
    different = draws.select("id", F.col("label").alias("mine"), target.alias("rank")) \
        .join(overall.select("rank", "label", F.col("id").alias("other")), "rank").where("mine <> label") \
        .select("id", "other", F.lit(False).alias("similar"))
    pairs = same.unionByName(different).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similar")
    pairs = stage_table(pairs.where("a <> b").distinct())
    if strategy == "unique":
        return pairs
    n = {r.similar: r["n"] for r in pairs.groupBy("similar").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return pairs
    rare, most, least = min(n, key=n.get), max(n.values()), min(n.values())
    # each pair of the rarer kind most // least times, and a seeded share of them once more
    extra = (F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1_000_000)) < round((most % least) / least * 1_000_000)).cast("int")
    copies = F.when(F.col("similar") == rare, F.lit(most // least) + extra).otherwise(F.lit(1))
    return pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def learn_metric(rows: DataFrame, pairs: DataFrame, out_dim: int | None = None, key: str = "id", vector: str = "features",
                 ridge: float = 0.1) -> np.ndarray:
    """A matrix (dimensions x out_dim) that brings similar pairs together and dissimilar ones apart."""
    v = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a") \
        .join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").select("similar", "va", "vb")
    schema = "similar boolean, n long, sum binary"

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            similar = np.asarray(b.column("similar").to_pylist(), bool)
            d = (np.asarray(b.column("va").flatten()) - np.asarray(b.column("vb").flatten())).reshape(b.num_rows, -1)
            kinds = [k for k in (True, False) if (similar == k).any()]
            sums = [(d[similar == k].T @ d[similar == k]).tobytes() for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([int((similar == k).sum()) for k in kinds]),
                                              pa.array(sums, pa.binary())], ["similar", "n", "sum"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in group.column("sum")], axis=0)
        return pa.table({"similar": group.column("similar")[:1], "n": pa.array([sum(group.column("n").to_pylist())]),
                         "sum": pa.array([total.tobytes()], pa.binary())})

    found = {r.similar: np.frombuffer(r.sum) / r.n for r in
             both.mapInArrow(scatter, schema).groupBy("similar").applyInArrow(add, schema).collect()}
    if len(found) < 2:
        raise ValueError("pairs of both kinds are needed")
    near, far = (found[k].reshape(int(round(len(found[k]) ** 0.5)), -1) for k in (True, False))
    own = np.maximum(np.diag(near), 1e-12 * max(float(np.trace(near)), 1e-12))
    near = (1 - ridge) * near + ridge * np.diag(own)  # towards independent dimensions, each at its own scale
    values, vectors = np.linalg.eigh(near)
    whiten = vectors / np.sqrt(values)
    spread, turned = np.linalg.eigh(whiten.T @ far @ whiten)
    best = np.argsort(-spread)[:out_dim or len(spread)]
    return whiten @ turned[:, best] * np.sqrt(np.maximum(spread[best], 0))


def apply_metric(rows: DataFrame, metric: np.ndarray, vector: str = "features") -> DataFrame:
    """Rows with their vector mapped (array<double>)."""
    shared = rows.sparkSession.sparkContext.broadcast(metric)
    at = rows.columns.index(vector)
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(vector).flatten(), float).reshape(b.num_rows, -1) @ shared.value if b.num_rows else np.zeros((0, 1))
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)[:b.num_rows + 1])
            mapped = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([mapped if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return rows.mapInArrow(run, schema)
