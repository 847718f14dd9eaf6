"""End-to-end and property tests on the sf0.001 fixture."""
import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewlake.operators.features import feature_names
from reviewlake.operators.upsert import insert_ignore
from reviewlake.plans.strategy import grouped_prefix_sum


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    flags, counts, means = feature_names(["Other", "Audio", "Effects", "Scene", "Story", "Direction", "Cast",
                                          "Message", "Emotion", "Comparison", "General", "Overall", "Audience"])
    assert df.columns == ["id", "class", "binary_class"] + flags + ["mean_review_polarity"] + counts + means
    assert len(df.columns) == 89


def test_counts_sum_to_joined_rows(pipeline):
    f = pipeline.features()
    cnt = [c for c in f.columns if c.endswith(("_negative", "_neutral", "_positive", "None_none"))]
    per_review = f.select("id", sum(F.col(c) for c in cnt).alias("n")).collect()
    sa = pipeline.sentence_aspect.where("verified = 0").groupBy("sentence_id").count()
    s = pipeline.polarity.join(sa.withColumnRenamed("sentence_id", "id"), "id", "left") \
        .groupBy("review_id").agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"))
    exp = {r.review_id: r.n for r in s.collect()}
    assert {r.id: r.n for r in per_review} == exp


def test_sentence_ids_dense(pipeline):
    ids = sorted(r.id for r in pipeline.sentences.select("id").collect())
    assert ids == list(range(1, len(ids) + 1))


def test_prefix_sum_matches_python(spark):
    rows = [(g, k, v) for g in range(3) for k, v in zip(range(0, 50000, 37), range(2000))]
    df = spark.createDataFrame(rows, "g int, k long, v long")
    got = {(r.g, r.k): r.s for r in grouped_prefix_sum(df, ["g"], "k", "v", "s").collect()}
    run = {}
    for g, k, v in sorted(rows):
        run[g] = run.get(g, 0) + v
        assert got[(g, k)] == run[g]


def test_insert_ignore_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    inc = spark.createDataFrame([(1, "x"), (2, "b"), (2, "c")], "k int, v string")
    once = insert_ignore(t, inc, ["k"], order_by=["v"])
    twice = insert_ignore(once, inc, ["k"], order_by=["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b")]


def test_polarity_scores_in_range(pipeline):
    for r in pipeline.polarity.select("polNeg", "polNeu", "polPos", "polComp").collect():
        assert -1 <= r.polComp <= 1
        s = r.polNeg + r.polNeu + r.polPos
        assert s == 0 or math.isclose(s, 1.0, abs_tol=0.0021)


def test_preprocessed_features_equal_sql(spark, pipeline, tmp_path, monkeypatch):
    """X16 -> polarity -> spans -> aspect rows -> features, against SQL over the stored sentence table."""
    import duckdb

    from reviewlake.plans import oracle as O
    from reviewlake.plans.catalog import QUERIES

    path = str(tmp_path / "sentences")
    pipeline.preprocessed.selectExpr("id", "review_id", "0 AS pos", "sentence").write.parquet(path)
    monkeypatch.setitem(O.CTE, "ox_sentence", f"SELECT id, review_id, pos, sentence FROM read_parquet('{path}/*.parquet')")
    monkeypatch.setitem(O.CTE, "ox_sa", O.CTE["ox_sa"].replace("CASE WHEN s.sentence_id % 3 = 0 THEN 1 ELSE 0 END", "0"))
    con = duckdb.connect()
    for t in ("part", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{pipeline.fx.sf_dir}/{t}.parquet')")
    res = con.execute(O.build(O.features_select()))
    names = [d[0] for d in res.description]
    want = {r[names.index("id")]: dict(zip(names, r, strict=True)) for r in res.fetchall()}
    got = {r.id: r.asDict() for r in QUERIES["preprocessed_features"](pipeline).collect()}
    assert set(got) == set(want) and len(got) > 10
    for i, row in got.items():
        for c, v in row.items():
            assert abs(v - want[i][c]) < 2e-6, (i, c, v, want[i][c])
