"""Sources/sinks on tiny files (S9, S11, S13, S17) and stream = batch."""
import json
import os

import pytest
from pyspark.sql import functions as F

from reviewlake.sources import io
from reviewlake.streaming.increments import keyed_batch, preprocess_batch, scratch, stream_dedupe, write_batch


def test_labeled_dirs(spark, tmp_path):
    root = str(tmp_path)
    data = {("train", "pos"): [(0, 9, "Great<br /><br />film", "tt1"), (3, 7, "Fine", "tt2")],
            ("test", "neg"): [(1, 2, "Bad", "tt3")]}
    for (split, pol), rs in data.items():
        os.makedirs(f"{root}/{split}/{pol}")
        with open(f"{root}/{split}/urls_{pol}.txt", "w") as u:
            for n, rating, text, tid in sorted(rs):
                with open(f"{root}/{split}/{pol}/{n}_{rating}.txt", "w") as f:
                    f.write(text)
                u.write(f"http://www.example.com/title/{tid}/usercomments\n")
    got = {(r.title_id, r.text, r.rating, r.usage) for r in io.read_labeled_dirs(spark, root).collect()}
    assert got == {("tt1", "Great\nfilm", 9, "train"), ("tt2", "Fine", 7, "train"), ("tt3", "Bad", 2, "test")}


def test_annotations_roundtrip(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"id": 5, "text": "The plot.", "rating": 8, "aspect": [[4, 8, "plot", "the plot.", 0]],
                            "label": [[4, 8, "positive"]]}) + "\n")
    df = io.read_annotations(spark, p)
    r = df.collect()[0]
    assert r.aspect[0] == ["4", "8", "plot", "the plot.", "0"] and r.label[0][2] == "positive"


def test_features_tsv_with_comment_header(spark, tmp_path):
    p = tmp_path / "inputs.tsv"
    p.write_text("#SVC model inputs\n#multi-class C:0.5\n#binary C:1.0\nid\tclass\tx\n1\t3\t0.5\n")
    df, Cs = io.read_features(spark, str(p))
    assert df.columns == ["id", "class", "x"] and df.count() == 1
    assert Cs == {"class": 0.5, "binary_class": 1.0}


def test_model_file_of_many_parts(spark, tmp_path):
    rows = [(k, k % 5 + 1, k % 2, k / 3, 7 * k, None if k == 4 else 0.1) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, class int, binary_class int, x_mean double, Story_negative long, None_mean double")
    path = str(tmp_path / "inputs")
    io.write_features(df.repartition(4), path, {"class": 0.12, "binary_class": 21.0})
    back, Cs = io.read_features(spark, path)
    assert Cs == {"class": 0.12, "binary_class": 21.0} and back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    part = next(x for x in (tmp_path / "inputs").glob("part-*"))
    lines = part.read_text().splitlines()
    assert lines[:3] == ["#SVC model inputs", "#multi-class C:0.12", "#binary C:21.0"]
    io.write_features(df, str(tmp_path / "other"), {"class": 5.0, "binary_class": 21.0})
    with pytest.raises(ValueError):
        io.read_features(spark, str(tmp_path / "{inputs,other}"))


def test_html_extraction(spark):
    html = ('<h3 class="ipc-title__text">Good</h3><div class="ipc-html-content-inner-div">Nice<br/>film</div>'
            '<span class="ipc-rating-star--rating">8</span><h3 class="ipc-title__text">Orphan</h3>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = io.extract_reviews_from_html(df).collect()
    assert [(r.text, r.rating) for r in rows] == [("Good\nNice\nfilm", "8")]


def test_stream_dedupe_equals_batch(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string")
    src = scratch(spark, "t-in")
    rows.write.parquet(src + "/x")
    rows.write.parquet(src + "/y")
    out = stream_dedupe(spark, src + "/*", scratch(spark, "t-out"), ["k", "v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")]


def test_stream_preprocess_equals_batch(spark, pipeline):
    """The real job: same sentences as in one batch, ids unique across micro-batches."""
    from reviewlake.plans.catalog import QUERIES
    cols = ["review_id", "sentence", "compound"]
    out = QUERIES["stream_preprocess"](pipeline)
    batch = QUERIES["preprocess_all"](pipeline)
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    ids = [r.id for r in out.select("id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_retried_batch_changes_nothing(spark):
    out = scratch(spark, "retry")
    keys = ["k"]
    frames = [spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b"), (2, "a")], [(2, "x"), (3, "c")])]
    step = keyed_batch(spark, out, lambda b: b, keys)
    want = {0: [(1, "a"), (2, "a")], 1: [(1, "a"), (2, "a"), (3, "c")]}
    newest = -1
    for batch_id in (0, 1, 1, 0, 1):
        step(frames[batch_id], batch_id)
        newest = max(newest, batch_id)
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == want[newest]
    ids = scratch(spark, "retry-ids")
    number = preprocess_batch(spark, ids, lambda b, start: b.selectExpr(f"k + {start} - 1 AS id"))
    one = spark.createDataFrame([(1,), (2,)], "k int")
    for batch_id in (0, 1, 1):
        write_batch(one, batch_id, ids, number)
    assert sorted(r.id for r in spark.read.parquet(ids).collect()) == [1, 2, 3, 4]


def test_a_batch_reads_only_its_own_rows(spark):
    """Keys that are stored are looked up in the state: the dedupe reads the new files, not the history."""
    import json as js
    out = scratch(spark, "growth")
    step = keyed_batch(spark, out, lambda b: b, ["k"])
    for batch_id in range(4):
        step(spark.range(100 * batch_id - 20 * (batch_id > 0), 100 * batch_id + 100).selectExpr("id AS k"), batch_id)
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 400
    sizes = []
    for batch_id in range(4):
        seen = [js.loads(x) for x in open(f"{out}_state/sources/0/{batch_id}".replace("file:", "")) if x.startswith("{")]
        sizes.append({os.path.basename(os.path.dirname(f["path"])) for f in seen})
    assert sizes == [{f"batch%3D{k}"} for k in range(4)] or sizes == [{f"batch={k}"} for k in range(4)]


def test_quoted_csv_in_many_splits(spark, tmp_path):
    """One file in many splits, which fall into quoted texts, against Python's csv module."""
    import csv
    import random
    rnd = random.Random(8)
    bits = ["word", 'a "quoted" bit', "line\nend", "\r\n", ",", "", '""', "é😀", "\n\n", "tail "]
    rows = [[f"tt{k}", "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) + "x", str(k % 10 + 1)] for k in range(3000)]
    folder = tmp_path / "reviews"
    folder.mkdir()
    for name, part in (("a", rows[:2500]), ("b", rows[2500:])):
        with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\r\n" if name == "b" else "\n").writerows([["title_id", "reviewText", "rating"], *part])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        assert spark.read.text(str(folder / "a.csv")).rdd.getNumPartitions() > 8
        got = io.read_reviews(spark, str(folder))
        assert sorted((r.title_id, r.text, r.rating, r.usage) for r in got.collect()) == sorted(
            (a, b, int(c), "") for a, b, c in rows)
    finally:
        spark.conf.set(key, before)
    (tmp_path / "bare.csv").write_text("title_id,rating\ntt1,4\n")
    with pytest.raises(ValueError):
        io.read_reviews(spark, str(tmp_path / "bare.csv"))


def test_terms_csv_with_bom(spark, tmp_path):
    p = tmp_path / "terms.csv"
    p.write_bytes("\ufeffaspect_id,POS,term\r\n1,n,audio\r\n6,n,actor\r\n6,n,actor\r\n".encode("utf-8"))
    df = io.read_terms(spark, str(p))
    assert [tuple(r) for r in df.collect()] == [(1, "n", "audio"), (6, "n", "actor"), (6, "n", "actor")]


def test_write_annotation_tasks(spark, tmp_path):
    df = spark.createDataFrame([(1, "The plot.", 7, [["4", "8", "plot", "the plot.", "0"]], [["4", "8", "candidate"]])],
                               io.ANNOTATION_SCHEMA)
    out = str(tmp_path / "tasks")
    io.write_annotation_tasks(df, out)
    back = io.read_annotations(spark, out)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_batches_of_one_file_are_dealt_out(spark, pipeline, monkeypatch):
    from reviewlake.operators import aspects
    from reviewlake.plans import catalog
    from reviewlake.streaming import increments
    parts = []

    def one_batch(spark, src, out, work, *rest):
        batch = spark.read.parquet(src).coalesce(1)
        return work(batch, 1) if work.__name__ == "preprocess_fn" or not rest else work(batch)

    monkeypatch.setattr(increments, "stream_preprocess", one_batch)
    monkeypatch.setattr(increments, "stream_predict", one_batch)
    monkeypatch.setattr(pipeline, "preprocess", lambda b, start: parts.append(b.rdd.getNumPartitions()) or b)
    whole = aspects.aspect_spans
    monkeypatch.setattr(aspects, "aspect_spans", lambda b, *a, **k: parts.append(b.rdd.getNumPartitions()) or whole(b, *a, **k))
    catalog.QUERIES["stream_preprocess"](pipeline)
    catalog.QUERIES["stream_predict"](pipeline)
    assert len(parts) == 2 and min(parts) > 1
