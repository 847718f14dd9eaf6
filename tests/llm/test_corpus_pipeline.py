"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as cp
from reviewlake.llm import decontaminate, ngram_join, quality
from reviewlake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark, tokenizer):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kinds = [8, 6, 5, 1, 3]
    assert len(cp.STAGES) == len(kinds)
    for n, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, SF), "test-stage")
        if n < 4:
            assert out.columns == columns, name
        after = {r.doc_id: r for r in out.collect()}
        if n == 0:
            assert set(after) == {i for i, r in before.items() if quality.judge(r.text, quality.LineRules())[0][6]}
        elif n == 1:
            from test_search import brute_links
            rows = [(i, r.text) for i, r in before.items()]
            assert set(after) == {c for _, c, _, _ in brute_links(rows)}
            assert all(after[i] == before[i] for i in after)
        elif n == 2:
            items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            held = [b" ".join(decontaminate.words_of(t)) for _, t in items if len(decontaminate.words_of(t)) > 4]
            leaky = {i for i, r in before.items() if any(b" " + h + b" " in b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for h in held)}
            assert set(after) == set(before) - leaky
        elif n == 3:
            from test_models import plain
            assert set(after) == set(before) and not any(plain(r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        docs = out
    total = sum(r.n_tokens for r in docs.collect())
    assert cp.run(spark, SF).agg({"n_tokens": "sum"}).first()[0] == total
    assert ngram_join.Join().threshold == 0.8


def test_edge_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""
    import random
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n)) + "."
    first, second, long = prose(80), prose(90), "\n".join(prose(40) for _ in range(800))
    rows = [(1, first, "en"), (1, first, "en"), (2, first, None), (3, second, "fr"), (4, None, "en"), (5, "", "en"),
            (6, " \n\t", "en"), (7, long, "en"), (None, prose(70), None), (8, f"{prose(60)} Mail a.b@example.com now.", "en")]
    schema = "doc_id long, text string, lang string"
    extra = ("class_id long", "root string", "packed binary", "n_tokens long", "part long", "part_ string")
    columns = [f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in extra]
    sf = str(tmp_path)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    for name, data in (("some", rows), ("none", [])):
        folder = f"{sf}/{name}"
        docs = spark.createDataFrame(data, schema).selectExpr("*", "'s' AS source", "length(text) AS n_chars", *columns)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    at = table(spark, f"{sf}/some", "documents")
    names = at.columns
    for name, stage in cp.STAGES[:-1]:
        at = written(stage(spark, at, f"{sf}/some"), "edge-stage")
        assert at.columns == names, name
    kept = {r.doc_id: r.text for r in at.collect()}
    assert at.count() == len(kept) and set(kept) == {1, 3, 7, None, 8}
    assert kept[7] == long and "example.com" not in kept[8]
    out = cp.run(spark, f"{sf}/some")
    assert {r.doc_id for r in out.collect()} == set(kept)
    assert cp.run(spark, f"{sf}/none").count() == 0
