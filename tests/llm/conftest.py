import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid string, part long, path string"


def frame(spark, rows):
    """Documents from (doc_id, text), with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, "p") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture
def documents(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
