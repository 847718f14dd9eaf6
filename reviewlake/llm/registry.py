"""What ``__spark_entry__`` registers: the operators' queries and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from .queries import QUERIES
from .sql import ORACLE

LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
LLM_ORACLE = ORACLE if corpus_pipeline.ORACLE_SQL is None else {**ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
