"""Bucketed tables with versions (S14, S15, S19): an update writes a new version
and swaps it in, readers of the old one are not disturbed.

A version is a folder of Parquet files bucketed and sorted by its keys; a
manifest entry, one small file that appears when its job commits, names the
version.  A reader takes the newest entry, so an update that dies half-way
leaves the old version in place, and its files are never looked at.  Tables
that are bucketed by the same key into the same number of buckets join and
aggregate on that key without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, folder string, schema string"


@dataclass(frozen=True)
class VersionedTable:
    """A table in ``root``, bucketed by ``key`` into ``buckets``, sorted by ``key`` and ``order``."""

    spark: SparkSession
    root: str
    key: str
    buckets: int
    order: tuple[str, ...] = ()

    def version(self) -> tuple[int, str, str] | None:
        """(number, folder, schema) of the newest version that was committed."""
        try:
            entries = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/*")
        except AnalysisException:  # no entry yet
            return None
        row = entries.orderBy(F.desc("version")).first()
        return None if row is None else (row.version, row.folder, row.schema)

    def read(self) -> DataFrame:
        """The newest version, known to Spark as bucketed and sorted."""
        newest = self.version()
        if newest is None:
            raise ValueError(f"{self.root} has no version yet")
        _, folder, schema = newest
        name = f"versioned_{uuid.uuid4().hex}"
        sort = ", ".join(f"`{c}`" for c in (self.key, *self.order))
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY ({sort}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'")
        return self.spark.table(name)

    def replace(self, rows: DataFrame) -> int:
        """Write ``rows`` as the next version and swap it in; its number."""
        newest = self.version()
        number = 1 if newest is None else newest[0] + 1
        folder, name = f"data/{number}-{uuid.uuid4().hex[:8]}", f"writing_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, self.key).write.format("parquet")
         .bucketBy(self.buckets, self.key).sortBy(self.key, *self.order)
         .option("path", f"{self.root}/{folder}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # the files of a table with a path of its own stay
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        # one entry per number: of two writers the second one fails here and swaps nothing in
        (self.spark.createDataFrame([(number, folder, schema)], MANIFEST).coalesce(1)
         .write.mode("errorifexists").json(f"{self.root}/manifest/{number:012d}"))
        return number

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the table by ``change`` of its newest version."""
        return self.replace(change(self.read()))
