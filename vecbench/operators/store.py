"""Embedding store (S7): vectors by content key, in buckets, so that look-ups never reshuffle what is stored.

A store is a folder of generations, ``gen=<n>``; each is a bucketed Parquet table (hash of the content key, ``buckets``
of them). Rows are appended to the newest complete generation with one file a bucket; ``compact`` writes the next one with
one sorted file a bucket and no repeated key, and readers switch to it once Spark has marked it complete. Joins and the
search for missing keys shuffle the new rows alone to the buckets; the stored side is read where it lies.

The number of buckets belongs to the generation (it is kept in its folder's name), so it can be raised by ``compact`` as
the store grows: a bucket should stay within a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "content_key"


class VectorStore:
    """Vectors (``columns``: name -> SQL type) by ``content_key`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str] | Sequence[str], buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.columns = columns if isinstance(columns, dict) else dict.fromkeys(columns, "array<double>")

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[tuple[int, int]]:
        """(generation, buckets) of the complete generations, oldest first."""
        pattern, fs = self._hadoop(f"{self.path}/gen=*-buckets=*/_SUCCESS")
        names = [s.getPath().getParent().getName() for s in fs.globStatus(pattern) or []]
        return sorted((int(n.split("-")[0][4:]), int(n.split("=")[-1])) for n in names)

    def _table(self, generation: int, buckets: int) -> str:
        """The generation as a table of the session's catalog (its name comes from the folder)."""
        folder = f"{self.path}/gen={generation}-buckets={buckets}"
        name = "vectors_" + hashlib.md5(f"{folder} {self.columns}".encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{c}` {t}" for c, t in self.columns.items())
            location = folder.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({KEY} string, {columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                           f"INTO {buckets} BUCKETS LOCATION '{location}'")
        return name

    def read(self) -> DataFrame | None:
        """Stored rows, one a key; None before the first append."""
        found = self.generations()
        if not found:
            return None
        name = self._table(*found[-1])
        self.spark.catalog.refreshTable(name)
        # two runs at once may store a key twice; the buckets hold all of a key, so this needs no exchange
        return self.spark.table(name).dropDuplicates([KEY])

    def _write(self, rows: DataFrame, generation: int, buckets: int) -> None:
        rows.select(KEY, *[F.col(c).cast(t).alias(c) for c, t in self.columns.items()]).repartition(buckets, KEY) \
            .write.insertInto(self._table(generation, buckets))

    def append(self, rows: DataFrame) -> None:
        """Add rows (content_key and the columns); a run that dies before its commit adds nothing."""
        found = self.generations()
        self._write(rows, *(found[-1] if found else (1, self.buckets)))

    def missing(self, keyed: DataFrame) -> DataFrame:
        """Rows whose content key is not stored (``left_anti``)."""
        stored = self.read()
        return keyed if stored is None else keyed.join(stored.select(KEY), KEY, "left_anti")

    def compact(self, buckets: int | None = None) -> None:
        """Write the next generation: one sorted file a bucket, each key once. Older ones stay for readers that are at work;
        ``drop_old`` removes them."""
        found = self.generations()
        if found:
            self._write(self.read(), found[-1][0] + 1, buckets or found[-1][1])

    def drop_old(self) -> None:
        for generation, buckets in self.generations()[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(generation, buckets)}")
            path, fs = self._hadoop(f"{self.path}/gen={generation}-buckets={buckets}")
            fs.delete(path, True)
