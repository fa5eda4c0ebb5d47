"""Token ids in ORC files (operator 6).

Integer run-length encoding holds the ids, row indexes and a Bloom filter on doc_id serve look-ups, and
files split at stripes, so many tasks read one file. Documents are written in ascending doc_id order:
range partitions in the order of their files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.llm.common import binary, settle
from vecbench.llm.tokens import crc32_of, encoder

ROWS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd",
}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids = []
                for own in enc.many(binary(some.column(1))):
                    ids += [own, np.array([end_id], np.uint32)]
                lengths = np.array([len(a) + 1 for a in ids[::2]], np.int64)
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(lengths), part, np.int32)), pa.array(done + ends - lengths), pa.array(lengths), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"])
                done += int(ends[-1])
    return run


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> None:
    """Write the ids of every text (null: empty), then ``end_id``, in ascending (doc_id, text hash) order;
    null doc_ids come first. ``folder`` must be new. Further columns are ignored."""
    text = F.col("text").cast("string")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie") \
        .select("doc_id", "text").mapInArrow(_encode(vocabulary, end_id), ROWS).write.options(**OPTIONS).orc(folder)


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids`` only theirs, whose stripes metadata and Bloom filters select."""
    rows = spark.read.schema(ROWS).orc(folder)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        crc = [crc32_of(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                                         ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: start counts all ids before
    it in the order of the files. An empty folder of files gives an empty result."""
    rows = settle(read_token_files(spark, folder).select("doc_id", "part", "local_start", "ids")
                  .mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"), "digests")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids")).collect()  # one row a file's partition
    before, total = [], 0
    for r in sorted(totals, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["ids"]
    starts = spark.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
