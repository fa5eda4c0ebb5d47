"""Sharding by a Feistel permutation of global row numbers (operator 4).

Rows are numbered in the order of (doc_id, size, text CRC-32). A keyed Feistel network over the smallest
even number of bits that holds the numbers, walked along its cycle until it falls below the number of
rows, permutes the numbers 0 to n - 1. The permuted number alone gives the place: shard = number mod
shards, slot = number div shards. So the shuffle is reproducible from the key, any row's place can be
computed without the others, and shard counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import mixed, settle

ROUNDS = 6
LOCAL_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Feistel permutation with cycle walking of ``numbers`` (each in 0 to n - 1) onto 0 to n - 1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & low)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while len(at := np.flatnonzero(out >= np.uint64(n))):
        out[at] = once(out[at])
    return out.astype(np.int64)


def _places(n: int, shards: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(zero_copy_only=False), n, key)
            columns = [*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard", "slot"])
    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the global row_number of every row."""
    order = ["doc_id", "size", "text_crc32"]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32")), "sizes")
    # ranges end within equal doc_ids too: equal rows are dealt by a hash of where they stand
    place = F.xxhash64(F.monotonically_increasing_id())
    ranges = rows.withColumn("place", place).repartitionByRange(*order, "place").sortWithinPartitions(*order).drop("place")
    sorted_rows = settle(ranges.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", LOCAL_BITS)
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()  # one row a partition
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["rows"]
    starts = docs.sparkSession.createDataFrame(before, "part long, before long")
    return sorted_rows.withColumn("part", part).join(F.broadcast(starts), "part") \
        .select(*order, (F.col("before") + F.col("at").bitwiseAND((1 << LOCAL_BITS) - 1)).alias("row_number"))


def shards_by_rows(docs: DataFrame, shards: int = 16, key: int = 2024) -> DataFrame:
    """One row a row of ``docs``: doc_id, size, text_crc32, row_number, shard, slot.

    The law is ``rows``: shard counts differ by one at most, slots of a shard are 0, 1, 2, ... without
    a gap. Null text has size 1 and CRC-32 0; null doc_ids come first in the numbering, equal rows follow
    each other. Further columns are ignored; an empty table gives an empty result.
    """
    rows = settle(numbered(docs), "numbers")
    n = rows.count()
    return rows.mapInArrow(_places(n, shards, key), "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
