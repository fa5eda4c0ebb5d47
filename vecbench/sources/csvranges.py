"""CSV files with line breaks inside cells, read by many tasks a file.

Spark splits a CSV file only if no cell holds a line break. Here files are split by byte ranges at any line, and
quotes tell what a line is part of: quotes inside cells are doubled, so a line lies inside a cell if the number of quotes
before it is odd.

1. One pass counts the quotes of every range (and takes the first line of every file: its header).
2. Prefix sums over the ranges of a file say whether a range begins inside a cell: one row a range, broadcast.
3. Each range joins its lines to records where they lie, in Arrow, without a shuffle. What a range begins or ends with
   in the middle of a record is a fragment; fragments (two a range at most) are put together by file.
4. Spark's own ``from_csv`` parses the records.

Files may differ in the order and choice of their columns; a header of several lines is refused. Cells that hold a
quote but are not quoted break the count: read such files with Spark's multi-line reader.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecbench.session import cut_lineage

WHOLE, HEAD, TAIL, THROUGH = 0, 1, 2, 3
_SCHEMA = "file string, block bigint, header int, kind int, record string"
_OPTIONS = {"escape": '"', "quote": '"', "multiLine": "true"}


def _joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    """Lines joined by line feeds, a record for each of the (exclusive) ends."""
    offsets = pa.array(np.append(0, ends), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, header, value, inside) in the order of the files -> records and fragments."""
    now, inside, started, held = None, False, False, []

    def out(records: list, kinds: list[int]) -> pa.RecordBatch:
        n = len(kinds)
        file, block, header = now
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([header] * n, pa.int32()),
                                           pa.array(kinds, pa.int32()), records], ["file", "block", "header", "kind", "record"])

    def last() -> Iterator[pa.RecordBatch]:
        if held:
            yield out(_joined(pa.concat_arrays(held), np.array([sum(map(len, held))])), [TAIL if started else THROUGH])

    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        cuts = [0, *[k for k in range(1, len(files)) if blocks[k] != blocks[k - 1] or files[k] != files[k - 1]], len(files)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = (files[a], int(blocks[a]), batch.column("header")[a].as_py())
            if key != now:
                yield from last()
                now, held = key, []
                inside = bool(batch.column("inside")[a].as_py())
                started = not inside
                a += key[1] == 0  # the header
            lines = batch.column("value").slice(a, b - a)
            if a == b:
                continue
            odd = (int(inside) + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) % 2 == 1
            inside, ends = bool(odd[-1]), np.flatnonzero(~odd) + 1
            if not len(ends):
                held.append(lines)
                continue
            before = sum(map(len, held))
            records = _joined(pa.concat_arrays([*held, lines]), ends + before)
            yield out(records, [WHOLE if started else HEAD, *[WHOLE] * (len(ends) - 1)])
            started, held = True, [lines.slice(int(ends[-1]))] if ends[-1] < len(lines) else []
    yield from last()


def _fragments(records: DataFrame) -> DataFrame:
    """Records put together from the fragments of neighbouring ranges."""
    order = F.when(F.col("kind") == HEAD, 0).otherwise(1)
    w = Window.partitionBy("file").orderBy("block", "_o").rowsBetween(Window.unboundedPreceding, 0)
    numbered = records.filter(F.col("kind") != WHOLE).withColumn("_o", order) \
        .withColumn("_n", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(w))
    parts = F.sort_array(F.collect_list(F.struct("block", "_o", "record")))
    return numbered.groupBy("file", "header", "_n").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")) \
        .select("file", "header", "record")


def read_csv_ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings, and ``_path`` (the file): RFC-4180 quoting, UTF-8, cells with line breaks, empty records
    skipped, unquoted empty cells null; short records are filled with nulls. Files without a line give no rows."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # lines of a range are in order, and so is what first() sees within the task that reads it
    ranges = cut_lineage(lines.groupBy("file", "block").agg((F.sum(F.regexp_count("value", F.lit('"'))) % 2).alias("odd"), F.first("value").alias("line")))
    headers = [r.line for r in ranges.filter("block = 0").select("line").distinct().orderBy("line").collect()]
    if not headers:
        raise ValueError(f"no header in {path}")
    names = []
    for line in headers:
        if line.count('"') % 2:
            raise ValueError("a header of several lines")
        names.append(next(csv.reader([line.removeprefix("﻿").rstrip("\r")])))
    known = spark.createDataFrame(list(enumerate(headers)), "header int, line string")
    file_header = ranges.filter("block = 0").join(F.broadcast(known), "line").select("file", "header")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(ranges.withColumn("inside", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2) == 1)
                         .withColumn("cut", F.col("inside") | (F.col("odd") == 1)).join(file_header, "file")
                         .select("file", "block", "header", "inside", "cut"))

    def read(ranges: DataFrame) -> DataFrame:
        some = lines.join(F.broadcast(ranges), ["file", "block"]).select("file", "block", "header", "value", "inside")
        return some.mapInArrow(_records, _SCHEMA)

    records = read(starts).filter(F.col("kind") == WHOLE).select("file", "header", "record")
    if starts.filter("cut").limit(1).count():  # only ranges that begin or end inside a record have fragments
        records = records.unionByName(_fragments(read(starts.filter("cut"))))
    records = records.withColumn("record", F.expr("rtrim('\r', record)")).filter("record <> ''")
    parsed = None
    for k, columns in enumerate(names):
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
        own = records.filter(F.col("header") == k).select(F.from_csv("record", schema, _OPTIONS).alias("_r"), F.col("file").alias("_path"))
        own = own.select("_r.*", "_path")
        parsed = own if parsed is None else parsed.unionByName(own, allowMissingColumns=True)
    return parsed
