"""Second-stage re-ranking.

First-stage hits keep their ``top_k`` best; each kept pair is re-scored with the inner product of second-stage vectors
and re-ranked per query. A small job is one block: a query travels once, with the list of its items (at most ``top_k``), and
an item's vector once to each block that lists it; a block is scored in Arrow, where both sides meet by a cogroup.

Larger jobs are cut in tiles, since a block lists mostly different items, so that nearly each pair would send a vector.
Queries are dealt to R tiles and items to C tiles by their id, and each pair of tiles is one task: query vectors travel C
times, item vectors R times and a pair of ids once, to the task that holds both its vectors; the first stage is read once.
Tiles hold a bounded number of bytes, and a task a bounded number of pairs, on average. A task sends the ``keep`` best of a
query; with several item tiles a window takes the best of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbench.operators.blocks import _dense, pack_tiles, tile_of
from vecbench.operators.search import SCORE_DIGITS, table_stats

#: Bytes of item vectors that the queries of a block list at most, about.
BLOCK_BYTES = 64 << 20
#: Bytes of vectors in a tile, pairs in a task, rows in a block, and pairs scored at a time, at most, about.
TILE_BYTES = 64 << 20
TASK_PAIRS = 2 << 20
BLOCK_ROWS = 4096
PAIR_CHUNK = 2048
SCHEMA = "query_row bigint, rank int, item_row bigint, score double"
ITEMS, QUERIES, PAIRS = range(3)


def _score_block(keep: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("items").combine_chunks()
        q, has_q, _ = _dense(left.column("v"))
        c, has_c, _ = _dense(right.column("v"))
        items = right.column("item_row").to_numpy()
        order = np.argsort(items, kind="stable")
        row = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        item = lists.flatten().to_numpy()
        place = np.searchsorted(items[order], item)
        known = (place < len(items)) & (items[order][np.minimum(place, max(0, len(items) - 1))] == item) if len(items) else np.zeros(len(item), bool)
        row, item, at = row[known], item[known], order[place[known]]
        both = has_q[row] & has_c[at]
        row, item, at = row[both], item[both], at[both]
        if len(row) and q.shape[1] != c.shape[1]:
            raise ValueError("query and item vectors differ in length")
        score = np.einsum("ij,ij->i", q[row], c[at]) if len(row) else np.empty(0)
        best = np.lexsort((item, -np.round(score, SCORE_DIGITS), row))
        row, item, score = row[best], item[best], score[best]
        count = np.bincount(row, minlength=len(q))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
        top = rank <= keep
        return pa.table({"query_row": left.column("query_row").to_numpy()[row[top]], "rank": rank[top].astype(np.int32),
                         "item_row": item[top], "score": score[top]})
    return run


def _pack_pairs(r: int, c: int):
    def run(batches):
        for b in batches:
            q, i = (np.asarray(b.column(x).to_numpy(zero_copy_only=False), np.int64) for x in ("query_row", "item_row"))
            part = tile_of(q, r) * c + tile_of(i, c)
            order = np.argsort(part, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(at):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part[at[0]]], pa.int32()), "kind": pa.array([PAIRS], pa.int32()), "n": pa.array([len(at)], pa.int32()),
                                                      "ids": pa.array([q[at].tobytes()]), "v": pa.array([i[at].tobytes()]), "has": pa.array([b""]), "wide": pa.array([True])})
    return run


def _vectors(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, vectors) of blocks; rows of one id in the order of their vectors, in whatever order the blocks came."""
    blocks = [(ids[has], v[has]) for ids, v, has in blocks if has.any()]
    if not blocks:
        return np.empty(0, np.int64), np.zeros((0, 0))
    if len({v.shape[1] for _, v in blocks}) > 1:
        raise ValueError("vectors of one side must share one dimension (validate first)")
    ids, v = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda j: (ids[j], v[j].tobytes())))
    return ids[order], v[order]


def _scored(queries: list[tuple], items: list[tuple], pairs: list[tuple], keep: int) -> Iterator[pa.RecordBatch]:
    """The ``keep`` best pairs of every query row; pairs without a vector on both sides are dropped."""
    (qids, q), (cids, c) = _vectors(queries), _vectors(items)
    if not pairs or not len(qids) or not len(cids):
        return
    if q.shape[1] != c.shape[1]:
        raise ValueError("query and item vectors differ in length")
    query, item = (np.concatenate(x) for x in zip(*pairs, strict=True))
    at = np.searchsorted(cids, item)
    known = cids[np.minimum(at, len(cids) - 1)] == item
    query, item, at = query[known], item[known], at[known]
    lo, hi = np.searchsorted(qids, query, "left"), np.searchsorted(qids, query, "right")
    again = hi - lo  # query rows of this id: 1, if ids are distinct
    row = np.repeat(lo, again) + np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    item, at = np.repeat(item, again), np.repeat(at, again)
    score = np.empty(len(row))
    for a in range(0, len(row), PAIR_CHUNK):
        some = slice(a, a + PAIR_CHUNK)
        score[some] = np.einsum("ij,ij->i", q[row[some]], c[at[some]])
    best = np.lexsort((item, -np.round(score, SCORE_DIGITS), row))
    row, item, score = row[best], item[best], score[best]
    count = np.bincount(row, minlength=len(qids))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
    top = rank <= keep
    copy = row - np.searchsorted(qids, qids[row], "left")
    yield pa.RecordBatch.from_pydict({"query_row": qids[row[top]], "rank": rank[top].astype(np.int32), "item_row": item[top], "score": score[top], "copy": copy[top]})


def _score_tiles(keep: int):
    def run(batches):
        part, held = None, ([], [], [])
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(name)[j] for name in batch.schema.names}
                if row["part"].as_py() != part:
                    yield from _scored(held[QUERIES], held[ITEMS], held[PAIRS], keep)
                    part, held = row["part"].as_py(), ([], [], [])
                kind, n = row["kind"].as_py(), row["n"].as_py()
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                if kind == PAIRS:
                    held[PAIRS].append((ids, np.frombuffer(row["v"].as_buffer(), np.int64)))
                else:
                    v = np.frombuffer(row["v"].as_buffer(), np.float64 if row["wide"].as_py() else np.float32)
                    v = v.astype(np.float64).reshape(n, -1) if len(v) else np.zeros((n, 0))
                    held[kind].append((ids, v, np.frombuffer(row["has"].as_buffer(), bool)))
        yield from _scored(held[QUERIES], held[ITEMS], held[PAIRS], keep)
    return run


def rerank_tiles(q_bytes: int, c_bytes: int, pairs: int, tasks: int) -> tuple[int, int]:
    """(query tiles R, item tiles C): no tile over ``TILE_BYTES``, ``tasks`` tasks at least and ``TASK_PAIRS`` in each, about."""
    r, c = (max(1, math.ceil(x / TILE_BYTES)) for x in (q_bytes, c_bytes))
    return max(r, math.ceil(max(tasks, pairs / TASK_PAIRS) / c)), c


def _by_tiles(hits: DataFrame, query_vecs: DataFrame, item_vecs: DataFrame, vector: str, keep: int, row_id: str, r: int, c: int) -> DataFrame:
    def side(df: DataFrame, kind: int, own: int, other: int, part) -> DataFrame:
        packed = pack_tiles(df.where(F.col(row_id).isNotNull()), BLOCK_ROWS, own, query=kind == QUERIES, row_id=row_id, key=None, text=vector, image=None)
        return packed.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))) \
            .select(part.cast("int").alias("part"), F.lit(kind).alias("kind"), "n", "ids", F.col("t").alias("v"), F.col("has_t").alias("has"), "wide")

    pairs = hits.dropna().mapInArrow(_pack_pairs(r, c), "part int, kind int, n int, ids binary, v binary, has binary, wide boolean")
    rows = side(item_vecs, ITEMS, c, r, F.col("_j") * c + F.col("tile")).unionByName(side(query_vecs, QUERIES, r, c, F.col("tile") * c + F.col("_j"))).unionByName(pairs)
    scored = rows.repartitionById(r * c, "part").sortWithinPartitions("part", "kind").mapInArrow(_score_tiles(keep), SCHEMA + ", copy bigint")
    if c > 1:
        w = Window.partitionBy("query_row", "copy").orderBy(F.isnan("score"), F.round("score", SCORE_DIGITS).desc(), "item_row")
        scored = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return scored.select("query_row", "rank", "item_row", "score")


def rerank(first: DataFrame, query_vecs: DataFrame, item_vecs: DataFrame, vector: str, *,
           top_k: int, keep: int | None = None, row_id: str = "row_id", block_queries: int | None = None,
           tiles: tuple[int, int] | None = None) -> DataFrame:
    """Re-score the first ``top_k`` hits per query and return the new top ``keep``: query_row, rank, item_row, score.

    Ties go to the lower item_row. Hits whose query or item has no vector are dropped; row ids are taken as distinct.
    ``block_queries`` asks for blocks of that many queries, ``tiles`` for that many query and item tiles.
    """
    keep = keep or top_k
    n, width = table_stats(query_vecs, [vector])
    size = block_queries or max(1, BLOCK_BYTES // (8 * max(1, width) * top_k))
    blocks = max(1, math.ceil(n / size))
    hits = first.where(F.col("rank") <= top_k).select(F.col("query_row").cast("bigint").alias("query_row"), F.col("item_row").cast("bigint").alias("item_row"))
    if tiles or (blocks > 1 and not block_queries):
        m, row_bytes = n if item_vecs is query_vecs else item_vecs.count(), 8 * max(1, width) + 16
        r, c = tiles or rerank_tiles(n * row_bytes, m * row_bytes, n * top_k, first.sparkSession.sparkContext.defaultParallelism)
        return _by_tiles(hits, query_vecs, item_vecs, vector, keep, row_id, r, c)
    q = query_vecs.select(F.col(row_id).cast("bigint").alias("query_row"), F.col(vector).cast("array<double>").alias("v"))
    c = item_vecs.select(F.col(row_id).cast("bigint").alias("item_row"), F.col(vector).cast("array<double>").alias("v"))
    block = F.pmod(F.xxhash64("query_row"), F.lit(blocks)).alias("block")
    lists = hits.groupBy("query_row").agg(F.collect_list("item_row").alias("items"))
    left = lists.join(q, "query_row").select(block, "query_row", "items", "v")
    right = hits.select(block, "item_row").distinct().join(c, "item_row").select("block", "item_row", "v")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_score_block(keep), SCHEMA)
