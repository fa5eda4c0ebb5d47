"""Vector codes by product quantisation, with Lloyd's rounds over cover trees (operator 13).

Vectors become integers, are cut into parts, and each part has a codebook of its own. Every chunk of vectors
(a stretch of one partition) holds a cover tree a part over its distinct points: nets of half the radius a level,
cumulative sums over the points in tree order, so the sum of a subtree is one difference. A round walks
the levels: entries farther from a node's centre than the nearest one by more than the node's diameter cannot
be nearest for any point below; a node with one entry left is assigned whole by its sums, others descend, and
points of ambiguous leaves are compared exactly. Ties go to the lower index: pruning keeps all near ties.
A round sends one sum an entry and task to the driver's codebooks; vectors never move.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import settle, ship, skew_join

#: Vectors of a chunk, and points of a leaf at most.
CHUNK, LEAF = 1024, 8
#: Added to pruning bounds: far above the rounding of square roots, far below a step of integer distances.
SLACK = 1e-6
#: Largest sum of squares that float64 holds exactly.
EXACT = float(2**53)


class Tree(NamedTuple):
    """Distinct points in tree order, the place of each row's point, cumulative sums and counts (one longer than
    the points), and the nodes: range of points (the first is the centre), radius, first child and number of children (0: leaf)."""

    points: np.ndarray
    place: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points, len(x) by len(y): by products where float64 holds them."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(float), y.astype(float)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    if most >= 2**24 or 4 * most * most * x.shape[1] >= 2**62:
        raise ValueError("components are too large for exact integer distances")
    return np.stack([((x - e) ** 2).sum(axis=1) for e in y], axis=1) if len(y) else np.empty((len(x), 0), np.int64)


def cover_tree(rows: np.ndarray) -> Tree:
    """Cover tree over the distinct points of ``rows`` (int64, a point a row; one row at least)."""
    points, inverse, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    apart = np.sqrt(squared(points, points))
    order = np.arange(len(points))
    low, high, radius, child, children = [0], [len(points)], [float(apart[0].max())], [0], [0]
    levels = [(0, radius[0])]
    for node, reach in levels:  # grows as nodes get children
        own = order[low[node] : high[node]]
        if len(own) <= LEAF:
            continue
        reach = min(reach, radius[node]) / 2
        rest, net = own, []
        while len(rest) and 4 * len(net) <= 3 * len(own):  # centres more than ``reach`` apart, each with the points within it
            near = apart[rest[0]][rest] <= reach
            net.append(rest[near])
            rest = rest[~near]
        if len(rest):  # hardly any two points are that close: a leaf
            continue
        child[node], children[node], at = len(low), len(net), low[node]
        for part in net:
            levels.append((len(low), reach))
            order[at : at + len(part)] = part
            low.append(at)
            at += len(part)
            high.append(at)
            radius.append(float(apart[part[0]][part].max()))
            child.append(0)
            children.append(0)
    back = np.empty(len(points), np.int64)
    back[order] = np.arange(len(points))
    points, weight = points[order], weight[order]
    sums = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(points * weight[:, None], axis=0)])
    return Tree(points, back[inverse.reshape(-1)], sums, np.append(0, np.cumsum(weight)),
                *map(np.array, (low, high, radius, child, children)))


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry of every distinct point, sum and count of the rows of every entry, points compared one by one)."""
    nearest = np.empty(len(tree.points), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    nodes, mask, compared = np.array([0]), np.ones((1, len(entries)), bool), 0

    def give(low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        np.add.at(sums, entry, tree.sums[high] - tree.sums[low])
        np.add.at(counts, entry, tree.counts[high] - tree.counts[low])

    while len(nodes):
        d = np.sqrt(squared(tree.points[tree.low[nodes]], entries))
        d[~mask] = np.inf
        mask = d <= d.min(axis=1, keepdims=True) + 2 * tree.radius[nodes, None] + SLACK
        alone = mask.sum(axis=1) == 1
        if alone.any():  # the whole subtree has one nearest entry
            whole, entry = nodes[alone], mask[alone].argmax(axis=1)
            give(tree.low[whole], tree.high[whole], entry)
            for a, b, e in zip(tree.low[whole].tolist(), tree.high[whole].tolist(), entry.tolist(), strict=True):
                nearest[a:b] = e
        leaf = ~alone & (tree.children[nodes] == 0)
        if leaf.any():
            width = tree.high[nodes[leaf]] - tree.low[nodes[leaf]]
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(tree.low[nodes[leaf]], width)
            exact = np.where(np.repeat(mask[leaf], width, axis=0), squared(tree.points[at], entries), np.inf)
            nearest[at] = exact.argmin(axis=1)
            give(at, at + 1, nearest[at])
            compared += len(at)
        down = ~alone & ~leaf
        width = tree.children[nodes[down]]
        mask = np.repeat(mask[down], width, axis=0)
        nodes = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(tree.child[nodes[down]], width)
    return nearest, sums, counts, compared


TREES = "vec_id array<long>, grouped array<string>, trees array<binary>"
CODES = "vec_id long, grouped string, code string, error long"


def _grow(parts: int, size: int):
    """Chunks of a partition with a tree a part."""

    def chunk(ids: list, labels: list, rows: np.ndarray) -> pa.RecordBatch:
        trees = [pickle.dumps(tuple(cover_tree(np.ascontiguousarray(rows[:, k * size : (k + 1) * size])))) for k in range(parts)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
                                           pa.array([trees], pa.list_(pa.binary()))], ["vec_id", "grouped", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], np.empty((0, parts * size), np.int64)
        for batch in batches:
            if (wrong := np.diff(batch.column(2).offsets.to_numpy()) != parts * size).any():
                raise ValueError(f"{wrong.sum()} vectors have another length than {parts * size}")
            held = np.concatenate([held, batch.column(2).flatten().to_numpy().reshape(-1, parts * size)])
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            while len(held) >= CHUNK:
                yield chunk(ids[:CHUNK], labels[:CHUNK], held[:CHUNK])
                ids, labels, held = ids[CHUNK:], labels[CHUNK:], held[CHUNK:]
        if len(held):
            yield chunk(ids, labels, held)
    return run


def _trees(batch: pa.RecordBatch, row: int) -> list[Tree]:
    return [Tree(*pickle.loads(t)) for t in batch.column("trees")[row].as_py()]


def _sums(codebooks: list[np.ndarray]):
    """Sum and count of every used entry, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)) for c in codebooks]
        for batch in batches:
            for row in range(batch.num_rows):
                for tree, book, (sums, counts) in zip(_trees(batch, row), codebooks, totals, strict=True):
                    _, s, c, _ = assign(tree, book)
                    sums += s
                    counts += c
        rows = [(p, e, int(c), s.tolist()) for p, (sums, counts) in enumerate(totals) for e, (s, c) in enumerate(zip(sums, counts, strict=True)) if c]
        if rows:
            part, entry, n, total = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()),
                                              pa.array(total, pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
    return run


def _codes(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("vec_id")[row].values, batch.column("grouped")[row].values
                code, error = np.empty((len(ids), len(codebooks)), np.uint8), np.zeros(len(ids), np.int64)
                for k, (tree, book) in enumerate(zip(_trees(batch, row), codebooks, strict=True)):
                    nearest = assign(tree, book)[0]
                    code[:, k] = nearest[tree.place]
                    error += ((tree.points - book[nearest]) ** 2).sum(axis=1)[tree.place]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code]), pa.array(error)],
                                                 ["vec_id", "grouped", "code", "error"])
    return run


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Per kept row of ``vectors``: vec_id, code (an entry a part, two hex digits each), error (squared distance to the
    chosen entries, over all parts), label_error (error over all rows of the same label, null labels together),
    codebooks_sha256 (all entries' components, by part, entry and place, joined by commas).

    Rows with a null vector or null or non-finite components go. A component x becomes floor(scale * x). Codebooks start as the
    parts of the ``entries`` (256 at most) smallest vec_ids (repeated vec_ids by their vectors, null ones last), or of
    as many as there are; an entry that no part chose in a round stays. Repeated rows count and are returned each.
    Vectors of another length than the first one's, a length that ``parts`` does not divide, and components beyond
    exact integer distances (about 2**24) are errors. Further columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    whole = F.col("embedding").cast("array<double>")
    # a label of any type as text, with null apart from every text
    grouped = F.when(F.col("label").isNotNull(), F.concat(F.lit("v"), F.col("label").cast("string"))).otherwise(F.lit("n"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), grouped.alias("grouped"), whole.alias("v"))         .filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))         .select("vec_id", "grouped", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # 256 vectors at most
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    length = len(first[0].v)
    if not length or length % parts or any(len(r.v) != length for r in first):
        raise ValueError(f"vectors of {length} components are not cut into {parts} equal parts")
    size = length // parts
    start = np.array([r.v for r in first], np.int64)
    codebooks = [start[:, k * size : (k + 1) * size].copy() for k in range(parts)]
    trees = settle(kept.mapInArrow(_grow(parts, size), TREES), "trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(codebooks), "part int, entry int, n long, total array<long>")             .groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(size)]).alias("total"))
        for r in sums.collect():  # an entry of a codebook a row
            codebooks[r.part][r.entry] = np.array(r.total) // r.n
    rows = settle(trees.mapInArrow(_codes(codebooks), CODES), "codes")
    totals = rows.groupBy("grouped").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist()).encode()).hexdigest()
    return skew_join(rows, totals, ["grouped"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL for ``vector_codes`` of the table embeddings (vec_ids of kept rows are taken as distinct)."""
    nearest = """SELECT vec_id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d
      FROM (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {book} b USING (part, place) GROUP BY ALL) GROUP BY ALL"""
    ctes = [f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
            f"""x AS (SELECT vec_id, CAST((i - 1) * {parts} // len(v) AS INTEGER) AS part, (i - 1) % (len(v) // {parts}) AS place, v[i] AS v
      FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM k))""",
            f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
            "b0 AS MATERIALIZED (SELECT part, entry, place, v FROM x JOIN seeds USING (vec_id))"]
    for k in range(rounds):
        ctes += [f"a{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})",
                 f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN
      (SELECT part, entry, place, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place))"""]
    ctes += [f"last AS MATERIALIZED ({nearest.format(book=f'b{rounds}')})",
             "codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)"]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM codes JOIN k USING (vec_id)"""
