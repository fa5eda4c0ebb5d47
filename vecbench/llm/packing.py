"""Vector best-fit packing of documents into sequences (operator 2).

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces come in decreasing order; each goes to an open bin that holds it under every
constraint, chosen by the largest weighted dot product of residual and piece, or by the smallest weighted
norm of the residual left over; without such a bin it opens one. Pieces are dealt by hash to groups of
bounded size, each packed on its own, which costs one part-filled bin a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import binary, settle
from vecbench.llm.tokens import crc32_of, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
GROUP = 8192


@dataclass(frozen=True)
class Capacity:
    """Most tokens, documents and attention cost of a sequence, their weights and the rule of choice."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)
    rule: str = "norm"

    def __post_init__(self):
        if self.rule not in ("norm", "dot") or min(self.tokens, self.documents, self.cost) < 1 or self.cost < self.tokens**2:
            raise ValueError("a rule is norm or dot; every capacity must hold the longest piece")


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece length."""
    n = len(lengths)
    full = np.array([cap.tokens, cap.documents, cap.cost], float)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2]) / full[:, None]
    weights = np.array(cap.weights)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((3, 1024))  # residuals of the open bins, as shares of the capacities
    names, used = np.empty(1024, np.int64), np.empty(1024, np.int64)
    count = opened = 0
    least = need.min(axis=1) if n else np.zeros(3)
    slack = 1e-9
    for at in np.argsort(-lengths, kind="stable"):
        v = need[:, at]
        r = left[:, :count]
        fits = (r >= v[:, None] - slack).all(axis=0)
        if cap.rule == "norm":
            rank = (weights[:, None] * (r - v[:, None]) ** 2).sum(axis=0)
        else:
            rank = -((weights * v) @ r)
        rank[~fits] = np.inf
        k = int(rank.argmin()) if count else -1
        if k < 0 or not fits[k]:
            if count == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                names, used = np.concatenate([names, names]), np.concatenate([used, used])
            k, count = count, count + 1
            left[:, k], names[k], used[k] = 1.0, opened, 0
            opened += 1
        bins[at], offsets[at] = names[k], used[k]
        left[:, k] -= v
        used[k] += lengths[at]
        if (left[:, k] < least - slack).any():  # no piece fits any more: closed
            count -= 1
            left[:, k], names[k], used[k] = left[:, count], names[count], used[count]
    return bins, offsets


def _pieces(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.many(binary(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                rows += [(doc, k // most, k, min(most, len(ids) - k), crc32_of(ids[k : k + most])) for k in range(0, len(ids), most)]
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, most: int) -> DataFrame:
    """Pieces of every text's ids and ``end_id``, cut only beyond ``most`` ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_pieces(vocabulary, end_id, most), PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (place in its sequence).

    Null or empty text is the end id alone. Null or repeated doc_ids are documents of their own; further
    columns are ignored; an empty table gives an empty result. Offsets of a sequence are gapless from 0.
    """
    pieces = settle(pieces_of(docs, vocabulary, end_id, capacity.tokens), "pieces")
    part = pieces.filter(F.col("length") < capacity.tokens)
    groups = max(1, math.ceil(part.count() / GROUP))
    dealt = part.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, rows["offset"] = best_fit(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = rows["group"] * (2 * GROUP * 64) + bins
        return rows.drop(columns="group")

    packed = dealt.groupBy("group").applyInPandas(group, f"{PIECES}, offset long, sequence_id long")
    whole = pieces.filter(F.col("length") >= capacity.tokens).withColumn("offset", F.lit(0).cast("long")) \
        .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return packed.unionByName(whole).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
