"""Benchmark decontamination by size-partitioned MinHash containment search (operator 1).

The Jaccard similarity of a short item and a long document is tiny, so documents are partitioned by
size first: each is cut into overlapping windows of twice the size class of the items (size classes are
powers of two). An item at containment c of a class then has a Jaccard similarity of at least about
c/4 with a window, whatever the document's length, and one of 64 minima meets with a chance of
1 - (1 - c/4)**64, over 0.99999 at c = 0.75. Items of fewer than FEW shingles are too small for that estimate
to hold in every window: they are looked up by their exact shingles. Candidates are verified by exact shingle containment over
the whole document. Window minima come from merging neighbouring block minima, so every shingle is
hashed once, for all size classes together.

Items go to the tasks in blocks of at most ``block_shingles`` shingles, a stated query set against all
rows: the documents are scanned once a block, and nothing grows with the documents.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import WordHashes, binary, hash_family, shingles, ship

FUNCTIONS = 64
SMALLEST = 8
FEW = 6
BLOCK_SHINGLES = 200_000
SLICE = 1 << 12
_A, _B = hash_family(FUNCTIONS, 40_093)
_PUNCTUATION = string.punctuation.encode()
_MASK = (1 << 18) - 1
_HASHES = WordHashes()


def words(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.lower().translate(None, _PUNCTUATION).split()


class Items:
    """A block of test items, indexed by size class: minima and exact shingle sets."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, containment: float):
        self.width, self.containment = width, containment
        self.ids, self.sets, by_class, few = [], [], {}, []
        for item, text in items:
            values = np.unique(shingles(_HASHES.of(words(text)), width))
            if not len(values):
                continue
            if len(values) < FEW:
                few += [(v, len(self.ids)) for v in values.tolist()]
                self.ids.append(item)
                self.sets.append(values)
                continue
            size = SMALLEST
            while size < len(values):
                size *= 2
            low = (_A[:, None] * values[None, :] + _B[:, None]).min(axis=1)
            by_class.setdefault(size, []).append((low, len(self.ids)))
            self.ids.append(item)
            self.sets.append(values)
        few.sort()
        self.few = np.array([v for v, _ in few], np.uint64), [o for _, o in few]
        self.classes = {}
        for size, members in sorted(by_class.items()):
            value = np.concatenate([m for m, _ in members])
            owner = np.repeat([o for _, o in members], FUNCTIONS)
            order = np.argsort(value, kind="stable")
            quick = np.zeros(_MASK + 1, bool)
            quick[(value & np.uint64(_MASK)).astype(np.int64)] = True
            self.classes[size] = value[order], owner[order], quick

    def candidates(self, values: np.ndarray) -> set[int]:
        """Items one of whose minima is a minimum of a window of their size class, and small ones by any shingle."""
        found: set[int] = set()
        shingle, owners = self.few
        if len(shingle):
            left, right = np.searchsorted(shingle, values, "left"), np.searchsorted(shingle, values, "right")
            for k in np.flatnonzero(left < right).tolist():
                found.update(owners[left[k] : right[k]])
        if not self.classes:
            return found
        base = min(self.classes)
        overlap = 2 * max(self.classes)
        step = max(SLICE, 2 * overlap)
        for k in range(0, len(values), step):  # slices overlap by the largest window
            part = values[max(0, k - overlap) : k + step]
            starts = np.arange(0, len(part), base)
            low = np.minimum.reduceat(_A[:, None] * part[None, :] + _B[:, None], starts, axis=1)
            size = base
            while True:
                if size in self.classes:
                    window = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                    value, owner, quick = self.classes[size]
                    hit = window[quick[(window & np.uint64(_MASK)).astype(np.int64)]]
                    if len(hit):
                        left, right = np.searchsorted(value, hit, "left"), np.searchsorted(value, hit, "right")
                        for a, b in zip(left[left < right], right[left < right], strict=True):
                            found.update(owner[a:b].tolist())
                if size >= max(self.classes):
                    break
                size *= 2
                if low.shape[1] % 2:
                    low = np.concatenate([low, low[:, -1:]], axis=1)
                low = np.minimum(low[:, ::2], low[:, 1::2])
        return found

    def matches(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item, shingles found, shingles of the item) of every item that the text contains."""
        values = shingles(_HASHES.of(words(text)), self.width) if text and self.ids else ()
        if not len(values):
            return []
        near = self.candidates(values)
        if not near:
            return []
        whole = np.unique(values)
        out = []
        for k in sorted(near):
            own = self.sets[k]
            at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            n = int((whole[at] == own).sum())
            if n >= self.containment * len(own):
                out.append((self.ids[k], n, len(own)))
        return out


def item_blocks(items: DataFrame, block_shingles: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items on the driver, a bounded block at a time."""
    ship(items.sparkSession)
    block, size = [], 0
    rows = items.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("t"))
    for item, text in rows.orderBy("item_id", "t").toLocalIterator():
        text = bytes(text)
        block.append((item, text))
        size += len(text) // 4 + 1
        if size >= block_shingles:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, containment: float = 0.75,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row a document and item that it contains: doc_id, item_id, n_found, n_item, containment.

    An item is contained if at least ``containment`` of its distinct ``width``-word shingles occur in
    the document (words in lower case, ASCII punctuation removed). Items or documents with fewer words
    are one shingle; without words or with null text or item_id they match nothing. Repeated documents
    give repeated rows, an item_id that repeats counts by each of its texts. A null doc_id is kept as
    null. Further columns are ignored.
    """
    out = None
    schema = "doc_id long, item_id long, n_found long, n_item long"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for block in item_blocks(items, block_shingles):
        part = text.mapInArrow(_found(block, width, containment), schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def _found(block, width, containment):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(block, width, containment)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True) for m in index.matches(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 ["doc_id", "item_id", "n_found", "n_item"])
    return run


def _clean(block, width, containment, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(block, width, containment)
        for batch in batches:
            keep = [not index.matches(t) for t in binary(batch.column(batch.schema.get_field_index(text)))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, containment: float = 0.75,
                      block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs``, all columns, without the documents that contain an item (see ``contained_items``).

    Every row is judged where it stands, so nothing is shuffled and null or repeated ids are no matter.
    """
    for block in item_blocks(items, block_shingles):
        docs = docs.mapInArrow(_clean(block, width, containment, "text"), docs.schema)
    return docs
