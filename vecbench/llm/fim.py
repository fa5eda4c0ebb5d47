"""Fill-in-middle transformation on piece tables (operator 12).

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text and
the sentinels. A cut splits a descriptor, an arrangement permutes descriptors and puts sentinels between
them, the inverse permutation restores the text, and hashes run over the descriptors' bytes in turn; text is
copied once, where the output itself is asked for or read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vecbench.llm.common import binary, ship

#: The sentinels, in one buffer.
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (1, 0, 3), (1, 3, 3), (1, 6, 3)
_MARKS = [SENTINELS[k : k + 3] for k in (0, 3, 6)]
#: Order of the parts (0 prefix, 1 middle, 2 suffix) behind their sentinels.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class Rates:
    """Share (percent) of documents that are transformed, share of those in spm form, and the seed."""

    transformed: int = 90
    spm: int = 20
    seed: str = "1"


class PieceTable:
    """Descriptors over the buffers (text, sentinels)."""

    def __init__(self, text: bytes):
        self.buffers = (text, SENTINELS)
        self.pieces: list[Piece] = [(0, 0, len(text))]

    def cut(self, at: int) -> None:
        """Split the descriptor that holds place ``at``; at an edge of the text a part is empty."""
        place = 0
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at <= place + length:
                head = at - place
                self.pieces[k : k + 1] = [(buffer, start, head), (buffer, start + head, length - head)]
                return
            place += length
        raise ValueError(f"no place {at} in a text of {place} bytes")

    def arrange(self, form: str) -> None:
        """Prefix, middle, suffix into the order of ``form``, each behind its sentinel."""
        self.pieces = [p for mark, part in FORMS[form] for p in (mark, self.pieces[part])]

    def restore(self, form: str) -> None:
        """The inverse of ``arrange``: drop the sentinels, and bring the parts back into order."""
        parts = self.pieces[1::2]
        back = sorted(range(3), key=lambda k: FORMS[form][k][1])
        self.pieces = [parts[k] for k in back]

    def slices(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield memoryview(self.buffers[buffer])[start : start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for s in self.slices():
            h.update(s)
        return h.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.slices())


def parsed(output: bytes, form: str) -> PieceTable:
    """Table of an arranged output, cut at its sentinels: sentinel, part, sentinel, part, sentinel, part."""
    table, at = PieceTable(output), 0
    for k, ((_, start, length), _) in enumerate(FORMS[form]):
        at = output.find(SENTINELS[start : start + length], at)
        if at < 0 or (k == 0 and at > 0):
            raise ValueError(f"no {form} output: a sentinel is missing")
        if k:
            table.cut(at)
        at += length
        table.cut(at)
    return table


def unit_starts(text: bytes) -> np.ndarray:
    """First byte of every unit (a run of A-Z and a-z, or one other code point) of a UTF-8 text."""
    b = np.frombuffer(text, np.uint8)
    low = b | 0x20
    letter = (low >= 97) & (low <= 122)
    first = (b & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def code_points(text: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def transform(doc_id: int | None, text: bytes, rates: Rates) -> tuple[str, int, PieceTable, tuple[int, int] | None]:
    """(form, units, table of the output, code points of prefix and middle)."""
    starts = unit_starts(text)
    n = len(starts)
    key = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[k : k + 8], 16) for k in (0, 8, 16, 24))
    table = PieceTable(text)
    if not text or h3 % 100 >= rates.transformed or any(m in text for m in _MARKS):
        return "plain", n, table, None
    for unit in sorted((h1 % (n + 1), h2 % (n + 1))):
        table.cut(int(starts[unit]) if unit < n else len(text))
    prefix, middle, _ = map(code_points, table.slices())
    form = "spm" if h4 % 100 < rates.spm else "psm"
    table.arrange(form)
    return form, n, table, (prefix, middle)


def _restored(output: bytes, form: str) -> PieceTable:
    if form == "plain":
        return PieceTable(output)
    table = parsed(output, form)
    table.restore(form)
    return table


def _transform(rates: Rates, with_output: bool):
    names = ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")], *["output"] * with_output]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.string()] * with_output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                rows = []
                for doc, text in zip(some.column(0).to_pylist(), binary(some.column(1)), strict=True):
                    form, n, table, parts = transform(doc, text or b"", rates)
                    output = table.text()
                    rows.append((doc, n, form, *(parts or (None, None)), table.sha256(), _restored(output, form).sha256(), *[output] * with_output))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return run


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), with_output: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain), output_sha256, restored_sha256 (of the text that the inverse makes of output and form), and
    the transformed text ``output``.

    Null text is empty; an empty text and a text that holds a sentinel stay plain. The cuts and the form
    come from doc_id alone: repeated rows get the same answer, a null doc_id hashes as no digits. Texts of any
    length are one row each. Further columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_transform(rates, with_output), f"doc_id long, {COLUMNS}" + ", output string" * with_output)


def restore_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``text`` rebuilt from ``output`` and ``form`` (null output: null; a column ``text`` that
    is there is replaced). Fails on an output that lacks a sentinel of its form."""
    ship(rows.sparkSession)
    rows = rows.drop("text")
    schema = StructType([*rows.schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, outputs = batch.column("form").to_pylist(), binary(batch.column("output"))
            texts = [None if o is None else _restored(o, f).text() for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
