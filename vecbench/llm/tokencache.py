"""Token counts through a digest cache (operator 3).

Every text is reduced to a digest of its normalised content; the cache holds (vocabulary version, digest,
count). Only distinct digests that the cache lacks are encoded, and their counts are appended. Texts
travel to the encoders once, compressed, after copies were merged within each task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import BROADCAST_KEYS, binary, settle, skew_join
from vecbench.llm.tokens import encoder, file_digest

CACHE = "digest binary, n_tokens long"


def normalised(path: str, text: bytes | None) -> bytes:
    """Content that decides the count: vocabularies that drop white space see runs of it as one space;
    for others the text as it is. Null is empty."""
    if not text:
        return b""
    return b" ".join(text.split()) if encoder(path).runs is not None else text


def _digest(path: str, text: bytes | None) -> tuple[bytes, bytes]:
    content = normalised(path, text)
    return hashlib.blake2b(content, digest_size=16).digest(), content


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([_digest(path, t)[0] for t in texts], pa.binary())],
                ["doc_id", "n_bytes", "digest"])
    return run


def _contents(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = [_digest(path, t) for t in binary(batch.column(0).slice(k, 1024))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([pack(c) for _, c in rows], pa.binary())],
                                                 ["digest", "packed"])
    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, enc = zstandard.ZstdDecompressor().decompress, encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                counts = enc.counts([unpack(x) for x in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def stored_counts(spark, cache: str, version: str) -> DataFrame | None:
    """Counts in the cache for a vocabulary version, one row a digest; None without such a cache."""
    try:
        rows = spark.read.schema(CACHE).parquet(f"{cache}/{version}/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` is a vocabulary file (.json or .model), ``cache`` a folder that all executors share. Null
    text counts as empty (0 bytes, 0 tokens). Null or repeated doc_ids keep a row each; further columns
    are ignored; an empty table gives an empty result and leaves the cache as it is. A run that dies
    before its append is committed leaves no counts behind; two runs at once may store a digest twice,
    which readers merge.
    """
    spark = docs.sparkSession
    version = file_digest(path).replace(":", "-")
    text = F.col("text").cast("string").alias("text")
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
                  .mapInArrow(_digests(path), "doc_id long, n_bytes long, digest binary"), "digests")
    known = stored_counts(spark, cache, version)
    need = rows.select("digest").distinct()
    if known is not None:
        need = need.join(known, "digest", "left_anti")
    need = settle(need, "need")
    contents = docs.select(text).mapInArrow(_contents(path), "digest binary, packed binary")
    # copies are merged within each task before any of them travels: a text that a third of the rows share is a row a task
    if need.count() <= BROADCAST_KEYS:
        missing = contents.join(F.broadcast(need), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        missing = contents.dropDuplicates(["digest"]).join(need, "digest", "left_semi")
    missing.mapInArrow(_encode(path), CACHE).write.parquet(f"{cache}/{version}/{uuid.uuid4().hex}")
    known = stored_counts(spark, cache, version)
    return skew_join(rows, known, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
