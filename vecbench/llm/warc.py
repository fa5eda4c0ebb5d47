"""WARC archives through a chunked record table (operator 9).

Payloads travel as rows (record_id, chunk_no, data) of bounded size, both to the writers and from the
readers, and every chunk that is read carries the digest of the payload up to and with it, so no task
holds a whole record. Writers make gzip members, one a record, in files of their own; the manifest of
(file, record, offset, length) names only what finished tasks wrote, so files of lost tasks are never
read. Readers take byte ranges of the files, whole records each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import new_folder, settle, skew_join

CHUNK = 64 << 10
FILE = 256 << 20
RANGE = 16 << 20
#: Packed bytes read at a time; unpacked they are at most about a thousand times as many.
READ = 16 << 10
MANIFEST = "file string, record_id string, offset long, length long"
CHUNKS = ("record_id string, page_id long, record_type string, refers_to long, copies long, declared_bytes long, "
          "declared_digest string, chunk_no int, n_bytes long, running_digest string")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or URI that Arrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def _record_id() -> Column:
    """The same for rows with equal page_id, url and payload."""
    return F.md5(F.to_json(F.struct(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("u"),
                                    F.sha1(payload()).alias("d")), {"ignoreNullFields": "false"}).cast("binary"))


def judged_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row a distinct record: record_id, page_id, url, n_bytes, sha1, copies, record_type, refers_to, target.

    Of the records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id
    is the response; the others are revisits of it. Smaller ones are all responses.
    """
    facts = settle(pages.select(_record_id().alias("record_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                F.octet_length(payload()).cast("long").alias("n_bytes"), F.sha1(payload()).alias("sha1")), "facts")
    facts = settle(facts.groupBy("record_id", "page_id", "url", "n_bytes", "sha1").agg(F.count("*").alias("copies")), "records")
    groups = facts.filter(F.col("n_bytes") >= least_bytes).groupBy("sha1", "n_bytes") \
        .agg(F.max(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "n_bytes", "first")
    out = skew_join(facts, groups, ["sha1", "n_bytes"])
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return out.select("record_id", "page_id", "url", "n_bytes", "sha1", "copies",
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.record_id")).alias("target"))


def chunk_rows(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """(record_id, chunk_no, data) of rows (record_id, head, data): the head as chunk -1, then the payload in order; an
    empty payload has one empty chunk, a null one (a revisit's) none. A record's rows are neighbours in one task."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("data") / F.lit(size)).cast("int") - 1)
    numbers = F.sequence(F.lit(-1), F.when(F.col("data").isNull(), F.lit(-1)).otherwise(last))
    part = F.when(F.col("chunk_no") < 0, F.col("head")).otherwise(F.substring("data", F.col("chunk_no") * size + 1, F.lit(size)))
    return records.select("record_id", "head", "data", F.explode(numbers).alias("chunk_no")).select("record_id", "chunk_no", part.alias("data"))


def with_payloads(records: DataFrame, pages: DataFrame, least_bytes: int) -> DataFrame:
    """``records`` (record_id, sha1, n_bytes, record_type, head) as (record_id, head, data), data null for revisits.

    A content travels once a task that holds it, however many rows or records repeat it, and goes to its only response;
    contents below ``least_bytes`` have a response a record, and are fetched by record.
    """
    response = F.col("record_type") == "response"
    contents = pages.select(F.sha1(payload()).alias("sha1"), payload().alias("data")).filter(F.octet_length("data") >= least_bytes).dropDuplicates(["sha1"])
    out = records.filter(response & (F.col("n_bytes") >= least_bytes)).join(contents, "sha1").select("record_id", "head", "data")
    if least_bytes > 0:
        own = pages.select(_record_id().alias("record_id"), payload().alias("data")).filter(F.octet_length("data") < least_bytes).dropDuplicates(["record_id"])
        out = out.unionByName(records.filter(response & (F.col("n_bytes") < least_bytes)).join(own, "record_id").select("record_id", "head", "data"))
    return out.unionByName(records.filter(~response).select("record_id", "head", F.lit(None).cast("binary").alias("data")))


def _urn(record_id: str) -> str:
    return f"<urn:uuid:{uuid.UUID(record_id)}>"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _head(r: dict) -> bytes:
    revisit = r["record_type"] == "revisit"
    fields = {
        "WARC-Type": r["record_type"], "WARC-Record-ID": _urn(r["record_id"]), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if r["url"] is None else r["url"].replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": "sha1:" + _base32(bytes.fromhex(r["sha1"])),
        "WARC-Profile": _PROFILE if revisit else None, "WARC-Refers-To": _urn(r["target"]) if revisit else None,
        "WARC-X-Page-Id": r["page_id"], "WARC-X-Refers-To-Page-Id": r["refers_to"], "WARC-X-Payload-Length": r["n_bytes"], "WARC-X-Copies": r["copies"],
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(_HTTP) + (0 if revisit else r["n_bytes"]),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + _HTTP


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        out = name = member = current = None
        start = at = 0
        rows: list[tuple] = []

        def finish() -> None:
            nonlocal member, at
            if member is not None:
                tail = member.compress(b"\r\n\r\n") + member.flush()
                out.write(tail)
                at += len(tail)
                rows.append((name, current, start, at - start))
                member = None

        def made() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "record_id", "offset", "length"])
            rows.clear()
            return batch

        for batch in batches:
            ids, numbers, data = (batch.column(n) for n in ("record_id", "chunk_no", "data"))
            for record, number, part in zip(ids.to_pylist(), numbers.to_pylist(), data, strict=True):
                if number < 0:  # the head comes first
                    finish()
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                            yield made()
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                    head = json.loads(part.as_py())
                    current, start = record, at
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = member.compress(_head(head))
                else:
                    packed = member.compress(part.as_py())
                out.write(packed)
                at += len(packed)
        finish()
        if out is not None:
            out.close()
        if rows:
            yield made()
    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, chunk: int = CHUNK, file_bytes: int = FILE) -> DataFrame:
    """Write a record a distinct row of ``pages`` to ``folder``; returns the manifest (written as a table)."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    records = settle(judged_records(pages, least_bytes), "judged")
    head = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).cast("binary")
    rows = chunk_rows(with_payloads(records.withColumn("head", head), pages, least_bytes), chunk)
    return settle(rows.mapInArrow(_write(folder, file_bytes), MANIFEST), "manifest")


def _members(stream, length: int) -> Iterator[bytes]:
    """Unpacked bytes of ``length`` packed ones, READ at a time; b'' ends each member."""
    unpack, rest = zlib.decompressobj(31), b""
    while True:
        if not rest:
            rest = stream.read(min(length, READ))
            length -= len(rest)
            if not rest:
                break
        piece = unpack.decompress(rest)
        if piece:
            yield piece
        rest = b""
        if unpack.eof:
            yield b""
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)


def _fields(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return dict(line.split(": ", 1) for line in lines if line)


def _records(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Chunk rows of CHUNKS from unpacked bytes."""
    buffer, fields, digest = b"", None, None
    left = http = number = 0
    for piece in pieces:
        if not piece:  # the end of a record
            if fields is None or left or buffer != b"\r\n\r\n":
                raise ValueError("a WARC record ends early")
            declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] != "revisit" and _base32(digest.digest()) != declared:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
            buffer, fields = b"", None
            continue
        buffer += piece
        if fields is None:
            if (end := buffer.find(b"\r\n\r\n")) < 0:
                continue
            fields, buffer = _fields(buffer[:end]), buffer[end + 4 :]
            left, http, number, digest = int(fields["Content-Length"]), 1, 0, hashlib.sha1()
        if http:
            if (end := buffer.find(b"\r\n\r\n")) < 0:
                continue
            left, http, buffer = left - end - 4, 0, buffer[end + 4 :]
            if not left:  # no payload in the file: revisits and empty payloads
                yield _row(fields, 0, 0, fields["WARC-Payload-Digest"].removeprefix("sha1:"))
        while left and buffer:
            part, buffer = buffer[: min(left, CHUNK)], buffer[min(left, CHUNK) :]
            digest.update(part)
            left -= len(part)
            yield _row(fields, number, len(part), _base32(digest.digest()))
            number += 1


def _row(f: dict[str, str], number: int, n: int, digest: str) -> tuple:
    whole = lambda k: int(f[k]) if k in f else None
    return (f["WARC-Record-ID"][10:-1].replace("-", ""), whole("WARC-X-Page-Id"), f["WARC-Type"], whole("WARC-X-Refers-To-Page-Id"), whole("WARC-X-Copies"),
            whole("WARC-X-Payload-Length"), f["WARC-Payload-Digest"].removeprefix("sha1:"), number, n, digest)


def _read(folder: str):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{path}/{r['file']}") as stream:
                    stream.seek(r["start"])
                    rows = []
                    for row in _records(_members(stream, r["stop"] - r["start"])):
                        rows.append(row)
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return run


def read_chunks(manifest: DataFrame, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """Chunk rows (CHUNKS) of all records that the manifest names; running_digest is the base32 SHA-1 of
    the payload up to and with the chunk. Revisits and empty payloads have one chunk of no bytes."""
    ranges = manifest.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("range")) \
        .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"))
    ranges = settle(ranges, "ranges")
    return ranges.repartition(max(1, ranges.count()), "file", "range").select("file", "start", "stop").mapInArrow(_read(folder), CHUNKS)


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, n_chunks, one row a row of ``pages``.

    Null html is an empty payload. Rows equal in page_id, url and payload are one record, returned once a
    row. Rows that share payload and largest page_id but not the url: the larger record_id is the response.
    Null page_ids sort below all others. Further columns are ignored; an empty table gives no file and an
    empty result.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, least_bytes)
    chunks = read_chunks(manifest, folder)
    whole = chunks.groupBy("record_id", "page_id", "record_type", "refers_to", "copies", "declared_bytes") \
        .agg(F.sum("n_bytes").alias("read"), F.max_by("running_digest", "chunk_no").alias("payload_digest"), F.count("*").alias("n_chunks"))
    length = F.when(F.col("record_type") == "revisit", F.col("declared_bytes")).otherwise(F.col("read"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))) \
        .select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "n_chunks")
