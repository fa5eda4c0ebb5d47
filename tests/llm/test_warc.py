import base64
import hashlib

import pytest

from vecbench.llm import warc as W
from vecbench.llm.common import new_folder

BIG = "é" * 200_001
HTML = [(1, "x"), (2, None), (3, ""), (4, "x"), (5, BIG), (6, BIG), (7, BIG + "z"), (8, "x"), (9, "\r\n\r\nWARC/1.1\r\n"), (10, "xy"), (11, "xy"), (None, "xy"), (None, None)]


def brute(rows, least=0):
    first = {}
    for p, h in rows:
        b = (h or "").encode()
        first[b] = max(first.get(b, -1), -1 if p is None else p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= least and (-1 if p is None else p) != first[b]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(p, f"http://a/{p}\r\nX: y", h, "c", 1, "r") for p, h in rows], "page_id long, url string, html string, chunk_no string, copies int, record_id string")


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    rows = HTML + [(4, "x")]  # a repeated row
    got = W.archived(frame(spark, rows).repartition(3), least_bytes=least).drop("n_chunks")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, least)
    assert W.archived(frame(spark, [])).count() == 0


def test_chunks_carry_running_digests(spark):
    folder = new_folder(spark, "warc")
    manifest = W.write_archives(frame(spark, [(7, BIG)]), folder, chunk=1000)
    rows = sorted(W.read_chunks(manifest, folder).collect(), key=lambda r: r.chunk_no)
    sha, at = hashlib.sha1(), 0
    for r in rows:
        sha.update(BIG.encode()[at : at + r.n_bytes])
        at += r.n_bytes
        assert r.running_digest == base64.b32encode(sha.digest()).decode() and r.n_bytes <= W.CHUNK
    assert at == len(BIG.encode()) and len(rows) > 1


def test_files_roll_and_ranges_split(spark):
    folder = new_folder(spark, "warc")
    rows = [(k, f"page {k} " * 50) for k in range(60)]
    fs, path = W.open_folder(folder)
    fs.create_dir(path, recursive=True)
    monkey, W.FILE = W.FILE, 2000
    try:
        manifest = W.write_archives(frame(spark, rows).coalesce(1), folder, file_bytes=2000)
    finally:
        W.FILE = monkey
    assert manifest.select("file").distinct().count() > 1
    ids = [r.page_id for r in W.read_chunks(manifest, folder, range_bytes=500).collect()]
    assert sorted(ids) == list(range(60))


def test_damage_is_an_error():
    import io
    import zlib
    r = dict(record_type="response", record_id=hashlib.md5(b"a").hexdigest(), url=None, sha1=hashlib.sha1(b"hello").hexdigest(), target=None, page_id=1, refers_to=None, n_bytes=5, copies=1)
    whole = zlib.compress(W._head(r) + b"hellp\r\n\r\n", wbits=31)
    with pytest.raises(ValueError):
        list(W._records(W._members(io.BytesIO(whole), len(whole))))


def test_a_payload_that_most_rows_share_travels_once(spark):
    """A third of the rows repeat one row, others share its payload: one payload row, heads for all records."""
    rows = [(1, "hot " * 5000)] * 200 + [(k, "hot " * 5000) for k in range(2, 102)] + [(k, f"page {k}") for k in range(200, 300)]
    pages = frame(spark, rows).repartition(4)
    records = W.judged_records(pages).withColumn("head", W.F.lit(b"{}"))
    whole = W.with_payloads(records, pages, 0).collect()
    assert len(whole) == 201 and sum(r.data is not None for r in whole) == 101 and sum(len(r.data or b"") > 1000 for r in whole) == 1
    assert sorted(map(tuple, W.archived(pages).drop("n_chunks").collect()), key=repr) == brute(rows)
