import hashlib
import re

import duckdb
import pytest
from cases import documents, empty, prose

from vecbench.llm import fim as M
from vecbench.llm.registry import ORACLE

EXTRA = [(20, "a<P>b"), (21, "ends with <"), (22, "<S"), (23, "é" * 30 + " naïve Ünits 漢字 x"), (24, "a"), (25, "<<<P M> <S >" * 5),
         (26, prose(7, 20_000)), (-4, "negative id " * 9), (27, "\x00null \x00 byte")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    key = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_brute_force_and_restores(spark):
    docs = documents(spark).unionByName(documents(spark, EXTRA + [(100 + k, prose(k, k % 9)) for k in range(60)]))
    source = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = M.fill_in_middle(docs)
    rows = out.collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    want = [brute(d, t) for d, t in source]
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows], key=repr) == sorted(want, key=repr)
    assert all(r.output_sha256 == sha(r.output) for r in rows)
    texts = sorted([t or "" for _, t in source])
    assert sorted(r.restored_sha256 for r in rows) == sorted(map(sha, texts))
    back = M.restore_texts(out.withColumnRenamed("n", "TEXT"))
    assert sorted(r.text for r in back.select("text").collect()) == texts


def test_sql_on_awkward_rows(spark, scratch):
    docs = documents(spark).unionByName(documents(spark, EXTRA)).select("doc_id", "text")
    docs.write.parquet(f"{scratch}/documents")
    duckdb.sql(f"create or replace temp view documents as select * from '{scratch}/documents/*.parquet'")
    got = M.fill_in_middle(docs, with_output=False)
    want = duckdb.sql(f"select {', '.join(got.columns)} from ({ORACLE['op12_piece_table']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_table_and_null_output(spark):
    assert M.fill_in_middle(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "psm"), ("x", "plain")], "output string, form string")
    assert {r.text for r in M.restore_texts(rows).collect()} == {None, "x"}


def test_broken_outputs_fail():
    for text in (b"<P>a<S>b", b"a<P><S><M>", b""):
        with pytest.raises(ValueError):
            M.parsed(text, "psm")


def test_piece_table_shares_its_buffers():
    table = M.PieceTable(b"0123456789")
    table.cut(3)
    table.cut(7)
    table.arrange("spm")
    assert table.text() == b"<S>789<P>012<M>3456" and table.pieces[1] == (0, 7, 3)
    table.restore("spm")
    assert table.text() == b"0123456789" and all(b == 0 for b, _, _ in table.pieces)


def test_other_rates(spark):
    docs = documents(spark, [(k, prose(k, 5)) for k in range(80)])
    assert {r.form for r in M.fill_in_middle(docs, M.Rates(transformed=100, spm=100)).collect()} == {"spm"}
    assert {r.form for r in M.fill_in_middle(docs, M.Rates(transformed=0)).collect()} == {"plain"}
