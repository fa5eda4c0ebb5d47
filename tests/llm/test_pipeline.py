import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from vecbench.llm.registry import ORACLE, QUERIES
from test_minhash import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    """Each stage against the brute force or the result of its operator on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "toxicity", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    from test_decontaminate import brute as contained
    from test_quality import base, llrs
    from test_tokens import check_packing, ids as library_ids
    from test_toxicity import brute_score
    from vecbench.llm.common import settle
    from vecbench.llm.packing import Capacity
    from vecbench.llm.quality import THRESHOLD
    from vecbench.llm.toxicity import learn
    for name, stage in P.STAGES[:4]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = settle(stage(spark, docs, SF), name)
        assert sorted(out.columns) == sorted(docs.columns)
        if name == "quality_rules":
            trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}
            want = sorted(d for (d, t), s in zip(rows, llrs(rows, trusted), strict=True) if not base(t)[5] and s >= THRESHOLD)
        elif name == "toxicity":
            lexicon = learn(docs, labels)
            want = sorted(d for d, t in rows if brute_score(lexicon, t)[0] < 0.7)
        elif name == "minhash_near_dedup":
            want = sorted(c[0] for c in components(rows) if c[3])
        else:
            want = sorted({d for d, _ in rows} - {c[0] for c in contained(rows, [(r.item_id, r.text) for r in items.collect()])})
        assert ids(out) == want, name
        docs = out
    packed = P.STAGES[4][1](spark, docs, SF).collect()
    check_packing(packed, Capacity())
    pieces = [(r.doc_id, k // 2048, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
              for r in docs.collect() for whole in [library_ids(r.text) + [0]] for k in range(0, len(whole), 2048) for p in [whole[k : k + 2048]]]
    assert sorted(tuple(r)[:5] for r in packed) == sorted(pieces)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    assert sorted(con.sql(ORACLE[name]).columns) == sorted(got.columns)
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall()
    rows = lambda x: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x)
    assert rows(got.collect()) == rows(want)


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
