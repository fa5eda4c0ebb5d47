import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbench.functions.slerp import slerp_np
from vecbench.operators.search import grid_search, topk_search


def brute(Q, C, qid, cid, alphas, betas, k, exclude_self, qkeys=None, ckeys=None):
    out = set()
    for a in alphas:
        qf = slerp_np(Q[0], Q[1], a, has1=Q[2], has2=Q[3])
        for b in betas:
            cf = slerp_np(C[0], C[1], b, has1=C[2], has2=C[3])
            S = qf @ cf.T
            for i in range(len(qid)):
                cand = [(round(S[i, j], 9), cid[j], S[i, j]) for j in range(len(cid))
                        if not (exclude_self and cid[j] == qid[i])]
                cand.sort(key=lambda x: (-x[0], x[1]))
                for r, (_, c, s) in enumerate(cand[:k], start=1):
                    out.add((qid[i], a, b, r, c, round(s, 9)))
    return out


def make(spark, n, d, seed, null_image=(), ties=False):
    rng = np.random.default_rng(seed)
    T = rng.standard_normal((n, d))
    I = rng.standard_normal((n, d))
    if ties:
        T[1::3] = T[0]  # identical text vectors -> exactly tied scores
        I[1::3] = I[0]
    hi = np.ones(n, bool)
    rows = []
    for i in range(n):
        img = None if i in null_image else I[i].tolist()
        if img is None:
            hi[i] = False
            I[i] = 0
        rows.append((int(i * 3 + 1), str(i % 4), T[i].tolist(), img))
    df = spark.createDataFrame(rows, "row_id bigint, id string, text_embedding array<double>, "
                                     "image_embedding array<double>")
    return df, (T, I, np.ones(n, bool), hi), [r[0] for r in rows]


@pytest.mark.parametrize("cfg", [
    dict(),                                                     # one catalog block, broadcast catalog
    dict(c_block_rows=7, q_block_rows=5),                       # many blocks + final rank window
    dict(c_block_rows=9, q_block_rows=4, broadcast_bytes=0),    # shuffle pairing, no broadcast
])
def test_grid_search_matches_brute_force(spark, cfg):
    df, M, ids = make(spark, 23, 6, 1, null_image={2, 5}, ties=True)
    alphas, betas = (0.0, 0.3, 1.0), (0.0, 0.6, 1.0)
    got = grid_search(df, df, 4, alphas=alphas, betas=betas, exclude_self=True, **cfg).collect()
    got = {(r.query_row, r.alpha, r.beta, r.rank, r.item_row, round(r.score, 9)) for r in got}
    exp = brute(M, M, ids, ids, alphas, betas, 4, True)
    assert got == exp


def test_repartition_invariance(spark):
    df, M, ids = make(spark, 30, 5, 3)
    base = None
    for parts in (1, 7, 64):
        h = grid_search(df.repartition(parts), df.repartition(parts), 3, alphas=(0.5,), betas=(0.5,),
                        c_block_rows=8, q_block_rows=6)
        s = {(r.query_row, r.rank, r.item_row) for r in h.collect()}
        base = base or s
        assert s == base


def test_topk_raw_and_catalog_smaller_than_k(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "row_id bigint, v array<double>")
    h = topk_search(df, df, 10, vector="v", exclude_self=True).orderBy("query_row", "rank").collect()
    assert [(r.query_row, r.rank, r.item_row) for r in h] == [
        (1, 1, 3), (1, 2, 2), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]


def test_relevant_only_keeps_global_ranks(spark):
    df, M, ids = make(spark, 25, 4, 5)
    full = grid_search(df, df, 6, alphas=(0.5,), betas=(0.5,), exclude_self=True, c_block_rows=6)
    rel = grid_search(df, df, 6, alphas=(0.5,), betas=(0.5,), exclude_self=True, c_block_rows=6,
                      relevant_only=True)
    a = {(r.query_row, r.rank, r.item_row) for r in full.where(F.col("rel") > 0).collect()}
    b = {(r.query_row, r.rank, r.item_row) for r in rel.collect()}
    assert a == b


def test_retrieve_top_k_single_query(spark):
    from vecbench.operators.search import retrieve_top_k
    df, M, ids = make(spark, 15, 4, 9)
    q = df.where("row_id = 1")
    got = [(r.rank, r.item_row) for r in retrieve_top_k(q, df, 0.25, 0.75, k=5, similarity="ip").collect()]
    exp = sorted((r, c) for (qr, a, b, r, c, s) in brute(M, M, ids, ids, (0.25,), (0.75,), 5, False)
                 if qr == 1)
    assert got == exp


def test_cosine_similarity_option(spark):
    from vecbench.operators.search import retrieve_top_k
    # a raw (unfused, text-only) catalog of unequal lengths: cosine and inner product rank differently
    rows = [(1, [1.0, 0.0]), (2, [10.0, 10.0]), (3, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "row_id bigint, text_embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "row_id bigint, text_embedding array<double>")
    cos = [r.item_row for r in retrieve_top_k(q, df, 0.0, 0.0, k=3, key=None, image=None).collect()]
    ip = [r.item_row for r in retrieve_top_k(q, df, 0.0, 0.0, k=3, key=None, image=None,
                                             similarity="ip").collect()]
    assert cos == [1, 3, 2] and ip == [2, 1, 3]


def test_float32_products_agree_with_float64(spark):
    df, M, ids = make(spark, 40, 16, 21)
    a = grid_search(df, df, 5, alphas=(0.5,), betas=(0.5,), exclude_self=True).collect()
    b = grid_search(df, df, 5, alphas=(0.5,), betas=(0.5,), exclude_self=True, precision="float32").collect()
    sa = {(r.query_row, r.item_row) for r in a}
    sb = {(r.query_row, r.item_row) for r in b}
    assert len(sa & sb) / len(sa) >= 0.98
    s64 = {(r.query_row, r.item_row): r.score for r in a}
    assert max(abs(s64[key] - r.score) for r in b if (key := (r.query_row, r.item_row)) in s64) < 1e-5


@pytest.mark.parametrize("similarity", ["ip", "cosine"])
def test_four_dot_equals_direct_fusion(spark, similarity):
    df, M, ids = make(spark, 30, 12, 31, null_image={3})
    kw = dict(alphas=(0.0, 0.3, 1.0), betas=(0.0, 0.6, 1.0), exclude_self=True, similarity=similarity)
    direct = grid_search(df, df, 4, method="direct", **kw).collect()
    four = grid_search(df, df, 4, method="four_dot", **kw).collect()
    a = {(r.query_row, r.alpha, r.beta, r.rank, r.item_row) for r in direct}
    b = {(r.query_row, r.alpha, r.beta, r.rank, r.item_row) for r in four}
    assert a == b
    sa = {(r.query_row, r.alpha, r.beta, r.item_row): r.score for r in direct}
    assert max(abs(sa[(r.query_row, r.alpha, r.beta, r.item_row)] - r.score) for r in four) < 1e-12
