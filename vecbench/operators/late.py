"""Late interaction (F11): MaxSim scoring over token vectors, and chunked
corpus search (F12).

score(query, doc) = sum over the query's tokens of the max over the doc's
tokens of the token inner product. Every token is one row (``row_id`` =
text id * 2^20 + position, so a text's tokens are contiguous in row order).
Doc tokens are packed into blocks that never split a document (the corpus
chunk is the block, ``corpus_chunk_rows`` tokens), query tokens likewise per
query, so each block pair gives exact scores for the (query, doc) pairs it
holds. Products are taken in tiles of fixed size: a running maximum a document over
the tiles of its tokens, then a running sum a query over the tiles of its own, so
texts of any length need the vectors of their block, one tile of products and a tile's
maxima (``QUERY_TILE`` rows). Only k rows per query leave a block pair; a final
window keeps k per query.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecbench.functions.hashing import hash_vector
from vecbench.operators.blocks import pack_blocks, prefixed, unpack
from vecbench.operators.search import (SCORE_DIGITS, _select_topk, broadcast_limit_bytes, pair_blocks,
                                       table_stats)

MAXSIM_SCHEMA = "query_id bigint, doc_id bigint, rank int, score double"
# Tokens of a tile of products: 16 MB in float64.
QUERY_TILE, DOC_TILE = 512, 4096
# Fixed value: a token is a maximal run of letters or digits (after lower-casing).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Lower-cased word tokens of the whole text (empty pieces dropped)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda w: w != "")


def token_table(df: DataFrame, id_col: str, text_col: str, dim: int = 8, salt: str = "tok") -> DataFrame:
    """One row per token: ``row_id``, ``text_id``, ``token``, ``v`` (hash token vector).

    The vector is computed per row (no join to a vocabulary), so frequent
    tokens never become a hot join key.
    """
    t = df.select(F.col(id_col).cast("bigint").alias("text_id"), F.posexplode(words(text_col)).alias("pos", "token"))
    # ids grow along a partition, so a text's tokens are adjacent in their order
    return t.select(F.monotonically_increasing_id().alias("row_id"),
                    "text_id", "pos", "token", hash_vector("token", dim, salt).alias("v"))


def segments(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def together(starts: np.ndarray, n: int, most: int):
    """(first, end) of stretches of whole segments with at most ``most`` rows together; a longer one stands alone."""
    ends, a = np.r_[starts[1:], n], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, "right")))
        yield a, b
        a = b


def maxsim(q: np.ndarray, qs: np.ndarray, c: np.ndarray, cs: np.ndarray, first: int, end: int) -> np.ndarray:
    """Scores of the queries ``first`` to ``end`` (segments ``qs`` of ``q``) by the documents (segments ``cs`` of ``c``)."""
    total = np.zeros((end - first, len(cs)))
    stop = qs[end] if end < len(qs) else len(q)
    for lo in range(int(qs[first]), int(stop), QUERY_TILE):
        hi = min(lo + QUERY_TILE, int(stop))
        best = np.full((hi - lo, len(cs)), -np.inf)
        for at in range(0, len(c), DOC_TILE):
            products = q[lo:hi] @ c[at : at + DOC_TILE].T
            d0, d1 = int(np.searchsorted(cs, at, "right")) - 1, int(np.searchsorted(cs, at + DOC_TILE, "left"))
            own = np.maximum.reduceat(products, np.maximum(cs[d0:d1], at) - at, axis=1)
            np.maximum(best[:, d0:d1], own, out=best[:, d0:d1])
        q0, q1 = int(np.searchsorted(qs, lo, "right")) - 1, int(np.searchsorted(qs, hi, "left"))
        total[q0 - first : q1 - first] += np.add.reduceat(best, np.maximum(qs[q0:q1], lo) - lo, axis=0)
    return total


def _pair_maxsim(k: int, exclude_self: bool):
    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                _, qkey, q, _, _, _ = unpack(batch, j, "q_")
                _, ckey, c, _, _, _ = unpack(batch, j, "c_")
                if len(qkey) == 0 or len(ckey) == 0:
                    continue
                qs, cs = segments(qkey), segments(ckey)
                dids = ckey[cs].astype(np.int64)
                for a, b in together(qs, len(qkey), QUERY_TILE):
                    p, qids = maxsim(q, qs, c, cs, a, b), qkey[qs[a:b]].astype(np.int64)
                    if exclude_self:
                        p = np.where(qids[:, None] == dids[None, :], -np.inf, p)
                    r, d, rank = _select_topk(p, k)
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array(qids[r], pa.int64()), "doc_id": pa.array(dids[d], pa.int64()),
                        "rank": pa.array(rank.astype(np.int32), pa.int32()), "score": pa.array(p[r, d], pa.float64())})
    return run


def maxsim_search(query_tokens: DataFrame, doc_tokens: DataFrame, k: int = 10, *,
                  exclude_self: bool = False, corpus_chunk_rows: int = 8192,
                  query_chunk_rows: int = 4096, broadcast_bytes: int | None = None) -> DataFrame:
    """top-k documents per query by MaxSim. Inputs from :func:`token_table`."""
    spark = query_tokens.sparkSession
    n_doc_tok, dim = table_stats(doc_tokens, ["v"])
    dim = max(dim, 1)
    n_q_tok = n_doc_tok if query_tokens is doc_tokens else query_tokens.count()
    if n_doc_tok == 0 or n_q_tok == 0:
        return spark.createDataFrame([], MAXSIM_SCHEMA)
    limit = broadcast_limit_bytes(spark) if broadcast_bytes is None else broadcast_bytes
    tok_bytes = dim * 8 + 64
    tasks = spark.sparkContext.defaultParallelism
    # a text's tokens are adjacent in their partition (one posexplode), so the
    # token tables are packed where they lie
    cb = prefixed(pack_blocks(doc_tokens, corpus_chunk_rows, key="text_id", text="v",
                              image=None, group="text_id", whole_groups=True, pre_grouped=True), "c_")
    q_in = (query_tokens.repartition(tasks, "text_id").sortWithinPartitions("text_id", "row_id")
            if n_q_tok * (dim * 8 + 64) <= limit else query_tokens)
    qb = prefixed(pack_blocks(q_in, query_chunk_rows, key="text_id", text="v", image=None,
                              group="text_id", whole_groups=True, pre_grouped=True), "q_")
    pairs = pair_blocks(qb, cb, n_q_tok * tok_bytes, n_doc_tok * tok_bytes, limit, tasks)
    hits = pairs.mapInArrow(_pair_maxsim(k, exclude_self), MAXSIM_SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
