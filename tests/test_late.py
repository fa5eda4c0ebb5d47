from tests.conftest import SF_MID
from vecbench.operators.late import maxsim_search, token_table
from vecbench.sources.testdata import read


def test_maxsim_chunking_invariant(spark):
    toks = token_table(read(spark, SF_MID, "benchmark"), "item_id", "text")
    one = maxsim_search(toks, toks, 5, exclude_self=True)
    many = maxsim_search(toks, toks, 5, exclude_self=True, corpus_chunk_rows=37, query_chunk_rows=23,
                         broadcast_bytes=0)
    a = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in one.collect()}
    b = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in many.collect()}
    assert a == b and len(a) == 5 * read(spark, SF_MID, "benchmark").count()


def test_maxsim_distinct_query_and_doc_tables(spark):
    from pyspark.sql import functions as F
    conv = read(spark, SF_MID, "conversations").withColumn("tid", F.col("conv_id") * 100 + F.col("turn"))
    q = token_table(conv.where("role = 'user'"), "tid", "text")
    d = token_table(conv.where("role = 'assistant'"), "tid", "text")
    a = maxsim_search(q, d, 3)
    b = maxsim_search(q, d, 3, corpus_chunk_rows=500, query_chunk_rows=50, broadcast_bytes=0)
    sa = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in a.collect()}
    sb = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in b.collect()}
    assert sa == sb and len(sa) > 0
