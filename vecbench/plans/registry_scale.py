"""Registered queries that force the paths that large inputs take, each against the exact SQL:
many blocks, tiles instead of a broadcast, the four-product form, salted cells at full probe,
several late-interaction chunks, positions under a payload, and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.slerp import with_slerp
from vecbench.functions.text import fold_values
from vecbench.functions.vectors import format_vector
from vecbench.operators import tasks as T
from vecbench.operators.ann import ivf_search, lsh_search
from vecbench.operators.encode import incremental_encode
from vecbench.operators.late import maxsim_search, token_table
from vecbench.operators.quality import hash_split, triviality
from vecbench.operators.rerank import rerank
from vecbench.operators.search import grid_search, retrieve_top_k, topk_search
from vecbench.plans.registry import ORACLE, SQL_FUSED, _r, register
from vecbench.session import ensure_checkpoint_dir
from vecbench.sources.files import load_dataset, read_predictions, write_table
from vecbench.sources.testdata import embedding_items, read


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hits(h: DataFrame) -> DataFrame:
    return h.select("query_row", "alpha", "beta", "rank", "item_row", _r("score"), "rel")


@register("grid_topk_tiles", ORACLE["grid_topk_hits"])
def grid_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 64 rows in a grid of tiles, no side broadcast, ranks merged by the window."""
    items = embedding_items(spark, sf_dir)
    return _hits(grid_search(items, items, 10, exclude_self=True, broadcast_bytes=0, c_block_rows=64, q_block_rows=64, target_tasks=16))


@register("grid_topk_four_products", ORACLE["grid_topk_hits"])
def grid_topk_four_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores combined from four products of the raw modalities."""
    items = embedding_items(spark, sf_dir)
    return _hits(grid_search(items, items, 10, exclude_self=True, method="four_dot", c_block_rows=100))


@register("flat_topk_tiles", ORACLE["flat_topk"])
def flat_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat search over tiles of small blocks."""
    e = _vectors(spark, sf_dir)
    h = topk_search(e, e, 10, vector="v", exclude_self=True, broadcast_bytes=0, c_block_rows=50, q_block_rows=40, target_tasks=9)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("ivf_topk_all_cells", ORACLE["flat_topk"])
def ivf_topk_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted IVF cells, every cell probed: the exact result."""
    e = _vectors(spark, sf_dir)
    h = ivf_search(e, e, 10, vector="v", exclude_self=True, nlist=6, nprobe=6, cell_rows=32)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("lsh_topk_all_codes", ORACLE["flat_topk"])
def lsh_topk_all_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one-bit codes with their flip visit every salted cell: the exact result."""
    e = _vectors(spark, sf_dir)
    return lsh_search(e, e, 10, vector="v", exclude_self=True, bits=1, probes=2, cell_rows=32).select("query_row", "rank", "item_row", _r("score"))


@register("late_interaction_chunks", ORACLE["late_interaction"])
def late_interaction_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim over many chunks of tokens, in tiles."""
    toks = token_table(read(spark, sf_dir, "benchmark"), "item_id", "text")
    h = maxsim_search(toks, toks, 5, exclude_self=True, corpus_chunk_rows=100, query_chunk_rows=80, broadcast_bytes=0)
    return h.select(F.col("query_id").alias("query_row"), "rank", F.col("doc_id").alias("item_row"), _r("score"))


@register("line_positions", """
SELECT l_orderkey, l_linenumber, l_returnflag,
       row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS running
FROM lineitem""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23's distributed running sum and position, with a payload column (whole lineitem)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("q"))
    out = T.global_cumulative(li, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], "q", "running", "pos")
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "pos", F.col("running").cast("bigint").alias("running"))


@register("stored_encoding_topk", ORACLE["flat_topk"])
def stored_encoding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode into the store, run again (nothing new), search the stored vectors."""
    e = _vectors(spark, sf_dir).withColumn("text", F.col("row_id").cast("string"))
    store = _folder(spark, "store")
    for _ in range(2):
        stored = incremental_encode(spark, e.drop("v"), store, encoder_name="table", config="{}", dataset="embeddings", side="catalog", key_cols=["text"],
                                    encode_fn=lambda df: df.join(e.select("row_id", "v"), "row_id"), vector_cols=["v"])
    return topk_search(stored, stored, 10, vector="v", exclude_self=True).select("query_row", "rank", "item_row", _r("score"))


@register("saved_predictions_rerank", ORACLE["rerank_two_stage"])
def saved_predictions_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-stage predictions written, read back and re-ranked with fused vectors."""
    items = embedding_items(spark, sf_dir)
    folder = _folder(spark, "predictions")
    write_table(topk_search(items, items, 50, vector="text_embedding", exclude_self=True), folder)
    fused = with_slerp(items, "text_embedding", "image_embedding", F.lit(0.5), out="f")
    out = rerank(read_predictions(spark, folder), fused, fused, "f", top_k=50, keep=10)
    return out.select("query_row", F.col("rank").cast("int").alias("rank"), "item_row", _r("score"))


@register("held_out_regression")
def held_out_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R^2 of a linear regression on held-out rows (tests check a planted relation)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    s = hash_split(e, "row_id", 0.3)
    return T.regression_r2(s.where("split = 'train'"), "v", "label", s.where("split = 'test'")).select(_r("r2"), "n")


@register("logistic_classification")
def logistic_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on a hash split: accuracy and macro F1 of the held-out rows."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    s = hash_split(e, "row_id", 0.3)
    pred = T.logistic_classification(s.where("split = 'train'"), s.where("split = 'test'"), "v", "label")
    return T.classification_report(pred).select(_r("accuracy"), _r("macro_f1"), "n")


@register("csv_scan", """
SELECT 'img/' || vec_id || '.jpg' AS image_path, CAST(label AS VARCHAR) AS id, 'item "' || vec_id || '",' || chr(10) || 'second line' AS text,
       '{"label": ' || label || '}' AS metadata, len(embedding) AS n_dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_element
FROM embeddings""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table written as a catalog CSV (quotes, commas, line breaks) and read back."""
    e = read(spark, sf_dir, "embeddings")
    base = _folder(spark, "csv")
    n = F.col("vec_id").cast("string")
    rows = e.select(F.col("label").cast("string").alias("id"), F.concat(F.lit('item "'), n, F.lit('",\nsecond line')).alias("text"),
                    F.concat(F.lit("img/"), n, F.lit(".jpg")).alias("image_path"),
                    F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit("}")).alias("metadata"),
                    format_vector(F.col("embedding").cast("array<double>")).alias("text_embedding"))
    for side in ("catalog", "test"):
        rows.write.option("header", True).option("escape", '"').option("quote", '"').csv(f"{base}/items/{side}")
    catalog, _ = load_dataset(spark, base, "items")
    return catalog.select("image_path", "id", "text", "metadata", F.size("text_embedding").cast("bigint").alias("n_dims"),
                          F.round(F.col("text_embedding")[0], 6).alias("first_element"))


@register("retrieve_top_k", SQL_FUSED.lstrip().replace("items AS", "WITH items AS", 1) + """,
u AS (SELECT row_id, w, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS v FROM fused),
s AS (SELECT q.row_id AS query_row, c.row_id AS item_row, list_dot_product(q.v, c.v) AS score
      FROM u q JOIN u c ON q.row_id <> c.row_id WHERE q.w = 0.25 AND c.w = 0.75),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s)
SELECT query_row, CAST(rank AS INTEGER) AS rank, item_row, round(score, 6) AS score FROM r WHERE rank <= 5""")
def retrieve_top_k_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top-5 of every row by the cosine of fused vectors at one (alpha, beta)."""
    items = embedding_items(spark, sf_dir)
    h = retrieve_top_k(items, items, 0.25, 0.75, 5, exclude_self=True)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("folded_languages", """
SELECT CASE WHEN lang IN ('de', 'fr', 'es') THEN 'other' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY 1""")
def folded_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values folded into one, then counted."""
    d = read(spark, sf_dir, "documents")
    return d.select(fold_values("lang", ["de", "fr", "es"], "other").alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@register("trivial_tasks", """
WITH m AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS mean FROM embeddings GROUP BY label),
b AS (SELECT label, avg(CAST(embedding[2] AS DOUBLE)) AS mean FROM embeddings GROUP BY label)
SELECT label, round(m.mean, 6) AS mean, m.mean >= 0.05 AS too_easy, abs(m.mean - b.mean) < 0.02 AS near_random FROM m JOIN b USING (label)""")
def trivial_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: scores compared with a ceiling and a baseline."""
    e = read(spark, sf_dir, "embeddings")
    mean = lambda k: e.groupBy("label").agg(F.avg(F.col("embedding")[k].cast("double")).alias("mean"))
    return triviality(mean(0), mean(1), ["label"], high=0.05, margin=0.02).select("label", _r("mean"), "too_easy", "near_random")
