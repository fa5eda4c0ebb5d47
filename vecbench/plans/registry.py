"""Registered queries over the driver's tables, each with an independent DuckDB oracle.

Every query reads whole tables. The embedding protocol (see
``sources.testdata``): every vector is a query against all other vectors,
relevance = same label; text modality = the embedding, image modality = the
embedding rotated by 16. Outputs are rounded to 6 digits and use the same
column names in Spark and SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.slerp import with_slerp
from vecbench.functions.vectors import with_cosine
from vecbench.operators.relevance import match_stats, relevance_info
from vecbench.operators.search import grid_search, topk_search
from vecbench.plans.evaluate import evaluate_dataset
from vecbench.sources.testdata import embedding_items, read

R = 6  # output rounding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(c: str, alias: str | None = None):
    return F.round(F.col(c), R).alias(alias or c)


# ---------------------------------------------------------------- SQL pieces
SQL_ITEMS = """
items AS (
  SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS id,
         CAST(embedding AS DOUBLE[]) AS t,
         list_concat(list_slice(CAST(embedding AS DOUBLE[]), 17, len(embedding)),
                     list_slice(CAST(embedding AS DOUBLE[]), 1, 16)) AS i
  FROM embeddings)"""

# slerp of (t, i) under every weight of the grid, written the direct way:
# normalise, interpolate, renormalise.
SQL_FUSE_STEPS = """
weights AS (SELECT unnest(CAST([0.0, 0.25, 0.5, 0.75, 1.0] AS DOUBLE[])) AS w),
unit AS (
  SELECT row_id, id,
         list_transform(t, lambda x: x / (sqrt(list_dot_product(t, t)) + 1e-8)) AS a,
         list_transform(i, lambda x: x / (sqrt(list_dot_product(i, i)) + 1e-8)) AS b
  FROM items),
ang AS (
  SELECT *, greatest(-1.0, least(1.0, list_dot_product(a, b))) AS d FROM unit),
coef AS (
  SELECT row_id, id, a, b, d, weights.w AS w,
         (abs(d) > 0.9995 OR sin(acos(abs(d))) < 1e-6) AS lin,
         acos(abs(d)) AS th
  FROM ang, weights),
mix AS (
  SELECT row_id, id, w, a, b,
         CASE WHEN lin THEN 1 - w ELSE sin((1 - w) * th) / sin(th) END AS f1,
         CASE WHEN lin THEN w
              WHEN d < 0 THEN -(sin(w * th) / sin(th))
              ELSE sin(w * th) / sin(th) END AS f2
  FROM coef),
raw AS (
  SELECT row_id, id, w, a, b,
         list_transform(range(1, len(a) + 1), lambda j: f1 * a[j] + f2 * b[j]) AS r
  FROM mix),
fused AS (
  SELECT row_id, id, w,
         CASE WHEN w <= 0 THEN a
              WHEN w >= 1 THEN b
              ELSE list_transform(r, lambda x: x / (sqrt(list_dot_product(r, r)) + 1e-8)) END AS v
  FROM raw)"""
SQL_FUSED = SQL_ITEMS + "," + SQL_FUSE_STEPS

SQL_GRID_HITS = SQL_FUSED + """,
scored AS (
  SELECT q.row_id AS query_row, q.id AS query_key, q.w AS alpha, c.w AS beta,
         c.row_id AS item_row, c.id AS item_key, list_dot_product(q.v, c.v) AS score
  FROM fused q JOIN fused c ON q.row_id <> c.row_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_row, alpha, beta
                               ORDER BY round(score, 9) DESC, item_row) AS rank
  FROM scored)"""

SQL_REL = """
relinfo AS (
  SELECT q.row_id AS query_row,
         (SELECT count(*) FROM items c WHERE c.id = q.id AND c.row_id <> q.row_id) AS n_rel,
         (SELECT count(*) FROM items) - 1 AS n_cand
  FROM items q)"""

SQL_GRID_NDCG = SQL_GRID_HITS + "," + SQL_REL + """,
ks AS (SELECT unnest([1, 5, 10, 50]) AS k),
dcg AS (
  SELECT query_row, alpha, beta, k,
         sum(CASE WHEN rank <= k AND query_key = item_key THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM ranked, ks WHERE rank <= 50 GROUP BY query_row, alpha, beta, k),
nd AS (
  SELECT dcg.query_row, alpha, beta, dcg.k,
         coalesce(list_sum(list_transform(range(1, least(n_rel, least(dcg.k, n_cand)) + 1),
                                          lambda i: 1.0 / log2(i + 1))), 0) AS idcg, dcg.dcg
  FROM dcg JOIN relinfo USING (query_row)),
per_query AS (
  SELECT query_row, alpha, beta, k, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM nd)"""


# ------------------------------------------------------------ grid evaluation
def _grid_eval(spark: SparkSession, sf_dir: str):
    items = embedding_items(spark, sf_dir)
    return evaluate_dataset(items, items, dataset="embeddings", exclude_self=True)


@register("grid_ndcg", SQL_GRID_NDCG.lstrip().replace("items AS", "WITH items AS", 1) + """
SELECT alpha, beta, k, round(avg(ndcg), 6) AS ndcg_mean, round(stddev_pop(ndcg), 6) AS ndcg_std,
       round(min(ndcg), 6) AS ndcg_min, round(max(ndcg), 6) AS ndcg_max, count(*) AS n_queries
FROM per_query GROUP BY alpha, beta, k""")
def grid_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + A2-A6 + W7: NDCG@{1,5,10,50} summary for all 25 (alpha, beta)."""
    m = _grid_eval(spark, sf_dir).metrics
    return m.select("alpha", "beta", "k", _r("mean", "ndcg_mean"), _r("std", "ndcg_std"),
                    _r("min", "ndcg_min"), _r("max", "ndcg_max"), "n_queries")


@register("grid_best_params", SQL_GRID_NDCG.lstrip().replace("items AS", "WITH items AS", 1) + """,
summary AS (SELECT alpha, beta, avg(ndcg) AS mean, count(*) AS n FROM per_query WHERE k = 5
            GROUP BY alpha, beta),
best AS (SELECT *, row_number() OVER (ORDER BY round(mean, 9) DESC, alpha, beta) AS r FROM summary)
SELECT 'embeddings' AS dataset,
       CASE WHEN mean > 0 THEN alpha ELSE 0.5 END AS best_alpha,
       CASE WHEN mean > 0 THEN beta ELSE 0.5 END AS best_beta,
       round(CASE WHEN mean > 0 THEN mean ELSE 0.0 END, 6) AS best_ndcg,
       n AS n_queries, mean > 0 AS found
FROM best WHERE r = 1""")
def grid_best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best (alpha, beta) by mean NDCG@5 with the fallback rule."""
    b = _grid_eval(spark, sf_dir).best
    return b.select("dataset", "best_alpha", "best_beta", _r("best_ndcg"), "n_queries", "found")


@register("grid_topk_hits", SQL_GRID_HITS.lstrip().replace("items AS", "WITH items AS", 1) + """
SELECT query_row, alpha, beta, CAST(rank AS INTEGER) AS rank, item_row, round(score, 6) AS score,
       CAST(query_key = item_key AS DOUBLE) AS rel
FROM ranked WHERE rank <= 10""")
def grid_topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 items per (query, alpha, beta) over fused vectors."""
    items = embedding_items(spark, sf_dir)
    h = grid_search(items, items, 10, exclude_self=True)
    return h.select("query_row", "alpha", "beta", "rank", "item_row", _r("score"), "rel")


@register("flat_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_row, c.vec_id AS item_row, list_dot_product(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank
      FROM s)
SELECT query_row, CAST(rank AS INTEGER) AS rank, item_row, round(score, 6) AS score FROM r WHERE rank <= 10""")
def flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact inner-product top-10 of the raw embeddings (flat search)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    h = topk_search(e, e, 10, vector="embedding", exclude_self=True)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("slerp_fused", SQL_FUSED.lstrip().replace("items AS", "WITH items AS", 1) + """
SELECT row_id, w AS t, CAST(j AS INTEGER) AS dim, round(v[j], 6) AS value
FROM fused, range(1, 65) r(j) WHERE w IN (0.25, 0.5, 0.75)""")
def slerp_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1/F2: slerp(text, image, t) for t in {0.25, 0.5, 0.75}, long form."""
    items = embedding_items(spark, sf_dir)
    ts = items.withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])))
    f = with_slerp(ts, "text_embedding", "image_embedding", "t", out="fused")
    return f.select("row_id", "t", F.posexplode("fused").alias("pos", "v")).select(
        "row_id", "t", (F.col("pos") + 1).cast("int").alias("dim"), _r("v", "value"))


@register("modality_cosine", SQL_ITEMS.lstrip().replace("items AS", "WITH items AS", 1) + """
SELECT row_id, round(list_dot_product(t, i) / ((sqrt(list_dot_product(t, t)) + 1e-8)
                                             * (sqrt(list_dot_product(i, i)) + 1e-8)), 6) AS cosine
FROM items""")
def modality_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine between the two modalities of every row."""
    items = embedding_items(spark, sf_dir)
    return with_cosine(items, "text_embedding", "image_embedding").select("row_id", _r("cosine"))


@register("relevance_counts", SQL_ITEMS.lstrip().replace("items AS", "WITH items AS", 1) + "," + SQL_REL + """
SELECT query_row, n_rel, n_cand FROM relinfo""")
def relevance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows sharing the query's id (leave-one-out) and candidates."""
    items = embedding_items(spark, sf_dir)
    return relevance_info(items, items, exclude_self=True).select("query_row", "n_rel", "n_cand")


@register("match_stats", SQL_ITEMS.lstrip().replace("items AS", "WITH items AS", 1) + "," + SQL_REL + """
SELECT count(*) AS n_queries, count(*) FILTER (WHERE n_rel > 0) AS n_matched,
       CAST(sum(n_rel) AS BIGINT) AS total_matches, round(avg(n_rel), 6) AS avg_matches FROM relinfo""")
def match_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with at least one match; matches per query."""
    items = embedding_items(spark, sf_dir)
    s = match_stats(relevance_info(items, items, exclude_self=True))
    return s.select("n_queries", "n_matched", "total_matches", _r("avg_matches"))


# the remaining registrations live in sibling modules (imported for their side effect)
from vecbench.plans import registry_tables  # noqa: E402,F401
from vecbench.plans import registry_tasks  # noqa: E402,F401
from vecbench.plans import registry_bench  # noqa: E402,F401
from vecbench.plans import registry_scale  # noqa: E402,F401
from vecbench.plans import registry_more  # noqa: E402,F401
