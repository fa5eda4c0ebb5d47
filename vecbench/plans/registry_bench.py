"""Registered queries for Entry 2 (every encoder on every dataset) and its
summaries (A8, A9, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.vectors import normalize
from vecbench.operators import compare as C
from vecbench.operators.grid import parameter_distribution, run_summary
from vecbench.plans.benchmark import benchmark_all
from vecbench.plans.registry import (SQL_FUSE_STEPS, SQL_GRID_HITS, SQL_ITEMS, SQL_REL, _r, register)
from vecbench.sources.testdata import embedding_items

ENCODERS = {
    "precomputed": lambda df: df,
    "normalized": lambda df: df.withColumn("text_embedding", normalize("text_embedding"))
                               .withColumn("image_embedding", normalize("image_embedding")),
    "text_only": lambda df: df.withColumn("image_embedding", F.lit(None).cast("array<double>")),
    # bad input: an encoder that leaves one element of every vector without a value
    "broken": lambda df: df.withColumn("text_embedding", F.transform("text_embedding", lambda x, i: F.when(i != 7, x))),
}


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = embedding_items(spark, sf_dir)
    return benchmark_all(spark, {"embeddings": (items, items, True)}, ENCODERS)


# ---------------------------------------------------------------- oracle SQL
def _best_from(per_query_ctes: str, encoder: str) -> str:
    return f"""(WITH {per_query_ctes},
summary AS (SELECT alpha, beta, avg(ndcg) AS mean, count(*) AS n FROM per_query WHERE k = 5 GROUP BY alpha, beta),
best AS (SELECT *, row_number() OVER (ORDER BY round(mean, 9) DESC, alpha, beta) AS r FROM summary)
SELECT '{encoder}' AS encoder, 'embeddings' AS dataset,
       CASE WHEN mean > 0 THEN alpha ELSE 0.5 END AS best_alpha, CASE WHEN mean > 0 THEN beta ELSE 0.5 END AS best_beta,
       CASE WHEN mean > 0 THEN mean ELSE 0.0 END AS best_ndcg, n AS n_queries, mean > 0 AS found,
       CAST(NULL AS VARCHAR) AS error
FROM best WHERE r = 1)"""


_NDCG_TAIL = """,
ks AS (SELECT unnest([1, 5, 10, 50]) AS k),
dcg AS (SELECT query_row, alpha, beta, k,
               sum(CASE WHEN rank <= k AND query_key = item_key THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg
        FROM ranked, ks WHERE rank <= 50 GROUP BY query_row, alpha, beta, k),
nd AS (SELECT dcg.query_row, alpha, beta, dcg.k,
              coalesce(list_sum(list_transform(range(1, least(n_rel, least(dcg.k, n_cand)) + 1),
                                               lambda i: 1.0 / log2(i + 1))), 0) AS idcg, dcg.dcg
       FROM dcg JOIN relinfo USING (query_row)),
per_query AS (SELECT query_row, alpha, beta, k, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM nd)"""

# precomputed: the grid over the raw vectors
_PRE = SQL_GRID_HITS.lstrip() + "," + SQL_REL + _NDCG_TAIL

# normalized: both modalities normalised (with eps) first, then the same grid
_NORM_ITEMS = SQL_ITEMS.replace("items AS (", "raw_items AS (", 1) + """,
items AS (SELECT row_id, id, list_transform(t, lambda x: x / (sqrt(list_dot_product(t, t)) + 1e-8)) AS t,
                 list_transform(i, lambda x: x / (sqrt(list_dot_product(i, i)) + 1e-8)) AS i FROM raw_items)"""
_NORM = (_NORM_ITEMS.lstrip() + "," + SQL_FUSE_STEPS + """,
scored AS (SELECT q.row_id AS query_row, q.id AS query_key, q.w AS alpha, c.w AS beta,
                  c.row_id AS item_row, c.id AS item_key, list_dot_product(q.v, c.v) AS score
           FROM fused q JOIN fused c ON q.row_id <> c.row_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row, alpha, beta
                                        ORDER BY round(score, 9) DESC, item_row) AS rank FROM scored),"""
         + SQL_REL + _NDCG_TAIL)

# text_only: a missing modality leaves the other one raw, for every weight
_TEXT = (SQL_ITEMS.lstrip() + """,
weights AS (SELECT unnest(CAST([0.0, 0.25, 0.5, 0.75, 1.0] AS DOUBLE[])) AS w),
scored AS (SELECT q.row_id AS query_row, q.id AS query_key, a.w AS alpha, b.w AS beta,
                  c.row_id AS item_row, c.id AS item_key, list_dot_product(q.t, c.t) AS score
           FROM items q JOIN items c ON q.row_id <> c.row_id, weights a, weights b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row, alpha, beta
                                        ORDER BY round(score, 9) DESC, item_row) AS rank FROM scored),"""
         + SQL_REL + _NDCG_TAIL)

SQL_BENCH = " UNION ALL ".join([
    "SELECT * FROM " + _best_from(_PRE, "precomputed"),
    "SELECT * FROM " + _best_from(_NORM, "normalized"),
    "SELECT * FROM " + _best_from(_TEXT, "text_only"),
    "SELECT 'broken', 'embeddings', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
    "CAST(NULL AS BIGINT), false, 'non-numeric vector elements'"])


@register("encoder_benchmark", "SELECT encoder, dataset, best_alpha, best_beta, round(best_ndcg, 6) AS best_ndcg, "
                               "n_queries, found, error FROM (" + SQL_BENCH + ")")
def encoder_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry 2: encoders x datasets, best (alpha, beta) by NDCG@5, error cells kept."""
    r = _results(spark, sf_dir)
    return r.select("encoder", "dataset", "best_alpha", "best_beta", _r("best_ndcg"), "n_queries",
                    "found", "error")


@register("benchmark_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS successful, "
                               "round(coalesce(avg(best_ndcg) FILTER (WHERE error IS NULL), 0), 6) AS mean_best_ndcg, "
                               "round(coalesce(stddev_pop(best_ndcg) FILTER (WHERE error IS NULL), 0), 6) AS std_best_ndcg "
                               "FROM (" + SQL_BENCH + ")")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total / successful cells, mean and population std of the best NDCG@5."""
    s = run_summary(_results(spark, sf_dir))
    return s.select("total", "successful", _r("mean_best_ndcg"), _r("std_best_ndcg"))


@register("best_params_distribution", "SELECT best_alpha, best_beta, count(*) AS n, "
                                      "row_number() OVER (ORDER BY count(*) DESC, best_alpha, best_beta) = 1 AS most_common "
                                      "FROM (" + SQL_BENCH + ") WHERE error IS NULL GROUP BY best_alpha, best_beta")
def best_params_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each (alpha, beta) was best; the most common flagged."""
    return parameter_distribution(_results(spark, sf_dir)).select("best_alpha", "best_beta", "n", "most_common")


@register("encoder_averages", "SELECT encoder, round(coalesce(avg(best_ndcg) FILTER (WHERE error IS NULL), 0), 6) AS mean_score, "
                              "round(coalesce(stddev_pop(best_ndcg) FILTER (WHERE error IS NULL), 0), 6) AS std_score, "
                              "count(*) FILTER (WHERE error IS NULL) AS successful, count(*) AS total "
                              "FROM (" + SQL_BENCH + ") GROUP BY encoder")
def encoder_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 on real evaluation cells: per encoder, averages over successful datasets."""
    r = _results(spark, sf_dir).withColumnRenamed("best_ndcg", "score")
    a = C.averages(r, "encoder")
    return a.select("encoder", _r("mean_score"), _r("std_score"), "successful", "total")
