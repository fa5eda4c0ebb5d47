"""Registered queries for the task evaluators (A19-A30), re-ranking (R3, J7),
bitext mining (J10) and approximate search (F8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.hashing import hash_vector
from vecbench.functions.slerp import slerp
from vecbench.operators import tasks as T
from vecbench.operators.ann import ivf_search
from vecbench.operators.relevance import relevance_info
from vecbench.operators.search import topk_search
from vecbench.plans.registry import _r, register
from vecbench.session import cut_lineage
from vecbench.sources.testdata import embedding_items, read


def _flat_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")
    return topk_search(e, e, k, vector="embedding", key="label", exclude_self=True, keep_keys=True)


def _flat_sql(k: int) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_row, q.label AS qlabel, c.vec_id AS item_row, c.label AS ilabel,
             list_dot_product(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank
      FROM s),
hits AS (SELECT *, CAST(qlabel = ilabel AS DOUBLE) AS rel FROM r WHERE rank <= {k}),
relinfo AS (SELECT q.vec_id AS query_row,
                   (SELECT count(*) FROM e c WHERE c.label = q.label AND c.vec_id <> q.vec_id) AS n_rel
            FROM e q)"""


@register("map_mrr", _flat_sql(10) + """,
c AS (SELECT query_row, rank, rel, sum(rel) OVER (PARTITION BY query_row ORDER BY rank) AS cum FROM hits),
per AS (SELECT relinfo.query_row, n_rel,
               coalesce(sum(CASE WHEN rel > 0 THEN cum / rank ELSE 0 END), 0) AS ps,
               min(CASE WHEN rel > 0 THEN rank END) AS first_rank
        FROM relinfo LEFT JOIN c USING (query_row) GROUP BY relinfo.query_row, n_rel)
SELECT round(avg(CASE WHEN least(n_rel, 10) > 0 THEN ps / least(n_rel, 10) ELSE 0 END), 6) AS map_at_10,
       round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr_at_10, count(*) AS n_queries
FROM per""")
def map_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP@10 and MRR@10 of flat search, relevance = same label."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("id"))
    info = relevance_info(e, e, exclude_self=True)
    per = T.map_mrr(_flat_hits(spark, sf_dir, 10), info, 10)
    return per.agg(F.round(F.avg("ap"), 6).alias("map_at_10"), F.round(F.avg("rr"), 6).alias("mrr_at_10"),
                   F.count("*").alias("n_queries"))


@register("v_measure", """
WITH a AS (SELECT label AS c, list_position(embedding, list_max(embedding)) AS k FROM embeddings),
ck AS (SELECT c, k, count(*) AS n_ck FROM a GROUP BY c, k),
w AS (SELECT *, sum(n_ck) OVER (PARTITION BY c) AS n_c, sum(n_ck) OVER (PARTITION BY k) AS n_k FROM ck),
s AS (SELECT sum(n_ck) AS n, sum(n_ck * ln(n_ck / n_k)) AS s_ck_k, sum(n_ck * ln(n_ck / n_c)) AS s_ck_c,
             sum(n_ck * ln(n_c)) AS a_c, sum(n_ck * ln(n_k)) AS a_k FROM w),
h AS (SELECT CASE WHEN ln(n) - a_c / n <= 0 THEN 1.0 ELSE 1 - (-s_ck_k / n) / (ln(n) - a_c / n) END AS hom,
             CASE WHEN ln(n) - a_k / n <= 0 THEN 1.0 ELSE 1 - (-s_ck_c / n) / (ln(n) - a_k / n) END AS com FROM s)
SELECT round(hom, 6) AS homogeneity, round(com, 6) AS completeness,
       round(CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0 END, 6) AS v_measure FROM h""")
def v_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-measure of the arg-max-dimension clustering against the labels."""
    e = read(spark, sf_dir, "embeddings").select("label", T.argmax_position("embedding").alias("cluster"))
    v = T.v_measure(e, "label", "cluster")
    return v.select(_r("homogeneity"), _r("completeness"), _r("v_measure"))


@register("knn_classification", _flat_sql(5) + """,
votes AS (SELECT query_row, qlabel, ilabel, count(*) AS n FROM hits GROUP BY query_row, qlabel, ilabel),
pred AS (SELECT query_row, any_value(qlabel) AS truth, arg_min(ilabel, (-n, ilabel)) AS predicted
         FROM votes GROUP BY query_row),
per AS (SELECT c, sum(support) AS support, sum(npred) AS npred, sum(tp) AS tp FROM (
          SELECT truth AS c, 1 AS support, 0 AS npred, CAST(truth = predicted AS INTEGER) AS tp FROM pred
          UNION ALL SELECT predicted, 0, 1, 0 FROM pred) GROUP BY c)
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN tp > 0 THEN 2 * tp / (support + npred) ELSE 0 END), 6) AS macro_f1,
       CAST(sum(support) AS BIGINT) AS n FROM per""")
def knn_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-NN label vote (leave-one-out): accuracy and macro-F1."""
    h = _flat_hits(spark, sf_dir, 5)
    pred = T.knn_vote(h.withColumn("lbl", F.col("item_key").cast("int")), "lbl", 5)
    truth = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_row"), F.col("label").alias("truth"))
    rep = T.classification_report(pred.join(truth, "query_row"))
    return rep.select(_r("accuracy"), _r("macro_f1"), F.col("n").cast("bigint"))


@register("multilabel_knn", """
WITH h AS (SELECT doc_id, md5('text' || text) AS h FROM documents JOIN labels USING (doc_id)),
z AS (SELECT doc_id, i,
             sqrt(-2.0 * ln((CAST(('0x' || substr(md5(h || '#' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) + 1.0) / 4294967297.0))
             * cos(2 * pi() * CAST(('0x' || substr(md5(h || '#' || CAST(i AS VARCHAR)), 9, 8)) AS BIGINT) / 4294967296.0) AS z
      FROM h, range(0, 16) r(i)),
v AS (SELECT doc_id, list(z ORDER BY i) AS raw FROM z GROUP BY doc_id),
u AS (SELECT doc_id, list_transform(raw, lambda x: x / (sqrt(list_dot_product(raw, raw)) + 1e-8)) AS v FROM v),
s AS (SELECT q.doc_id AS query_row, c.doc_id AS item_row, list_dot_product(q.v, c.v) AS score
      FROM u q JOIN u c ON q.doc_id <> c.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s),
p AS (SELECT r.query_row, CAST(sum(l.quality) >= 3 AS INTEGER) AS pq, CAST(sum(l.toxic) >= 3 AS INTEGER) AS pt
      FROM r JOIN labels l ON l.doc_id = r.item_row WHERE rank <= 5 GROUP BY r.query_row),
j AS (SELECT l.quality, l.toxic, p.pq, p.pt FROM p JOIN labels l ON l.doc_id = p.query_row),
m AS (SELECT 'quality' AS label_name, count(*) FILTER (WHERE quality = 1 AND pq = 1) AS tp,
             count(*) FILTER (WHERE quality = 0 AND pq = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pq = 0) AS fn FROM j
      UNION ALL
      SELECT 'toxic', count(*) FILTER (WHERE toxic = 1 AND pt = 1), count(*) FILTER (WHERE toxic = 0 AND pt = 1),
             count(*) FILTER (WHERE toxic = 1 AND pt = 0) FROM j)
SELECT label_name,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       tp + fn AS support FROM m""")
def multilabel_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, hash-encoded whole texts, 5-NN majority per label, F1 per label."""
    lab = read(spark, sf_dir, "labels")
    docs = (read(spark, sf_dir, "documents").join(lab, "doc_id")
            .select(F.col("doc_id").alias("row_id"), hash_vector("text", 16).alias("v")))
    docs = cut_lineage(docs)  # both sides of the search and its sizes read the vectors: texts are read and hashed once
    h = topk_search(docs, docs, 5, vector="v", exclude_self=True)
    votes = (h.join(lab.select(F.col("doc_id").alias("item_row"), "quality", "toxic"), "item_row")
              .groupBy("query_row").agg((F.sum("quality") >= 3).cast("int").alias("pq"),
                                        (F.sum("toxic") >= 3).cast("int").alias("pt")))
    j = votes.join(lab.select(F.col("doc_id").alias("query_row"), "quality", "toxic"), "query_row")
    q = T.binary_f1(j, "quality", "pq").withColumn("label_name", F.lit("quality"))
    t = T.binary_f1(j, "toxic", "pt").withColumn("label_name", F.lit("toxic"))
    return q.unionByName(t).select("label_name", _r("precision"), _r("recall"), _r("f1"),
                                   F.col("support").cast("bigint"))


@register("pair_classification_ap", _flat_sql(10) + """,
o AS (SELECT rel, row_number() OVER (ORDER BY round(score, 9) DESC, query_row, item_row) AS pos,
             sum(rel) OVER (ORDER BY round(score, 9) DESC, query_row, item_row) AS tp FROM hits)
SELECT round(coalesce(avg(CASE WHEN rel = 1 THEN tp / pos END), 0), 6) AS ap, count(*) AS n_pairs,
       CAST(sum(rel) AS BIGINT) AS n_positive FROM o""")
def pair_classification_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of (query, neighbour) pairs ranked by similarity; positive = same label."""
    # the ranges of a global order are drawn from its input: without this the search would run twice
    h = cut_lineage(_flat_hits(spark, sf_dir, 10).select("query_row", "item_row", "score", "rel"))
    ap = T.pair_average_precision(h, "score", "rel", tiebreak=["query_row", "item_row"])
    return ap.select(_r("ap"), "n_pairs", F.col("n_positive").cast("bigint"))


@register("sts_spearman", _flat_sql(10) + """,
p AS (SELECT round(score, 9) AS x, -abs(qlabel - ilabel) AS y FROM hits),
rk AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 6) AS spearman,
       round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS pearson, count(*) AS n_pairs FROM rk""")
def sts_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman / Pearson between neighbour similarity and a label-distance gold score."""
    h = _flat_hits(spark, sf_dir, 10)
    p = h.select(F.round("score", 9).alias("x"),
                 (-F.abs(F.col("query_key").cast("int") - F.col("item_key").cast("int"))).alias("y"))
    s = T.spearman(cut_lineage(p), "x", "y")  # ranks read it several times
    return s.select(_r("spearman"), _r("pearson"), "n_pairs")


@register("grouped_spearman", _flat_sql(10) + """,
p AS (SELECT query_row, round(score, 9) AS x, -abs(qlabel - ilabel) AS y FROM hits),
rk AS (SELECT query_row, rank() OVER (PARTITION BY query_row ORDER BY x) + (count(*) OVER (PARTITION BY query_row, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY query_row ORDER BY y) + (count(*) OVER (PARTITION BY query_row, y) - 1) / 2.0 AS ry FROM p),
g AS (SELECT query_row, CASE WHEN var_pop(rx) = 0 OR var_pop(ry) = 0 THEN NULL
                              ELSE covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS rho FROM rk GROUP BY query_row)
SELECT round(avg(rho), 6) AS mean_spearman, count(rho) AS n_defined, count(*) AS n_groups FROM g""")
def grouped_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman per query over its 10 neighbours, averaged (undefined groups skipped)."""
    h = _flat_hits(spark, sf_dir, 10)
    p = h.select("query_row", F.round("score", 9).alias("x"),
                 (-F.abs(F.col("query_key").cast("int") - F.col("item_key").cast("int"))).alias("y"))
    g = T.grouped_spearman(p, "query_row", "x", "y")
    return g.agg(F.round(F.avg("spearman"), 6).alias("mean_spearman"), F.count("spearman").alias("n_defined"),
                 F.count("*").alias("n_groups"))


@register("zero_shot_accuracy", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT label, j, avg(v[j]) AS x FROM e, range(1, 65) r(j) GROUP BY label, j),
c AS (SELECT label, list(x ORDER BY j) AS centroid FROM d GROUP BY label),
s AS (SELECT e.vec_id, e.label AS truth, c.label AS predicted,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(e.v, c.centroid), 9) DESC, c.label) AS rn
      FROM e, c)
SELECT round(avg(CAST(truth = predicted AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM s WHERE rn = 1""")
def zero_shot_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest label prototype (mean vector per label) by inner product; accuracy."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label",
                                                  F.col("embedding").cast("array<double>").alias("v"))
    protos = T.centroids(e, "label", "v").select(F.col("label").alias("row_id"), F.col("centroid").alias("v"))
    h = topk_search(e, protos, 1, vector="v")
    j = h.join(e.select(F.col("row_id").alias("query_row"), "label"), "query_row")
    return j.agg(F.round(F.avg((F.col("label") == F.col("item_row")).cast("double")), 6).alias("accuracy"),
                 F.count("*").alias("n"))


@register("bitext_mining", """
WITH i AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS t,
                  list_concat(list_slice(CAST(embedding AS DOUBLE[]), 17, len(embedding)),
                              list_slice(CAST(embedding AS DOUBLE[]), 1, 16)) AS im FROM embeddings),
s AS (SELECT q.vec_id AS src, c.vec_id AS tgt,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.t, c.im), 9) DESC, c.vec_id) AS rn
      FROM i q, i c)
SELECT round(avg(CAST(src = tgt AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM s WHERE rn = 1""")
def bitext_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest image-side vector for every text-side vector; accuracy = own row found."""
    items = embedding_items(spark, sf_dir)
    src = items.select("row_id", F.col("text_embedding").alias("v"))
    tgt = items.select("row_id", F.col("image_embedding").alias("v"))
    h = topk_search(src, tgt, 1, vector="v")
    return h.agg(F.round(F.avg((F.col("query_row") == F.col("item_row")).cast("double")), 6).alias("accuracy"),
                 F.count("*").alias("n"))


@register("choice_accuracy", _flat_sql(5) + """,
pick AS (SELECT query_row, arg_min(rel, (-round(score, 9), item_row)) AS ok FROM hits GROUP BY query_row)
SELECT round(avg(ok), 6) AS accuracy, count(*) AS n_groups FROM pick""")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pick the best of each query's 5 candidates; accuracy of the pick."""
    c = T.choice_accuracy(_flat_hits(spark, sf_dir, 5))
    return c.select(_r("accuracy"), "n_groups")


@register("rerank_two_stage", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS t,
                  list_concat(list_slice(CAST(embedding AS DOUBLE[]), 17, len(embedding)),
                              list_slice(CAST(embedding AS DOUBLE[]), 1, 16)) AS i FROM embeddings),
first AS (SELECT * FROM (
            SELECT q.vec_id AS query_row, c.vec_id AS item_row,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.t, c.t), 9) DESC, c.vec_id) AS r1
            FROM e q JOIN e c ON q.vec_id <> c.vec_id) WHERE r1 <= 50),
u AS (SELECT vec_id, list_transform(t, lambda x: x / (sqrt(list_dot_product(t, t)) + 1e-8)) AS a,
             list_transform(i, lambda x: x / (sqrt(list_dot_product(i, i)) + 1e-8)) AS b FROM e),
g AS (SELECT *, greatest(-1.0, least(1.0, list_dot_product(a, b))) AS d FROM u),
m AS (SELECT vec_id, a, b,
             CASE WHEN abs(d) > 0.9995 OR sin(acos(abs(d))) < 1e-6 THEN 0.5 ELSE sin(0.5 * acos(abs(d))) / sin(acos(abs(d))) END AS f1,
             CASE WHEN abs(d) > 0.9995 OR sin(acos(abs(d))) < 1e-6 THEN 0.5
                  WHEN d < 0 THEN -(sin(0.5 * acos(abs(d))) / sin(acos(abs(d))))
                  ELSE sin(0.5 * acos(abs(d))) / sin(acos(abs(d))) END AS f2 FROM g),
rr AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda j: f1 * a[j] + f2 * b[j]) AS r FROM m),
f AS (SELECT vec_id, list_transform(r, lambda x: x / (sqrt(list_dot_product(r, r)) + 1e-8)) AS v FROM rr),
second AS (SELECT first.query_row, first.item_row, list_dot_product(fq.v, fc.v) AS score
           FROM first JOIN f fq ON fq.vec_id = first.query_row JOIN f fc ON fc.vec_id = first.item_row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM second)
SELECT query_row, CAST(rank AS INTEGER) AS rank, item_row, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-50 by text vectors, re-scored with fused (0.5/0.5) vectors, top-10 kept."""
    from vecbench.operators.rerank import rerank
    items = embedding_items(spark, sf_dir)
    first = topk_search(items, items, 50, vector="text_embedding", exclude_self=True)
    fused = items.select("row_id", slerp("text_embedding", "image_embedding", 0.5).alias("f"))
    out = rerank(first, fused, fused, "f", top_k=50, keep=10)
    return out.select("query_row", "rank", "item_row", _r("score"))


@register("ivf_topk")
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top-10 (IVF: KMeans cells, as many nearest cells as a sample needs, block search per cell)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                  F.col("embedding").cast("array<double>").alias("v"))
    h = ivf_search(e, e, 10, vector="v", exclude_self=True)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("embedding_regression")
def embedding_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear regression of the label on the embedding; R^2 (seed-free, rows-only check)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label")
    return T.regression_r2(e, "v", "label").select(_r("r2"), "n")


@register("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 with KMeans assignments (seeded; checked by invariants, not SQL)."""
    e = read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    _, assigned = T.kmeans_assign(e, "v", 10)
    return T.v_measure(assigned, "label", "cluster").select(_r("homogeneity"), _r("completeness"), _r("v_measure"))


@register("late_interaction", r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
           FROM benchmark),
t AS (SELECT item_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
vocab AS (SELECT DISTINCT word FROM t),
z AS (SELECT word, i,
             sqrt(-2.0 * ln((CAST(('0x' || substr(md5(md5('tok' || word) || '#' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) + 1.0) / 4294967297.0))
             * cos(2 * pi() * CAST(('0x' || substr(md5(md5('tok' || word) || '#' || CAST(i AS VARCHAR)), 9, 8)) AS BIGINT) / 4294967296.0) AS z
      FROM vocab, range(0, 8) r(i)),
raw AS (SELECT word, list(z ORDER BY i) AS r FROM z GROUP BY word),
vec AS (SELECT word, list_transform(r, lambda x: x / (sqrt(list_dot_product(r, r)) + 1e-8)) AS v FROM raw),
tv AS (SELECT item_id, j, v FROM t JOIN vec USING (word)),
m AS (SELECT q.item_id AS query_row, q.j, d.item_id AS item_row, max(list_dot_product(q.v, d.v)) AS mx
      FROM tv q JOIN tv d ON q.item_id <> d.item_id GROUP BY q.item_id, q.j, d.item_id),
s AS (SELECT query_row, item_row, sum(mx) AS score FROM m GROUP BY query_row, item_row),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s)
SELECT query_row, CAST(rank AS INTEGER) AS rank, item_row, round(score, 6) AS score FROM r WHERE rank <= 5""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim over word-token hash vectors of whole benchmark texts; top-5 per text."""
    from vecbench.operators.late import maxsim_search, token_table
    toks = token_table(read(spark, sf_dir, "benchmark"), "item_id", "text")
    h = maxsim_search(toks, toks, 5, exclude_self=True)
    return h.select(F.col("query_id").alias("query_row"), "rank", F.col("doc_id").alias("item_row"), _r("score"))


@register("lsh_topk")
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """approximate top-10 from SimHash cells (the likeliest codes, as many as a sample needs), exact inside."""
    from vecbench.operators.ann import lsh_search
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                  F.col("embedding").cast("array<double>").alias("v"))
    h = lsh_search(e, e, 10, vector="v", exclude_self=True)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("rotation_adapter", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_row, c.vec_id AS item_row, list_dot_product(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s)
SELECT query_row, CAST(rank AS INTEGER) AS rank, item_row, round(score, 6) AS score FROM r WHERE rank <= 10""")
def rotation_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orthogonal (rotation) adapter applied in Arrow batches; inner
    products, hence the flat top-10, are those of the raw vectors."""
    from vecbench.operators.encode import adapt_linear, rotation_matrix
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                  F.col("embedding").cast("array<double>").alias("v"))
    rot = adapt_linear(e, "v", rotation_matrix(64, seed=7), normalize_output=False)
    h = topk_search(rot, rot, 10, vector="v", exclude_self=True)
    return h.select("query_row", "rank", "item_row", _r("score"))


@register("pca_adapter")
def pca_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCA to 16 components fitted on the catalog and applied to it; the
    projected length per row (sign-free, rows-only check)."""
    from vecbench.operators.encode import apply_pca, fit_pca
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = apply_pca(fit_pca(e, "v", 16), e, "v", "p")
    return p.select("vec_id", F.round(F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("length"))
