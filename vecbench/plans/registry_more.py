"""Registered queries for sources and sinks, stores, selections, adapters, batches, graded relevance, contamination by
split, prompted zero-shot labels and any-to-any retrieval, each over whole tables with DuckDB SQL where it can say it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.hashing import hash_vector
from vecbench.functions.text import bibtex_citation
from vecbench.functions.vectors import format_vector, round_floats, with_default_vector
from vecbench.operators import compare as C
from vecbench.operators import tasks as T
from vecbench.operators.anymodal import BOTH, IMAGE, TEXT, any_to_any_ndcg
from vecbench.operators.catalogops import collect_batches, filter_models, filter_splits, filter_tasks, unpivot_documents
from vecbench.operators.encode import adapt_linear, adapt_normalize, adapt_scale, compose, encode
from vecbench.operators.quality import validated
from vecbench.plans.evaluate import evaluate_dataset
from vecbench.plans.registry import _r, register
from vecbench.plans.registry_tables import SQL_RESULTS, _task_table, model_results
from vecbench.session import ensure_checkpoint_dir
from vecbench.sources.files import (list_datasets, load_dataset, read_items, read_jsonl_folder, read_precomputed, read_results_store, read_runs,
                                    read_vectors, repair_csv, write_runs, write_table)
from vecbench.sources.testdata import embedding_items, read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("quote", '"').csv(path)


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id").cast("string")
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("id"), F.concat(F.lit('item "'), n, F.lit('",\nsecond line')).alias("text"),
        F.concat(F.lit("img/"), n, F.lit(".jpg")).alias("image_path"), F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit("}")).alias("metadata"),
        format_vector(F.col("embedding").cast("array<double>")).alias("text_embedding"), "vec_id")


# ------------------------------------------------------------- CSV sources
@register("csv_queries", """
SELECT 'img/' || vec_id || '.jpg' AS image_path, CAST(label AS VARCHAR) AS id, 'item "' || vec_id || '",' || chr(10) || 'second line' AS text,
       CASE WHEN vec_id % 2 = 0 THEN CAST(label + 1 AS INTEGER)
            ELSE CAST((CAST(('0x' || substr(md5(CAST(label AS VARCHAR)), 1, 8)) AS BIGINT) % 20) + 1 AS INTEGER) END AS product_counts
FROM embeddings""")
def csv_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query side of a dataset written as one CSV file and read by byte ranges; empty counts get the default."""
    rows = _csv_rows(spark, sf_dir).withColumn("product_counts", F.when(F.col("vec_id") % 2 == 0, F.col("id").cast("int") + 1)).drop("vec_id")
    base = _folder(spark, "csv")
    _write_csv(rows, f"{base}/items/catalog")
    _write_csv(rows.coalesce(1), f"{base}/items/test")
    _, queries = load_dataset(spark, base, "items")
    return queries.select("image_path", "id", "text", "product_counts")


@register("precomputed_scan", """
SELECT CAST(label AS VARCHAR) AS id, CAST(j AS INTEGER) AS dim, round(sum(CAST(embedding[j] AS DOUBLE)), 6) AS total,
       round(max(CAST(embedding[j] AS DOUBLE)), 6) AS largest, count(*) AS n
FROM embeddings, range(1, 65) r(j) GROUP BY label, j""")
def precomputed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors (and ids) of a catalog file, every element of every vector."""
    path = _folder(spark, "csv")
    _write_csv(_csv_rows(spark, sf_dir).drop("vec_id"), path)
    p = read_precomputed(spark, path).select("id", F.posexplode("text_embedding").alias("pos", "x"))
    return p.groupBy("id", (F.col("pos") + 1).cast("int").alias("dim")).agg(
        F.round(F.sum("x"), 6).alias("total"), F.round(F.max("x"), 6).alias("largest"), F.count("*").alias("n"))


@register("dataset_listing", """
SELECT source AS dataset, count(DISTINCT lang) > 0 AS has_catalog FROM documents GROUP BY source""")
def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of datasets, one a document source, discovered by their catalog and test files."""
    base = _folder(spark, "datasets")
    docs = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").cast("string").alias("n"))
    names = sorted(r.source for r in docs.select("source").distinct().collect())  # a source is a folder of the listing
    for side in ("catalog", "test"):
        for name in names:
            _write_csv(docs.filter(F.col("source") == name).select("lang", "n").coalesce(1), f"{base}/{name}/{side}")
    return list_datasets(spark, base).select("dataset", (F.size("catalog") > 0).alias("has_catalog"))


@register("csv_repair", """
SELECT CAST(label AS VARCHAR) AS id, 'img/' || vec_id || '.jpg' AS image_path, CAST(len(embedding) AS BIGINT) AS n_dims,
       round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total
FROM embeddings""")
def csv_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + P2-P4: a file with a stray index column, an old column name and vectors without commas, repaired and read."""
    broken = F.concat(F.lit("["), F.array_join(F.split(F.regexp_replace("text_embedding", r"[\[\]]", ""), ", "), "\n  "), F.lit("]"))
    rows = _csv_rows(spark, sf_dir).select(F.col("vec_id").alias("Unnamed: 0"), F.col("id").alias("product_id"), "text", "image_path", "metadata",
                                           broken.alias("text_embedding"))
    base = _folder(spark, "csv")
    _write_csv(rows, f"{base}/broken")
    repair_csv(spark, f"{base}/broken", f"{base}/fixed", rename={"product_id": "id"})
    return read_items(spark, f"{base}/fixed").select("id", "image_path", F.size("text_embedding").cast("bigint").alias("n_dims"),
                    F.round(F.aggregate("text_embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# ------------------------------------------------------------- JSON lines, vectors, runs
def _rename_parts(spark: SparkSession, folder: str, extension: str) -> None:
    """Give Spark's part files an extension (a rename each on the file system)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.globStatus(pattern):
        path = s.getPath()
        fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), path.getName().rpartition(".")[0] + extension))


@register("jsonl_folder", """
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CASE WHEN event_type = 'click' THEN user_id END AS user_id FROM events""")
def jsonl_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines files whose records have different keys: the union of keys, missing ones null."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    base = _folder(spark, "jsonl")
    e.select("event_id", "event_type", "k", F.when(F.col("event_type") == "click", F.col("user_id")).alias("user_id")).write.json(base)
    _rename_parts(spark, base, ".jsonl")
    got = read_jsonl_folder(spark, base)
    return got.where(F.col("file") != "").select("event_id", "event_type", "k", F.col("user_id").cast("bigint").alias("user_id"))


@register("stored_vectors", "SELECT vec_id, label FROM embeddings WHERE label % 3 <> 0")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored with zero placeholders for missing ones (every third label's), read without them."""
    path = _folder(spark, "vectors")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.when(F.col("label") % 3 != 0, F.col("embedding").cast("array<double>")).alias("vector"))
    write_table(with_default_vector(rows, "vector", 64), path)
    return read_vectors(spark, path).select("vec_id", "label")


@register("results_runs", SQL_RESULTS + """
SELECT model, task, CASE WHEN CAST(substr(model, 8) AS INTEGER) % 2 = 0 THEN 'r2' ELSE 'r1' END AS revision, 'test' AS split,
       round(score + CASE WHEN CAST(substr(model, 8) AS INTEGER) % 2 = 0 THEN 1 ELSE 0 END, 6) AS score, error FROM results
UNION ALL
SELECT model, task, 'r1', 'test', round(score, 6), error FROM results WHERE CAST(substr(model, 8) AS INTEGER) % 2 = 0""")
def results_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run of every model, then a rerun of it with wrong scores replaced, then a second revision of every
    other model: each run replaces only its own (model, revision, task) cells."""
    path = _folder(spark, "runs")
    number = F.substring("model", 8, 9).cast("int")
    r = model_results(spark, sf_dir).select("model", "task", F.lit("r1").alias("revision"), F.lit("test").alias("split"),
                                            F.lit("default").alias("subset"), "score", "error")
    write_runs(r.withColumn("score", F.when(number % 5 == 0, -F.col("score")).otherwise(F.col("score"))), path)
    write_runs(r.where(number % 5 == 0), path)
    write_runs(r.where(number % 2 == 0).withColumn("revision", F.lit("r2")).withColumn("score", F.col("score") + 1), path)
    return read_runs(spark, path).select("model", "task", "revision", "split", _r("score"), "error")


@register("results_store", SQL_RESULTS + """
SELECT model, 'main' AS revision, task, 'test' AS split, 'default' AS subset, round(score, 6) AS score FROM results WHERE error IS NULL""")
def results_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<model>/<revision>/<task>.json files, read with a given schema (a cell a file: their number is that of the results)."""
    base = _folder(spark, "store")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in model_results(spark, sf_dir).where("error is null").select("model", "task", "score").collect():
        out = fs.create(fs_path(f"{base}/{r.model}/main/{r.task}.json"))
        out.write(json.dumps({"task_name": r.task, "other": {"a": [1]}, "scores": {"test": [{"hf_subset": "default", "main_score": r.score, "ndcg": 1}]}}).encode())
        out.close()
    return read_results_store(spark, base).select("model", "revision", "task", "split", "subset", _r("score"))


# ------------------------------------------------------------- selections and small functions
@register("exclusive_modality", """
SELECT source AS task_name, count(*) AS n_samples FROM documents GROUP BY source HAVING min(length(source)) % 2 = 0""")
def exclusive_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose modalities are exactly the asked ones; here a source with a name of odd length has images too."""
    t = _task_table(spark, sf_dir).withColumn("modalities", F.when(F.length("task_name") % 2 == 0, F.array(F.lit("text")))
                                              .otherwise(F.array(F.lit("image"), F.lit("text"))))
    return filter_tasks(t, modalities=["text"], exclusive_modality=True).select("task_name", "n_samples")


@register("split_selection", """
WITH r AS (SELECT d.lang || '-' || d.source AS subset, CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split
           FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT subset, split, count(*) AS n FROM r
WHERE split = 'test' AND (split_part(subset, '-', 1) IN ('fr', 'en') OR list_has_any(string_split(subset, '-'), ['fr', 'en'])) GROUP BY subset, split""")
def split_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: rows of a split whose subset (a pair like fr-en) names one of the languages on either side."""
    labelled = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(1))
    rows = read(spark, sf_dir, "documents").join(labelled, "doc_id", "left").select(
        F.concat_ws("-", "lang", "source").alias("subset"), F.when(F.col("l").isNull(), "test").otherwise("train").alias("split"))
    return filter_splits(rows, splits=["test"], languages=["fr", "en"]).groupBy("subset", "split").agg(F.count("*").alias("n"))


@register("model_selection", """
SELECT n_name AS name, count(*) AS n_suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey
WHERE contains(n_name, '1') GROUP BY n_name HAVING count(*) >= 2""")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by a part of their name and a predicate on their metadata."""
    models = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")) \
        .groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n_suppliers"))
    return filter_models(models, "1", F.col("n_suppliers") >= 2)


@register("citations", """
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN ' (Doe et al., ' || (1990 + item_id % 30) || ')'
                     ELSE ' (Group ' || item_id || ', ' || (1990 + item_id % 30) || ')' END AS citation FROM benchmark""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibtex entries made of every benchmark item (first author with or without a comma; none) to short citations."""
    i = F.col("item_id")
    author = F.when(i % 3 == 1, F.lit("author = {Doe, Jane and Roe, R.},\n")).when(i % 3 == 2, F.concat(F.lit("author={Group "), i.cast("string"), F.lit("},\n"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("@article{k,\n"), author, F.lit("title = {"), F.length("text").cast("string"), F.lit("},\nyear = {"), (1990 + i % 30).cast("string"), F.lit("}\n}"))
    return read(spark, sf_dir, "benchmark").select("item_id", bibtex_citation(entry).alias("citation"))


@register("rounded_results", SQL_RESULTS + """
SELECT model, task, round(score, 2) AS score, round(score * 100, 2) AS percent, n FROM results""")
def rounded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every float of a frame rounded to two digits, inside structs, arrays and maps too."""
    r = model_results(spark, sf_dir)
    nested = r.select("model", "task", F.struct("score", F.array(F.col("score") * 100).alias("all")).alias("s"), "n")
    return round_floats(nested).select("model", "task", "s.score", F.col("s.all")[0].alias("percent"), "n")


@register("points_ranking", """
SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
       row_number() OVER (ORDER BY sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) DESC, user_id) AS position
FROM events GROUP BY user_id""")
def points_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points table in its order, total descending, as positions of a distributed running count."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))
    out = T.global_cumulative(e, [F.col("total").desc(), F.col("user_id")], "total", "running", "position")
    return out.select("user_id", "total", "position")


# ------------------------------------------------------------- encoders and adapters
def _surface_encoder():
    """A model loaded once a task; every first call for a batch fails, so retries are part of every run."""
    import numpy as np
    tried = set()

    def run(texts: list) -> np.ndarray:
        key = tuple(texts)
        if key not in tried:
            tried.add(key)
            raise RuntimeError("temporarily out of quota")
        return np.array([[len(t), t.count(" "), t.count("e"), 1.0] for t in texts])
    return run


@register("encoded_documents", """
SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces,
       CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS n_e FROM documents""")
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python encoder over whole texts, loaded once a task, in batches, each of which fails once and is retried."""
    d = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), _surface_encoder, "text", "v", factory=True, backoff=0.0)
    v = F.col("v")
    return d.select("doc_id", v[0].alias("n_chars"), v[1].alias("n_spaces"), v[2].alias("n_e"))


def _matrix(rows: int = 64, columns: int = 8):
    import numpy as np
    i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return ((7 * i + 3 * j) % 11 - 5) / 10


_SQL_ADAPTED = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{source}
y AS (SELECT vec_id, list_transform(range(0, 8), lambda j: list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * (((7 * i + 3 * j) % 11) - 5) / 10.0))) AS y FROM {start}),
n AS (SELECT vec_id, list_transform(y, lambda x: x / (sqrt(list_dot_product(y, y)) + 1e-8)) AS z FROM y)
SELECT vec_id, CAST(j AS INTEGER) AS dim, round({scale} * z[j], 6) AS value FROM n, range(1, 9) r(j)"""


def _long(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("int").alias("dim"), _r("x", "value"))


@register("linear_adapter", _SQL_ADAPTED.format(source="", start="e", scale="1"))
def linear_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 8 matrix applied to every vector, then normalised: the adapted values themselves."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return _long(adapt_linear(e, "v", _matrix()), "v")


@register("composed_adapters", _SQL_ADAPTED.format(
    source="u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS v FROM e),", start="u", scale="2.5"))
def composed_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, then a matrix, then a factor, composed over the precomputed vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    steps = compose(lambda d: d.withColumn("v", adapt_normalize("v")), lambda d: adapt_linear(d, "v", _matrix()),
                    lambda d: d.withColumn("v", adapt_scale("v", 2.5)))
    return _long(steps(e), "v")


# ------------------------------------------------------------- batches
@register("document_batches", """
WITH l AS (SELECT page_id, 'url' AS field, url AS document FROM pages UNION ALL SELECT page_id, 'html', html FROM pages),
r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(page_id AS VARCHAR) || '|' || field || '|1111')) AS position FROM l)
SELECT CAST(floor((position - 1) / 512) AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n,
       md5(string_agg(coalesce(document, '-'), chr(10) ORDER BY position)) AS sentences_md5,
       string_agg(CAST(page_id % 7 AS VARCHAR), ',' ORDER BY position) AS labels
FROM r GROUP BY 1""")
def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and labels of every batch, collected in order (the texts whole, by digest)."""
    p = read(spark, sf_dir, "pages").withColumn("label", F.col("page_id") % 7)
    b = collect_batches(unpivot_documents(p, "page_id", ["url", "html"], "label"), "label")
    return b.select("batch", "n", F.md5(F.array_join("sentences", "\n", "-")).alias("sentences_md5"),
                    F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def _batched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in the seeded order of its batches of 512."""
    e = _vectors(spark, sf_dir)
    order = unpivot_documents(e, "row_id", ["label"], "label").select("row_id", "batch")
    return e.join(order, "row_id")


@register("v_measure_batches", """
WITH a AS (SELECT vec_id, label AS c, list_position(embedding, list_max(embedding)) AS k,
                  CAST(floor((row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '|label|1111')) - 1) / 512) AS INTEGER) AS batch FROM embeddings),
ck AS (SELECT batch, c, k, count(*) AS n_ck FROM a GROUP BY batch, c, k),
w AS (SELECT *, sum(n_ck) OVER (PARTITION BY batch, c) AS n_c, sum(n_ck) OVER (PARTITION BY batch, k) AS n_k FROM ck),
s AS (SELECT batch, sum(n_ck) AS n, sum(n_ck * ln(n_ck / n_k)) AS s_ck_k, sum(n_ck * ln(n_ck / n_c)) AS s_ck_c,
             sum(n_ck * ln(n_c)) AS a_c, sum(n_ck * ln(n_k)) AS a_k FROM w GROUP BY batch),
h AS (SELECT batch, CASE WHEN ln(n) - a_c / n <= 0 THEN 1.0 ELSE 1 - (-s_ck_k / n) / (ln(n) - a_c / n) END AS hom,
             CASE WHEN ln(n) - a_k / n <= 0 THEN 1.0 ELSE 1 - (-s_ck_c / n) / (ln(n) - a_k / n) END AS com FROM s)
SELECT batch, round(hom, 6) AS homogeneity, round(com, 6) AS completeness,
       round(CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0 END, 6) AS v_measure FROM h""")
def v_measure_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-measure of every batch of 512 (arg-max-dimension clusters)."""
    b = _batched_vectors(spark, sf_dir).withColumn("cluster", T.argmax_position("v"))
    return T.v_measure(b, "label", "cluster", ["batch"]).select("batch", _r("homogeneity"), _r("completeness"), _r("v_measure"))


@register("clustering_batches")
def clustering_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One k-means model a batch, all in one job; V-measure of each batch (tests recover planted clusters)."""
    assigned = T.kmeans_batches(_batched_vectors(spark, sf_dir), "v", "label")
    return T.v_measure(assigned, "truth", "cluster", ["batch"]).select("batch", _r("homogeneity"), _r("completeness"), _r("v_measure"))


# ------------------------------------------------------------- relevance, regression, zero-shot, any-to-any
@register("graded_ndcg", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_row, c.vec_id AS item_row, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s),
g AS (SELECT q.vec_id AS query_row, c.vec_id AS item_row, 4 - abs(q.vec_id - c.vec_id) AS grade FROM e q JOIN e c
      ON q.vec_id <> c.vec_id AND abs(q.vec_id - c.vec_id) <= 3),
ks AS (SELECT unnest([1, 5, 10]) AS k),
i AS (SELECT query_row, grade, row_number() OVER (PARTITION BY query_row ORDER BY grade DESC) AS pos FROM g),
ideal AS (SELECT query_row, k, sum(CASE WHEN pos <= k THEN grade / log2(pos + 1) ELSE 0 END) AS idcg FROM i, ks GROUP BY query_row, k),
d AS (SELECT g.query_row, k, sum(CASE WHEN rank <= k THEN grade / log2(rank + 1) ELSE 0 END) AS dcg
      FROM g JOIN r USING (query_row, item_row), ks GROUP BY g.query_row, k)
SELECT k, round(avg(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END), 6) AS ndcg_mean, count(*) AS n_queries
FROM (SELECT vec_id AS query_row, k FROM e, ks) LEFT JOIN ideal USING (query_row, k) LEFT JOIN d USING (query_row, k) GROUP BY k""")
def graded_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded judgements (vectors with neighbouring numbers, 3 to 1), never expanded to all pairs."""
    e = _vectors(spark, sf_dir)
    near = e.select(F.col("row_id").alias("query_row"), F.explode(F.array(*[F.lit(d) for d in (-3, -2, -1, 1, 2, 3)])).alias("d"))
    qrels = near.select("query_row", (F.col("query_row") + F.col("d")).alias("item_row"), (4 - F.abs("d")).cast("double").alias("relevance")) \
        .join(e.select(F.col("row_id").alias("item_row")), "item_row", "left_semi")
    ev = evaluate_dataset(e, e, alphas=(0.0,), betas=(0.0,), ks=(1, 5, 10), key="label", text="v", image=None, exclude_self=True, qrels=qrels)
    return ev.metrics.select("k", _r("mean", "ndcg_mean"), "n_queries")


@register("feature_regression", """
SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""")
def feature_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear regression on a one-element vector of every line item; R^2."""
    li = read(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("v"), F.col("l_extendedprice").cast("double").alias("y"))
    return T.regression_r2(li, "v", "y").select(_r("r2"), "n")


def _sql_hashed(source: str, dim: int) -> str:
    """CTEs ``z`` and ``hv`` (id, v): the hash encoder over ``source`` (id, text)."""
    return f"""z AS (SELECT id, i, sqrt(-2.0 * ln((CAST(('0x' || substr(md5(md5('text' || text) || '#' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) + 1.0) / 4294967297.0))
             * cos(2 * pi() * CAST(('0x' || substr(md5(md5('text' || text) || '#' || CAST(i AS VARCHAR)), 9, 8)) AS BIGINT) / 4294967296.0) AS z
      FROM {source}, range(0, {dim}) r(i)),
raw AS (SELECT id, list(z ORDER BY i) AS r FROM z GROUP BY id),
hv AS (SELECT id, list_transform(r, lambda x: x / (sqrt(list_dot_product(r, r)) + 1e-8)) AS v FROM raw)"""


@register("zero_shot_prompted", f"""
WITH c AS (SELECT CAST(label AS VARCHAR) AS id, 'a photo of ' || CAST(label AS VARCHAR) || '.' AS text FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)),
{_sql_hashed('c', 64)},
s AS (SELECT e.vec_id, CAST(e.label AS VARCHAR) AS truth, hv.id AS predicted, list_dot_product(CAST(e.embedding AS DOUBLE[]), hv.v) AS score,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), hv.v), 9) DESC, hv.id) AS rn FROM embeddings e, hv)
SELECT vec_id, truth, predicted, round(score, 6) AS score FROM s WHERE rn = 1""")
def zero_shot_prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate labels in a prompt, encoded as text; each item takes the nearest one. No item teaches a label."""
    e = _vectors(spark, sf_dir)
    z = T.zero_shot(e, e.select("label"), lambda d: d.withColumn("v", hash_vector("prompt", 64)), template="a photo of {label}.")
    return z.join(e.select("row_id", F.col("label").cast("string").alias("truth")), "row_id") \
        .select(F.col("row_id").alias("vec_id"), "truth", "predicted", _r("score"))


def _any_sql(query_modality: str, item_modality: str) -> str:
    from vecbench.plans.registry import SQL_FUSED
    pick = lambda m: f"CASE {m} WHEN 'text' THEN t WHEN 'image' THEN i ELSE f END"
    return "WITH " + SQL_FUSED.strip() + f""",
a AS (SELECT items.row_id, items.id, t, i, v AS f, {query_modality} AS qm, {item_modality} AS cm FROM items JOIN fused ON fused.row_id = items.row_id AND w = 0.5),
s AS (SELECT q.row_id AS query_row, q.qm, q.id AS qid, c.id AS cid, c.row_id AS item_row,
             list_dot_product({pick('q.qm').replace(' t ', ' q.t ').replace(' i ', ' q.i ').replace(' f ', ' q.f ')},
                              {pick('c.cm').replace(' t ', ' c.t ').replace(' i ', ' c.i ').replace(' f ', ' c.f ')}) AS score
      FROM a q JOIN a c ON q.row_id <> c.row_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s),
ks AS (SELECT unnest([1, 5, 10]) AS k),
info AS (SELECT q.row_id AS query_row, q.qm, (SELECT count(*) FROM a c WHERE c.id = q.id AND c.row_id <> q.row_id) AS n_rel, (SELECT count(*) - 1 FROM a) AS n_cand FROM a q),
d AS (SELECT info.query_row, info.qm, k, n_rel, n_cand, coalesce(sum(CASE WHEN rank <= k AND qid = cid THEN 1.0 / log2(rank + 1) END), 0) AS dcg
      FROM info CROSS JOIN ks LEFT JOIN r ON r.query_row = info.query_row AND rank <= 10 GROUP BY ALL),
n AS (SELECT qm, k, dcg, coalesce(list_sum(list_transform(range(1, least(n_rel, least(k, n_cand)) + 1), lambda x: 1.0 / log2(x + 1))), 0) AS idcg FROM d)
SELECT qm AS modality, k, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg_mean, count(*) AS n_queries FROM n GROUP BY qm, k"""


def _any(spark: SparkSession, sf_dir: str, query_modality, item_modality) -> DataFrame:
    items = embedding_items(spark, sf_dir)
    m = any_to_any_ndcg(items.withColumn("modality", query_modality), items.withColumn("modality", item_modality), (1, 5, 10), exclude_self=True)
    return m.select("modality", "k", _r("mean", "ndcg_mean"), "n_queries")


@register("text_to_image_ndcg", _any_sql("'text'", "'image'"))
def text_to_image_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text queries, image items: NDCG@{1,5,10}."""
    return _any(spark, sf_dir, F.lit(TEXT), F.lit(IMAGE))


@register("image_to_text_ndcg", _any_sql("'image'", "'text'"))
def image_to_text_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image queries, text items: NDCG@{1,5,10}."""
    return _any(spark, sf_dir, F.lit(IMAGE), F.lit(TEXT))


@register("any_to_any_ndcg", _any_sql("CASE row_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'text+image' END".replace("row_id", "items.row_id"),
                                      "CASE items.row_id % 2 WHEN 0 THEN 'image' ELSE 'text+image' END"))
def any_to_any_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and items of mixed modalities in one search; NDCG by the query's modality."""
    i = F.col("row_id")
    return _any(spark, sf_dir, F.when(i % 3 == 0, TEXT).when(i % 3 == 1, IMAGE).otherwise(BOTH), F.when(i % 2 == 0, IMAGE).otherwise(BOTH))


# ------------------------------------------------------------- contamination by split (J6), validation (V2)
@register("contaminated_splits", SQL_RESULTS + """,
tr AS (SELECT DISTINCT n_name AS model, p_brand AS task, CASE l_linestatus WHEN 'F' THEN 'train' ELSE 'test' END AS split
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
       WHERE CAST(('0x' || substr(md5(n_name || p_brand), 1, 1)) AS INTEGER) < 4),
rows AS (SELECT model, task, split, score FROM results, (SELECT unnest(['train', 'test', 'dev']) AS split))
SELECT model, task, split, round(score, 6) AS score,
       EXISTS (SELECT 1 FROM tr WHERE tr.model = rows.model AND tr.task = rows.task AND tr.split = rows.split) AS contaminated FROM rows""")
def contaminated_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by split against the splits that a model lists for a task: the model trained on every line item of the
    tasks that a hash of the two names picks."""
    named = _lines_by_model(spark, sf_dir).where(F.conv(F.substring(F.md5(F.concat("model", "task")), 1, 1), 16, 10).cast("int") < 4)
    per = named.groupBy("model", "task").agg(F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", "train").otherwise("test"))).alias("splits"))
    training = per.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("task", "splits"))).alias("training_datasets"))
    r = model_results(spark, sf_dir).select("model", "task", "score").withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"), F.lit("dev"))))
    bad, ok = (C.contamination(r, training, x).withColumn("contaminated", F.lit(x)) for x in (True, False))
    return bad.unionByName(ok).select("model", "task", "split", _r("score"), "contaminated")


def _lines_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("model"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("task"))
    return li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)


@register("observed_validation", """
SELECT count(*) AS n_rows, 0 AS n_null_id, CAST(count(*) FILTER (WHERE label = 1) AS INTEGER) AS n_zero, 64 AS min_dim, 64 AS max_dim,
       CAST(count(*) FILTER (WHERE label = 2) AS INTEGER) AS n_bad_metadata, 'image_path' AS missing, 'vec_id' AS extra FROM embeddings""")
def observed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: columns, dimensions, zero vectors and metadata checked on the pass that writes the table."""
    rows = _csv_rows(spark, sf_dir).drop("image_path").withColumn("metadata", F.when(F.col("id") == "2", "{bad").otherwise(F.col("metadata")))
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.drop("text_embedding").join(e, "vec_id").withColumn("text_embedding", F.when(F.col("id") == "1", F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("e"))).drop("e")
    checked, found = validated(rows, name="v" + uuid.uuid4().hex)
    checked.write.parquet(_folder(spark, "checked"))
    r = found.report()
    return spark.createDataFrame([(r["n_rows"], r["n_null_id"], r["n_zero_text_embedding"], r["text_embedding_min_dim"], r["text_embedding_max_dim"], r["n_bad_metadata"],
                                   ",".join(r["missing_columns"]), ",".join(r["extra_columns"]))],
                                 "n_rows bigint, n_null_id int, n_zero int, min_dim int, max_dim int, n_bad_metadata int, missing string, extra string")
