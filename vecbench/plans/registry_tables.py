"""Registered queries for the table operators: hashing/encoding keys, vector
strings, prompts, catalogs, crosstabs, points, results comparison, quality.

Results tables for the comparison operators are derived from the TPC-H-like
tables: model := supplier nation, task := part brand, score := mean
discount of the cell's line items; a cell with fewer than 80 line items is
an error cell (kept as a row, excluded from averages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.hashing import config_hash, content_key, default_count, hash_vector
from vecbench.functions.text import lookup, resolve_prompt, with_prompt
from vecbench.functions.vectors import bind, format_vector, parse_vector, repair_vector_string
from vecbench.operators import compare as C
from vecbench.operators.catalogops import crosstab, describe, filter_tasks, group_overview, unpivot_documents
from vecbench.operators.points import long_to_records, rollup, violations
from vecbench.operators.quality import cap_per_group, hash_split, validate_vectors
from vecbench.plans.registry import _r, register
from vecbench.sources.testdata import embedding_items, read

# ISO 639-3 + script codes and English names of the four languages in the data.
ISO_CODES = {"en": "eng-Latn", "fr": "fra-Latn", "de": "deu-Latn", "es": "spa-Latn"}
LANG_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
LANGS = ["de", "en", "es", "fr"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
MODELS = [f"NATION_{i}" for i in range(25)]
HASH_DIM = 16


# ------------------------------------------------------------- hashing
@register("hash_encode_documents", f"""
WITH h AS (SELECT doc_id, md5('text' || text) AS h FROM documents),
e AS (SELECT doc_id, i, md5(h || '#' || CAST(i AS VARCHAR)) AS g FROM h, range(0, {HASH_DIM}) r(i)),
z AS (SELECT doc_id, i,
             sqrt(-2.0 * ln((CAST(('0x' || substr(g, 1, 8)) AS BIGINT) + 1.0) / (4294967296.0 + 1.0)))
             * cos(2 * pi() * CAST(('0x' || substr(g, 9, 8)) AS BIGINT) / 4294967296.0) AS z
      FROM e),
n AS (SELECT doc_id, sqrt(sum(z * z)) AS nz FROM z GROUP BY doc_id)
SELECT doc_id, CAST(i + 1 AS INTEGER) AS dim, round(z / (nz + 1e-8), 6) AS value
FROM z JOIN n USING (doc_id)""")
def hash_encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic hash encoder over whole document texts (16-d, unit)."""
    d = read(spark, sf_dir, "documents").select("doc_id", hash_vector("text", HASH_DIM).alias("v"))
    return d.select("doc_id", F.posexplode("v").alias("p", "x")).select(
        "doc_id", (F.col("p") + 1).cast("int").alias("dim"), _r("x", "value"))


@register("document_keys", """
SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(1) || coalesce(text, chr(0))) AS content_key,
       substr(md5('hash_encoder_dim=16'), 1, 8) AS config_hash,
       CAST((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 20) + 1 AS INTEGER)
         AS product_count
FROM documents""")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 content key, S8 config fingerprint, P5 default relevance count."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", content_key("doc_id", "text").alias("content_key"),
                    config_hash("hash_encoder", "dim=16").alias("config_hash"),
                    default_count(F.col("doc_id").cast("string")).alias("product_count"))


# ------------------------------------------------------------- vector strings
@register("vector_roundtrip", """
WITH s AS (SELECT vec_id, '[' || array_to_string(CAST(embedding AS DOUBLE[]), ', ') || ']' AS txt,
                  CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT vec_id, v, list_transform(string_split(trim(txt, '[]'), ','), lambda x: CAST(trim(x) AS DOUBLE)) AS q
      FROM s)
SELECT vec_id, CAST(len(q) AS INTEGER) AS dims, round(list_sum(q), 6) AS total,
       round(list_max(list_transform(range(1, len(q) + 1), lambda j: abs(q[j] - v[j]))), 6) AS max_abs_diff
FROM p""")
def vector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as ``[a, b, ...]`` text and parsed back."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.withColumn("q", parse_vector(format_vector("v")))
    return p.select("vec_id", F.size("q").cast("int").alias("dims"),
                    F.round(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                    F.round(F.array_max(F.zip_with("q", "v", lambda a, b: F.abs(a - b))), 6)
                    .alias("max_abs_diff"))


def _raw_vector_text(col):
    ints = F.transform(col, lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    # eight numbers per line, runs of spaces, wrapped in quotes: the multi-line export format
    # (the number list is bound once per row, not rebuilt for every line)
    lines = bind(ints, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 8).cast("int")),
                                             lambda i: F.array_join(F.slice(v, i * 8 + 1, 8), "  ")))
    return F.concat(F.lit('"['), F.array_join(lines, "\n "), F.lit(']"'))


@register("repair_vectors", r"""
WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR)) AS ints
           FROM embeddings),
t AS (SELECT vec_id, '"[' || array_to_string(list_transform(range(0, (len(ints) - 1) // 8 + 1),
             lambda i: array_to_string(ints[i * 8 + 1: i * 8 + 8], '  ')), chr(10) || ' ') || ']"' AS raw
      FROM s),
x AS (SELECT vec_id, regexp_extract(trim(raw, '"'''), '\[(.*?)\]', 1, 's') AS inner_text FROM t)
SELECT vec_id, '[' || array_to_string(list_filter(regexp_split_to_array(inner_text, '\s+'), lambda w: w <> ''), ', ') || ']'
       AS repaired
FROM x""")
def repair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line, space-separated vector text repaired to ``[a, b, ...]``."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", repair_vector_string(_raw_vector_text(F.col("v"))).alias("repaired"))


# ------------------------------------------------------------- JSON field
@register("metadata_field", """
SELECT event_type, count(*) AS n_events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS k_avg
FROM events GROUP BY event_type""")
def metadata_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON metadata text, aggregated per event type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (read(spark, sf_dir, "events").groupBy("event_type")
            .agg(F.count("*").alias("n_events"), F.sum(k).alias("k_sum"), F.round(F.avg(k), 6).alias("k_avg")))


# ------------------------------------------------------------- prompts
PROMPTS = {"conversations-system": "instruction: ", "Retrieval-user": "Represent the question: ",
           "assistant": "passage: "}


@register("prompted_text", """
WITH p AS (SELECT conv_id, turn, text,
                  CASE role WHEN 'system' THEN 'instruction: ' WHEN 'user' THEN 'Represent the question: '
                            WHEN 'assistant' THEN 'passage: ' END AS prompt FROM conversations)
SELECT conv_id, turn, prompt, md5(coalesce(prompt, '') || text) AS text_md5,
       length(coalesce(prompt, '') || text) AS n_chars FROM p""")
def prompted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for (task, task type, role) prefixed to every whole turn."""
    c = read(spark, sf_dir, "conversations")
    pr = resolve_prompt(PROMPTS, "conversations", "Retrieval", F.col("role"))
    t = with_prompt("text", pr)
    return c.select("conv_id", "turn", pr.alias("prompt"), F.md5(t).alias("text_md5"),
                    F.length(t).cast("bigint").alias("n_chars"))


# ------------------------------------------------------------- task catalog
def _task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task metadata per document source: languages (ISO codes), type, modalities."""
    d = read(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("task_name")).agg(
        F.array_sort(F.collect_set(lookup("lang", ISO_CODES, "und-Zzzz"))).alias("languages"),
        F.when(F.avg("n_chars") > 2400, "Retrieval").otherwise("Classification").alias("type"),
        F.count("*").alias("n_samples")).withColumn("modalities", F.array(F.lit("text")))


@register("task_filter", """
WITH t AS (SELECT source AS task_name,
                  list_sort(list_distinct(list(CASE lang WHEN 'en' THEN 'eng-Latn' WHEN 'fr' THEN 'fra-Latn'
                                                    WHEN 'de' THEN 'deu-Latn' WHEN 'es' THEN 'spa-Latn'
                                                    ELSE 'und-Zzzz' END))) AS languages,
                  CASE WHEN avg(n_chars) > 2400 THEN 'Retrieval' ELSE 'Classification' END AS type,
                  count(*) AS n_samples
           FROM documents GROUP BY source)
SELECT task_name, type, array_to_string(languages, ',') AS languages, n_samples FROM t
WHERE type IN ('Retrieval') AND list_has_any(list_transform(languages, lambda c: split_part(c, '-', 1)), ['fra', 'deu'])
  AND list_has_any(list_transform(languages, lambda c: split_part(c, '-', 2)), ['Latn'])""")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by type, language part and script part of their codes."""
    t = filter_tasks(_task_table(spark, sf_dir), types=["Retrieval"], languages=["fra", "deu"],
                     scripts=["Latn"], modalities=["text"])
    return t.select("task_name", "type", F.array_join("languages", ",").alias("languages"), "n_samples")


# ------------------------------------------------------------- crosstab and overviews
@register("source_lang_crosstab", """
WITH c AS (SELECT source,
                  count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en,
                  count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr
           FROM documents GROUP BY source)
SELECT source, de, en, es, fr, de + en + es + fr AS row_sum FROM c
UNION ALL
SELECT 'Total', CAST(sum(de) AS BIGINT), CAST(sum(en) AS BIGINT), CAST(sum(es) AS BIGINT), CAST(sum(fr) AS BIGINT),
       CAST(sum(de + en + es + fr) AS BIGINT) FROM c""")
def source_lang_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source x language, zero-filled, row sums, total row."""
    x = crosstab(read(spark, sf_dir, "documents"), "source", "lang", LANGS)
    return x.select("source", *[F.col(v).cast("bigint").alias(v) for v in LANGS], "row_sum")


@register("source_overview", """
WITH per AS (SELECT source, lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY source, lang)
SELECT d.source, count(DISTINCT d.doc_id) AS n_members,
       string_agg(DISTINCT d.lang, ',' ORDER BY d.lang) AS all_lang,
       (SELECT string_agg(p.lang || ': ' || CAST(p.n AS VARCHAR), ', ' ORDER BY p.lang || ': ' || CAST(p.n AS VARCHAR))
        FROM per p WHERE p.source = d.source) AS lang_counts
FROM documents d GROUP BY d.source""")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the number of documents, its languages and counts per language."""
    o = group_overview(read(spark, sf_dir, "documents"), "source", "doc_id", set_cols=["lang"],
                       count_col="lang")
    return o.select("source", "n_members", "all_lang", "lang_counts")


@register("document_stats", """
SELECT lang, count(*) AS n_samples, round(avg(length(text)), 6) AS avg_length,
       min(length(text)) AS min_length, max(length(text)) AS max_length,
       count(DISTINCT source) AS n_distinct_source
FROM documents GROUP BY lang""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive statistics of whole texts per language."""
    s = describe(read(spark, sf_dir, "documents"), ["lang"], "text", "source")
    return s.select("lang", "n_samples", _r("avg_length"), F.col("min_length").cast("bigint"),
                    F.col("max_length").cast("bigint"), "n_distinct_source")


@register("language_names", """
SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
                       WHEN 'es' THEN 'Spanish' ELSE 'unknown' END AS language,
       count(*) AS n_documents
FROM documents GROUP BY lang""")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code -> name lookup with a default, per language."""
    d = read(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n_documents")).select(
        "lang", lookup("lang", LANG_NAMES, "unknown").alias("language"), "n_documents")


# ------------------------------------------------------------- points
def _event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.select("event_id", "user_id", *[F.when(F.col("event_type") == c, F.col("k")).alias(c)
                                             for c in EVENT_TYPES])


@register("points_rollup", """
SELECT user_id, """ + ", ".join(
    f"CAST(sum(CASE WHEN event_type = '{c}' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END) AS BIGINT) AS {c}"
    for c in EVENT_TYPES) + """,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY user_id""")
def points_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, points per category (missing = 0) and the total."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    rec = long_to_records(e, "user_id", "event_type", "k", EVENT_TYPES)
    return rollup(rec, "user_id", EVENT_TYPES).orderBy(F.col("total").desc(), "user_id")


POINT_MINIMA = {"click": 1, "error": 2, "purchase": 1, "signup": 1, "view": 2}
POINT_MAXIMA = {"purchase": 8}


@register("points_violations", """
WITH r AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'min:' || event_type AS rule FROM r
WHERE k < CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 1
                          WHEN 'signup' THEN 1 WHEN 'view' THEN 2 END
UNION ALL
SELECT event_id, 'max:purchase' FROM r WHERE event_type = 'purchase' AND k > 8""")
def points_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one row per record and broken rule (minima per category, a maximum)."""
    return violations(_event_records(spark, sf_dir), ["event_id"],
                      allowed=["user_id", *EVENT_TYPES], minima=POINT_MINIMA, maxima=POINT_MAXIMA)


# ------------------------------------------------------------- results comparison
def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results table: model (supplier nation) x task (part brand) -> mean discount."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
           .join(p, li.l_partkey == p.p_partkey))
    g = j.groupBy(F.col("n_name").alias("model"), F.col("p_brand").alias("task")).agg(
        F.avg("l_discount").alias("score"), F.count("*").alias("n"))
    brand, nation = F.substring("task", 7, 9).cast("int"), F.substring("model", 8, 9).cast("int")
    return g.withColumn("error", F.when(brand % 25 == nation, F.lit("unsupported task")))


SQL_RESULTS = """
WITH results AS (
  SELECT n_name AS model, p_brand AS task, avg(l_discount) AS score, count(*) AS n,
         CASE WHEN CAST(substr(p_brand, 7) AS INT) % 25 = CAST(substr(n_name, 8) AS INT) THEN 'unsupported task' END AS error
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey
  GROUP BY n_name, p_brand)"""


def _avg_sql(by: str, desc: bool) -> str:
    order = "DESC" if desc else "ASC"
    return SQL_RESULTS + f""",
a AS (SELECT {by}, coalesce(avg(score) FILTER (WHERE error IS NULL), 0.0) AS mean_score,
             coalesce(stddev_pop(score) FILTER (WHERE error IS NULL), 0.0) AS std_score,
             count(*) FILTER (WHERE error IS NULL) AS successful, count(*) AS total
      FROM results GROUP BY {by})
SELECT {by}, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, successful, total,
       CAST(row_number() OVER (ORDER BY mean_score {order}, {by}) AS INTEGER) AS position FROM a"""


@register("model_averages", _avg_sql("model", True))
def model_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + W4: per model, mean/std over successful cells, counts, ranking (best first)."""
    a = C.rank_groups(C.averages(model_results(spark, sf_dir), "model"), "model", descending=True)
    return a.select("model", _r("mean_score"), _r("std_score"), "successful", "total",
                    F.col("position").cast("int"))


@register("task_averages", _avg_sql("task", False))
def task_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + W5: per task, averages and difficulty ranking (hardest first)."""
    a = C.rank_groups(C.averages(model_results(spark, sf_dir), "task"), "task", descending=False)
    return a.select("task", _r("mean_score"), _r("std_score"), "successful", "total",
                    F.col("position").cast("int"))


@register("best_model", SQL_RESULTS + """,
a AS (SELECT model, coalesce(avg(score) FILTER (WHERE error IS NULL), 0.0) AS m FROM results GROUP BY model)
SELECT arg_min(model, (-m, model)) AS model, round(max(m), 6) AS mean_score FROM a""")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model with the highest mean (ties -> smallest name)."""
    b = C.best_group(C.averages(model_results(spark, sf_dir), "model"), "model", highest=True)
    return b.select("model", _r("mean_score"))


@register("hardest_task", SQL_RESULTS + """,
a AS (SELECT task, coalesce(avg(score) FILTER (WHERE error IS NULL), 0.0) AS m FROM results GROUP BY task)
SELECT arg_min(task, (m, task)) AS task, round(min(m), 6) AS mean_score FROM a""")
def hardest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task with the lowest mean (ties -> smallest name)."""
    b = C.best_group(C.averages(model_results(spark, sf_dir), "task"), "task", highest=False)
    return b.select("task", _r("mean_score"))


@register("result_totals", SQL_RESULTS + """
SELECT count(*) AS total_evaluations, count(*) FILTER (WHERE error IS NULL) AS successful_evaluations,
       count(DISTINCT model) AS n_models, count(DISTINCT task) AS n_tasks FROM results""")
def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation counts, distinct models and tasks."""
    return C.totals(model_results(spark, sf_dir))


@register("results_matrix", SQL_RESULTS + """,
w AS (SELECT task, """ + ", ".join(
    f"max(CASE WHEN model = '{m}' AND error IS NULL THEN score END) AS {m}" for m in MODELS) + """
      FROM results GROUP BY task)
SELECT task, """ + ", ".join(f"round({m}, 6) AS {m}" for m in MODELS) + """,
       round((""" + " + ".join(f"coalesce({m}, 0)" for m in MODELS) + ") / nullif(" + " + ".join(
    f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in MODELS) + """, 0), 6) AS row_average
FROM w""")
def results_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task x model matrix (error cells NULL) with the row average over the rest."""
    w = C.to_wide(model_results(spark, sf_dir), "task", "model", MODELS, row_average=True)
    return w.select("task", *[_r(m) for m in MODELS], _r("row_average"))


@register("results_reproducibility", SQL_RESULTS + """,
b AS (SELECT model, task, round(score, 4) AS score FROM results)
SELECT count(*) AS n_cells, count(*) FILTER (WHERE abs(r.score - b.score) < 1e-3) AS n_agree,
       count(*) FILTER (WHERE NOT (abs(r.score - b.score) < 1e-3)) AS n_differ,
       round(max(abs(r.score - b.score)), 6) AS max_abs_diff
FROM results r FULL OUTER JOIN b USING (model, task)""")
def results_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: a run against a second run rounded to 4 decimals: agreement to 1e-3."""
    r = model_results(spark, sf_dir)
    rep = C.reproducibility(r, r.withColumn("score", F.round("score", 4)), ["model", "task"])
    return rep.select("n_cells", "n_agree", "n_differ", _r("max_abs_diff"))


def _task_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("task")).agg(
        F.min("p_type").alias("type"), F.count("*").alias("n_parts"))


@register("results_with_tasks", SQL_RESULTS + """,
t AS (SELECT p_brand AS task, min(p_type) AS type, count(*) AS n_parts FROM part GROUP BY p_brand)
SELECT model, task, round(score, 6) AS score, type, n_parts FROM results JOIN t USING (task)""")
def results_with_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined with task metadata on the task name."""
    j = C.with_task_metadata(model_results(spark, sf_dir), _task_meta(spark, sf_dir))
    return j.select("model", "task", _r("score"), "type", "n_parts")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model metadata: training_datasets map<task, array<part type>> of every line item's model and task, for the pairs
    that a hash of the two names picks."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
           .join(p, li.l_partkey == p.p_partkey))
    picked = F.substring(F.md5(F.concat("n_name", "p_brand")), 1, 1).isin("0", "1", "2", "3")
    per = j.groupBy("n_name", "p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types")).where(picked)
    return per.groupBy(F.col("n_name").alias("model")).agg(
        F.map_from_entries(F.collect_list(F.struct("p_brand", "types"))).alias("training_datasets"))


@register("contaminated_results", SQL_RESULTS + """,
tr AS (SELECT DISTINCT n_name AS model, p_brand AS task
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
            JOIN part ON l_partkey = p_partkey
       WHERE substr(md5(n_name || p_brand), 1, 1) IN ('0', '1', '2', '3'))
SELECT model, task, round(score, 6) AS score,
       EXISTS (SELECT 1 FROM tr WHERE tr.model = results.model AND tr.task = results.task) AS contaminated
FROM results""")
def contaminated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results flagged as contaminated (task in the model's training data) or zero-shot."""
    r = model_results(spark, sf_dir)
    tr = _training(spark, sf_dir)
    bad = C.contamination(r, tr, True).withColumn("contaminated", F.lit(True))
    ok = C.contamination(r, tr, False).withColumn("contaminated", F.lit(False))
    return bad.unionByName(ok).select("model", "task", _r("score"), "contaminated")


@register("benchmark_results", SQL_RESULTS + """,
m AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS benchmark, p_brand AS task FROM part)
SELECT benchmark, model, round(avg(score) FILTER (WHERE error IS NULL), 6) AS mean_score,
       count(*) AS n_tasks
FROM results JOIN m USING (task) GROUP BY benchmark, model""")
def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmarks as named task sets (part type family); mean score per model."""
    p = read(spark, sf_dir, "part")
    members = p.select(F.split("p_type", " ").getItem(0).alias("benchmark"),
                       F.col("p_brand").alias("task")).distinct()
    sel = C.select_members(model_results(spark, sf_dir), members)
    return sel.groupBy("benchmark", "model").agg(
        F.round(F.avg(F.when(F.col("error").isNull(), F.col("score"))), 6).alias("mean_score"),
        F.count("*").alias("n_tasks"))


# ------------------------------------------------------------- quality
@register("vector_validation", """
WITH i AS (SELECT CAST(embedding AS DOUBLE[]) AS t,
                  list_concat(list_slice(CAST(embedding AS DOUBLE[]), 17, len(embedding)),
                              list_slice(CAST(embedding AS DOUBLE[]), 1, 16)) AS im FROM embeddings)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE t IS NULL) AS n_null_text,
       count(DISTINCT len(t)) AS n_text_dims,
       count(*) FILTER (WHERE list_bool_or(list_transform(t, lambda x: x IS NULL OR isnan(x)))) AS n_bad_text,
       count(*) FILTER (WHERE NOT list_bool_or(list_transform(t, lambda x: x <> 0))) AS n_zero_text,
       count(*) FILTER (WHERE im IS NULL) AS n_null_image, count(DISTINCT len(im)) AS n_image_dims,
       count(*) FILTER (WHERE list_bool_or(list_transform(im, lambda x: x IS NULL OR isnan(x)))) AS n_bad_image,
       count(*) FILTER (WHERE len(t) <> len(im)) AS n_dim_mismatch
FROM i""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 (and S9's zero check): one-pass validation report of the vector columns."""
    return validate_vectors(embedding_items(spark, sf_dir))


@register("hash_split", """
SELECT vec_id, CASE WHEN CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2
                    THEN 'test' ELSE 'train' END AS split
FROM embeddings""")
def hash_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic 20 % test split of the embeddings."""
    return hash_split(read(spark, sf_dir, "embeddings"), "vec_id", 0.2).select("vec_id", "split")


@register("cap_per_label", """
SELECT vec_id, label FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '#42')) AS rn
  FROM embeddings) WHERE rn <= 20""")
def cap_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: dataset size cap, 20 per label, in hash order (a sampling operator)."""
    return cap_per_group(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", 20).select("vec_id", "label")


@register("unpivot_batches", """
WITH l AS (SELECT page_id, 'url' AS field, url AS document FROM pages UNION ALL SELECT page_id, 'html', html FROM pages),
r AS (SELECT page_id, field, document,
             row_number() OVER (ORDER BY md5(CAST(page_id AS VARCHAR) || '|' || field || '|1111')) AS position FROM l)
SELECT page_id, field, document, position, CAST(floor((position - 1) / 512) AS INTEGER) AS batch FROM r""")
def unpivot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Url and html of every page as documents, seeded order, batches of 512."""
    u = unpivot_documents(read(spark, sf_dir, "pages"), "page_id", ["url", "html"], None)
    return u.select("page_id", "field", "document", "position", "batch")


# ------------------------------------------------------------- instruction retrieval
def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where(F.col("role") == role)
    prompted = with_prompt("text", resolve_prompt(PROMPTS, "conversations", "Retrieval", F.col("role")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
                    F.col("conv_id").cast("string").alias("id"), hash_vector(prompted, HASH_DIM).alias("v"))


@register("instruction_retrieval", f"""
WITH t AS (SELECT conv_id * 1000 + turn AS row_id, conv_id, role,
                  md5('text' || CASE role WHEN 'user' THEN 'Represent the question: ' ELSE 'passage: ' END || text) AS h
           FROM conversations WHERE role IN ('user', 'assistant')),
z AS (SELECT row_id, i,
             sqrt(-2.0 * ln((CAST(('0x' || substr(md5(h || '#' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) + 1.0) / 4294967297.0))
             * cos(2 * pi() * CAST(('0x' || substr(md5(h || '#' || CAST(i AS VARCHAR)), 9, 8)) AS BIGINT) / 4294967296.0) AS z
      FROM t, range(0, {HASH_DIM}) r(i)),
raw AS (SELECT row_id, list(z ORDER BY i) AS r FROM z GROUP BY row_id),
v AS (SELECT t.row_id, conv_id, role, list_transform(r, lambda x: x / (sqrt(list_dot_product(r, r)) + 1e-8)) AS v
      FROM raw JOIN t USING (row_id)),
q AS (SELECT * FROM v WHERE role = 'user'), c AS (SELECT * FROM v WHERE role = 'assistant'),
s AS (SELECT q.row_id AS query_row, q.conv_id AS qc, c.row_id AS item_row, c.conv_id AS ic,
             list_dot_product(q.v, c.v) AS score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY round(score, 9) DESC, item_row) AS rank FROM s),
info AS (SELECT q.row_id AS query_row, (SELECT count(*) FROM c WHERE c.conv_id = q.conv_id) AS n_rel,
                (SELECT count(*) FROM c) AS n_cand FROM q),
ks AS (SELECT unnest([1, 5, 10]) AS k),
d AS (SELECT info.query_row, ks.k, n_rel, n_cand,
             coalesce(sum(CASE WHEN r.rank <= ks.k AND r.qc = r.ic THEN 1.0 / log2(r.rank + 1) END), 0) AS dcg
      FROM info CROSS JOIN ks LEFT JOIN r ON r.query_row = info.query_row AND r.rank <= 10
      GROUP BY info.query_row, ks.k, n_rel, n_cand),
nd AS (SELECT k, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM (
         SELECT k, dcg, coalesce(list_sum(list_transform(range(1, least(n_rel, least(k, n_cand)) + 1),
                                                         lambda i: 1.0 / log2(i + 1))), 0) AS idcg FROM d))
SELECT k, round(avg(ndcg), 6) AS ndcg_mean, round(stddev_pop(ndcg), 6) AS ndcg_std, count(*) AS n_queries
FROM nd GROUP BY k""")
def instruction_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with an instruction prompt retrieve assistant turns of their
    conversation (hash-encoded whole prompted texts): NDCG@{1,5,10}."""
    from vecbench.plans.evaluate import evaluate_dataset
    q, c = _turns(spark, sf_dir, "user"), _turns(spark, sf_dir, "assistant")
    ev = evaluate_dataset(q, c, dataset="conversations", encoder="hash16", alphas=(0.0,), betas=(0.0,),
                          ks=(1, 5, 10), text="v", image=None)
    return ev.metrics.select("k", _r("mean", "ndcg_mean"), _r("std", "ndcg_std"), "n_queries")
