"""The thin queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.llm import sql
from vecbench.llm.common import new_folder, table
from vecbench.llm.decontaminate import contained_items
from vecbench.llm.fim import fill_in_middle
from vecbench.llm.licenses import license_scan
from vecbench.llm.minhash import near_duplicates
from vecbench.llm.orcfiles import read_digests, write_token_files
from vecbench.llm.packing import Capacity, pack
from vecbench.llm.quality import quality
from vecbench.llm.registry import register
from vecbench.llm.sharding import shards_by_rows
from vecbench.llm.tokencache import token_counts
from vecbench.llm.tokens import vocabulary
from vecbench.llm.toxicity import toxicity
from vecbench.llm.urlfilter import TRACKING, judge_urls, recrawled
from vecbench.llm.vectorcodes import codes_sql, vector_codes
from vecbench.llm.warc import archived


@register("op10_bbit_minhash", f"""
WITH w AS (SELECT doc_id, {sql.lower_words('text')} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct({sql.shingle_list('ws')}) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
          WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (WITH RECURSIVE r AS (SELECT doc_id AS node, doc_id AS other FROM documents
          UNION SELECT r.node, both_ways.b FROM r JOIN both_ways ON r.other = both_ways.a) SELECT * FROM r)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(reach.other) AS component_id, s.doc_id = min(reach.other) AS kept
FROM s JOIN reach ON reach.node = s.doc_id GROUP BY s.doc_id, len(s.sh)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


_BARE = r"regexp_extract_all(regexp_replace({0}, '[!-/:-@\[-`{{-~]', '', 'g'), '[^\x20\x09-\x0D]+')"


@register("op1_containment", f"""
WITH d AS (SELECT doc_id, {_BARE.format(sql.ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
i AS (SELECT item_id, {_BARE.format(sql.ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
ds AS (SELECT doc_id, unnest(list_distinct({sql.shingle_list('ws')})) AS g FROM d),
its AS (SELECT item_id, list_distinct({sql.shingle_list('ws')}) AS sh FROM i),
ie AS (SELECT item_id, unnest(sh) AS g FROM its),
n AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN ie USING (g) GROUP BY 1, 2)
SELECT doc_id, n.item_id, n_found, CAST(len(sh) AS BIGINT) AS n_item, n_found / len(sh) AS containment
FROM n JOIN its ON its.item_id = n.item_id WHERE n_found >= 0.75 * len(sh)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), containment=0.75)


@register("op2_vector_best_fit")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), Capacity(tokens=2048), end_id=0)


@register("op3_digest_cache")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own: the query measures the whole work, not what an earlier call left
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), new_folder(spark, "cache"), limit=2048)


@register("op4_feistel")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards_by_rows(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@register("op5_hashed_llr")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_orc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "orc")
    write_token_files(table(spark, sf_dir, "documents"), vocabulary(), folder, end_id=2)
    return read_digests(spark, folder)


@register("op8_levenshtein_trie")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@register("op9_chunked_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), least_bytes=0)


#: The rules of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

_RULE_ROWS = ", ".join(str(r) for r in URL_RULES)
_SQL_TRACKING = ", ".join(f"'{p}'" for p in TRACKING)


@register("op7_blocked_bloom", rf"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_ROWS}),
r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {sql.ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                lambda x: x <> '' AND NOT list_contains([{_SQL_TRACKING}], string_split(x, '=')[1]))) AS kept FROM r),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM p),
many AS (SELECT canonical FROM c WHERE canonical <> '' GROUP BY 1 HAVING count(*) > 1),
fit AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
        FROM c JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN many.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       many.canonical IS NOT NULL AS listed
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN many ON many.canonical = c.canonical""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables hold no list of URLs: canonical URLs that were crawled more than once serve as one
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    return judge_urls(pages, rules, recrawled(pages))


@register("op11_license_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@register("op12_piece_table", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS r3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS r4 FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR r3 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
             WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:least(c1, c2)], '') AS p,
             array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM f""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_output=False)


@register("op13_cover_tree_lloyd", codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)
