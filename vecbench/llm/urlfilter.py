"""URL rules and lists behind a blocked Bloom filter (operator 7).

A key is a rule (host suffix and path prefix) or a listed canonical URL. All keys enter one blocked
Bloom filter: a block of eight 64-bit words a key, one bit in each word. A URL offers few candidate keys
(its host suffixes with its path prefixes of the lengths that rules have, and its canonical form). Each
distinct candidate is tried on its block; only possible hits go to the exact hash join with the keys,
which removes false positives. The longest rule wins; a URL without a rule is blocked if it is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import BROADCAST_KEYS, settle, skew_join

WORDS = 8
#: Blocks that may be broadcast (64 bytes each).
BROADCAST_BLOCKS = 200_000
#: Query parameters that name a campaign, not a page.
TRACKING = "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref"


def split_url(url: Column) -> dict[str, Column]:
    """host, path and query of a URL; without ``://`` or null all are empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def canonical(host: Column, path: Column, query: Column) -> Column:
    """host without ``www.``, path without a slash at its end, sorted query parameters but the tracking ones."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", ""), tail))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """One bit of a word, by a hash of its own."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit(word)), 58).cast("int"))


def bloom(keys: DataFrame, count: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of the column ``key``: a row a block that has keys, and the number of blocks."""
    blocks = max(1, -(-count * bits_per_key // (64 * WORDS)))
    masks = [F.bit_or(_mask(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*masks), blocks


def possible(candidates: DataFrame, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """Distinct candidate keys that the filter passes: all keys that are in it, and few others."""
    small = filter_rows if blocks > BROADCAST_BLOCKS else F.broadcast(filter_rows)
    test = None
    for w in range(WORDS):
        one = F.col(f"w{w}").bitwiseAND(_mask(F.col("key"), w)) != 0
        test = one if test is None else test & one
    return candidates.withColumn("block", _block(F.col("key"), blocks)).join(small, "block").filter(test).select("key")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """One row a row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, listed.

    ``rules``: rule_host, rule_path, action ('allow' or 'block'); a rule fits its host and all subdomains
    if the path starts with rule_path. The rule with the longest text (host + path) wins, of equal ones
    that with the longer host, then 'block'. ``listed``: canonical (see ``canonical``). A null URL or one
    without ``://`` has empty host and path, fits no rule and is never listed: allow. Null or repeated
    page_ids keep a row each, null rules and list entries are ignored, further columns too.
    """
    parts = split_url(F.col("url").cast("string"))
    rows = settle(pages.select("page_id", *[c.alias(n) for n, c in parts.items()])
                  .withColumn("canonical", canonical(F.col("host"), F.col("path"), F.col("query"))).drop("query")
                  .withColumn("row", F.monotonically_increasing_id()), "urls")

    text = F.concat("rule_host", "rule_path")
    own = rules.dropna(subset=["rule_host", "rule_path", "action"]).select(
        F.concat(F.lit("R "), "rule_host", F.lit(" "), "rule_path").alias("key"),
        F.struct(F.length(text).alias("length"), F.length("rule_host").alias("host_length"), F.col("action"), text.alias("rule")).alias("fit"))
    own = own.groupBy("key").agg(F.max("fit").alias("fit"))
    entries = listed.select(F.col("canonical")).filter("canonical <> ''").distinct() \
        .select(F.concat(F.lit("L "), "canonical").alias("key"), F.lit(None).cast(own.schema["fit"].dataType).alias("fit"))
    keys = settle(own.unionByName(entries), "keys")
    count = keys.count()
    # the distinct lengths of rule paths: at most as many as the longest path has characters
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path").alias("n")).dropna().distinct().collect())

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) \
        if lengths else F.array().cast("array<string>")
    offered = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("R "), s, F.lit(" "), p)))))
    whole = F.array(F.concat(F.lit("L "), "canonical"))
    candidates = settle(rows.filter("host <> ''").select("row", F.explode(F.concat(offered, whole)).alias("key")), "candidates")

    filter_rows, blocks = bloom(keys.select("key"), count)
    passed = possible(candidates.select("key").distinct(), filter_rows, blocks)
    hits = settle(passed.join(keys, "key"), "hits")  # the exact hash join
    if hits.count() <= BROADCAST_KEYS:
        met = candidates.join(F.broadcast(hits), "key")
    else:
        met = skew_join(candidates, hits, ["key"], "inner")
    best = met.groupBy("row").agg(F.max("fit").alias("fit"), F.max(F.col("fit").isNull()).alias("on_list"))
    found = rows.join(best, "row", "left")
    on_list = F.coalesce("on_list", F.lit(False))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                        F.coalesce(F.col("fit.action"), F.when(on_list, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                        on_list.alias("listed"))


def recrawled(pages: DataFrame) -> DataFrame:
    """Canonical URLs that more than one row of ``pages`` has."""
    parts = split_url(F.col("url").cast("string"))
    return pages.select(canonical(parts["host"], parts["path"], parts["query"]).alias("canonical")) \
        .groupBy("canonical").count().filter("count > 1 and canonical <> ''").select("canonical")
