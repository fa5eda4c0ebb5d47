"""Quality rules: hashed n-gram log-likelihood ratio after base rules (operator 5). DataFrame functions only.

Features of a text are its n-grams, hashed into buckets: every word and the last two characters of every word
into ``BUCKETS``, and every pair of neighbouring words into as many of their own (one of them for a word that
repeats the one before). Two multinomials over the buckets, with one added
to each count, are the trusted target (labelled documents of quality 1) and the raw corpus (every word of
every document). A document's score is the sum of its features' log ratios over its number of words;
documents below a fixed threshold are rejected, each by the same rule.

A word is hashed once: pairs, and the windows that find repeated words, are hashes of hashes.

The target is fitted on at most ``TARGET_DOCS`` labelled documents, those with the smallest hashes of
their ids; the raw counts cover all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import settle

BUCKETS = 1 << 16
TARGET_DOCS = 20_000
#: Natural-log units a word.
THRESHOLD = -1.0
WINDOW = 8
_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def hashes(w: str = "_w") -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def pairs(h: str = "_h") -> Column:
    """Hash of every word's hash and that of the word before (null before the first)."""
    return F.transform(h, lambda x, i: F.xxhash64(F.get(F.col(h), i - 1), x))


def _bucket(c: Column) -> Column:
    return c.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ending(word: Column) -> Column:
    return _bucket(F.xxhash64(F.lit("~"), F.substring(word, -2, 2)))


def _pair(h: str, i: Column, x: Column, pair: Column) -> Column:
    """Bucket of a pair; BUCKETS itself for a repeated word."""
    return F.when(F.get(F.col(h), i - 1) == x, F.lit(BUCKETS)).otherwise(_bucket(pair) + F.lit(BUCKETS))


def features(w: str = "_w", h: str = "_h", p: str = "_p") -> Column:
    """Buckets of a text: its words, their endings, its pairs."""
    return F.concat(F.transform(h, _bucket), F.transform(w, _ending),
                    F.transform(p, lambda y, i: _pair(h, i, F.get(F.col(h), i), y)))


def log_ratios(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """One row with ``ratios``: log target share less log raw share of every bucket; zeros without a target."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long").alias("doc_id")
    trusted = labels.filter("quality = 1 and doc_id is not null").select(key).distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).withColumn("trusted", F.lit(1))
    rows = docs.select(key, words(F.col("text").cast("string")).alias("_w")).join(F.broadcast(trusted), "doc_id", "left")
    rows = rows.withColumn("_h", hashes()).withColumn("_p", pairs())
    counts = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(features()).alias("bucket")) \
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    counts = settle(spark.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0), "counts")
    total = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets")).first()
    share = lambda c, n: F.log(F.col(c) + 1) - F.log(F.lit(float(n + 2 * BUCKETS)))
    ratio = share("target", total.targets) - share("raw", total.raws) if total.targets else F.lit(0.0)
    listed = F.sort_array(F.collect_list(F.struct("bucket", ratio.alias("r"))))
    return settle(counts.agg(F.transform(listed, lambda x: x["r"]).alias("ratios")).coalesce(1), "ratios")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _w, _h, _p (words, hashes, pairs) and the base columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_w", words(text)).withColumn("_h", hashes()).withColumn("_p", pairs())
    # hashes of four words, two pairs each; a text without equal ones has no equal windows of eight
    out = out.withColumn("_q", F.transform("_p", lambda x, i: F.xxhash64(F.get(F.col("_p"), i - 2), x)))
    eights = F.transform("_q", lambda x, i: F.xxhash64(F.get(F.col("_q"), i - 4), x))
    out = out.withColumn("_g", F.when(F.size(F.array_distinct("_q")) < F.size("_q"),
                                      F.slice(eights, WINDOW, F.greatest(F.lit(0), F.size("_q") - (WINDOW - 1))))).drop("_q")
    # only texts with an equal pair of windows sort theirs
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(
        F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    same = lambda x, j: (F.get(F.col("_s"), j - 1)["h"] == x["h"]) | (F.get(F.col("_s"), j + 1)["h"] == x["h"])
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_s", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))).drop("_s")
    step = F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(WINDOW))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    out = out.withColumn("_l", lines)
    return out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"),
    }).drop("_at", "_l")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def judged(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` as ``d`` (a struct of all its columns) with the columns MEASURES.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. llr: log ratios of the
    features over the number of words (0 without words). kept: not base_failed and llr >= threshold. Null
    text counts as no words. Every row is judged alone, so null or repeated ids are no matter, and the
    columns of ``docs`` may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("text").cast("string").alias("text"))
    rows = measured(rows).drop("text").select("*", ratios.scalar().alias("_r"))
    ratio = lambda bucket: F.get(F.col("_r"), bucket)
    each = F.zip_with("_w", "_h", lambda w, h: ratio(_bucket(h)) + ratio(_ending(w)))
    both = F.transform("_p", lambda y, i: ratio(_pair("_h", i, F.get(F.col("_h"), i), y)))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    llr = F.when(F.col("n_words") > 0, (add(each) + add(both)) / F.col("n_words")).otherwise(F.lit(0.0))
    rows = rows.withColumn("llr", llr).drop("_w", "_h", "_p", "_r")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # the row number holds filters above the measures: pushed below, they would compute them many times
    above = F.monotonically_increasing_id() >= 0
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & above)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of ``docs``: doc_id and MEASURES (see ``judged``). An empty table gives an empty
    result; without trusted labels every log ratio is 0, so only the base rules reject."""
    return judged(docs, log_ratios(docs, labels), threshold).select(F.col("d.doc_id").alias("doc_id"), *MEASURES)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rejected rows.

    Every row is judged by its own text, so repeated rows stay or go together and null doc_ids are no matter. Null and
    empty texts have fewer than 20 words and go; an empty table stays empty.
    """
    return judged(docs, log_ratios(docs, labels), threshold).filter("kept").select("d.*")
