"""Task / model catalog operations.

Task metadata is a DataFrame with array columns (``languages``, ``domains``,
``modalities``) and scalars (``task_name``, ``type``). Filters are column
predicates; overview tables are grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbench.functions.text import lang_part, script_part


def _arr(values: Sequence[str]):
    return F.array(*[F.lit(v) for v in values])


def filter_tasks(tasks: DataFrame, *, names: Sequence[str] | None = None,
                 types: Sequence[str] | None = None, languages: Sequence[str] | None = None,
                 scripts: Sequence[str] | None = None, domains: Sequence[str] | None = None,
                 modalities: Sequence[str] | None = None,
                 exclusive_modality: bool = False) -> DataFrame:
    """Keep tasks matching every given criterion; a list means "any of".

    Languages match the part before ``-`` of codes like ``eng-Latn``, scripts
    the part after. ``exclusive_modality`` keeps tasks whose modalities are
    exactly the requested set instead of overlapping it.
    """
    cond = F.lit(True)
    if names is not None:
        cond &= F.col("task_name").isin(list(names))
    if types is not None:
        cond &= F.col("type").isin(list(types))
    if languages is not None:
        cond &= F.arrays_overlap(F.transform("languages", lang_part), _arr(languages))
    if scripts is not None:
        cond &= F.arrays_overlap(F.transform("languages", script_part), _arr(scripts))
    if domains is not None:
        cond &= F.arrays_overlap(F.col("domains"), _arr(domains))
    if modalities is not None:
        if exclusive_modality:
            cond &= F.array_sort(F.array_distinct(F.col("modalities"))) == \
                F.array_sort(F.array_distinct(_arr(modalities)))
        else:
            cond &= F.arrays_overlap(F.col("modalities"), _arr(modalities))
    return tasks.where(cond)


def filter_splits(rows: DataFrame, *, splits: Sequence[str] | None = None,
                  subsets: Sequence[str] | None = None,
                  languages: Sequence[str] | None = None) -> DataFrame:
    """P10: split / subset / language selection; a pair ``fr-en`` matches either side."""
    cond = F.lit(True)
    if splits is not None:
        cond &= F.col("split").isin(list(splits))
    if subsets is not None:
        cond &= F.col("subset").isin(list(subsets))
    if languages is not None:
        cond &= F.arrays_overlap(F.split(F.col("subset"), "-"), _arr(languages))
    return rows.where(cond)


def filter_models(models: DataFrame, name_contains: str | None = None, predicate=None) -> DataFrame:
    """Models whose name contains a text and/or that satisfy a column predicate."""
    cond = F.lit(True)
    if name_contains is not None:
        cond &= F.col("name").contains(name_contains)
    if predicate is not None:
        cond &= predicate
    return models.where(cond)


def unpivot_documents(df: DataFrame, id_col: str, text_cols: Sequence[str], label_col: str | None,
                      *, seed: int = 1111, batch_size: int = 512,
                      max_batches: int | None = None) -> DataFrame:
    """Several text columns -> one ``document`` per (row, column), same label;
    seeded hash order; consecutive batches of ``batch_size``.

    The order is ``md5(id || column || seed)`` (no global shuffle state), and
    the batch number comes from a row number over that order. A cap
    (``max_batches``) is the documented down-sampling feature; by default all
    batches are kept.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("document"))
                                for c in text_cols]))
    keep = [id_col] + ([label_col] if label_col else [])
    long = df.select(*keep, stack.alias("_s")).select(*keep, "_s.field", "_s.document")
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("field"), F.lit(str(seed))))
    ranked = global_rank(long.withColumn("_o", order), "_o", "position")
    out = ranked.withColumn("batch", F.floor((F.col("position") - 1) / batch_size).cast("int")).drop("_o")
    if max_batches is not None:
        out = out.where(F.col("batch") < max_batches)
    return out


def collect_batches(documents: DataFrame, label_col: str | None = None, *, by: Sequence[str] = (), batch: str = "batch",
                    position: str = "position", document: str = "document") -> DataFrame:
    """One row a batch with ``sentences`` and ``labels`` (without ``label_col``: none) in the order of ``position``, and ``n``.

    ``by`` names columns that batches are numbered within (a split). An array holds the rows of one batch, so its size is
    bounded by the batch size that numbered them.
    """
    item = F.struct(F.col(position).alias("p"), F.col(document).alias("d"), *([F.col(label_col).alias("l")] if label_col else []))
    held = F.sort_array(F.collect_list(item))
    rows = documents.groupBy(*by, batch).agg(held.alias("_b"))
    labels = [F.transform("_b", lambda x: x["l"]).alias("labels")] if label_col else []
    return rows.select(*by, batch, F.transform("_b", lambda x: x["d"]).alias("sentences"), *labels, F.size("_b").alias("n"))


def global_rank(df: DataFrame, hex_key: str, out: str, prefix: int = 4,
                group_rows: int = 1_000_000) -> DataFrame:
    """1-based position of every row in the order of a uniform hex key (e.g. md5).

    Distributed, and safe when one key has a huge number of copies:
    1. distinct keys and their multiplicity (partial aggregation absorbs hot keys);
    2. each key's first position: the distinct keys are bucketed on the first
       ``prefix`` hex digits (uniform), bucket totals become offsets over at
       most 16^prefix rows, and a running sum inside each bucket adds the rest;
    3. copies of one key (indistinguishable, so any order) are split into
       salted sub-groups of about ``group_rows`` (the salted rows are
       checkpointed once so both uses see the same salts), numbered inside
       them, and offset by a running sum over the few sub-groups of that key.
    No step holds more than one bucket or one sub-group.
    """
    counts = df.groupBy(hex_key).agg(F.count("*").alias("_n"))
    kc = counts.withColumn("_bucket", F.substring(F.col(hex_key), 1, prefix))
    sizes = kc.groupBy("_bucket").agg(F.sum("_n").alias("_bn"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bucket").orderBy(hex_key).rowsBetween(Window.unboundedPreceding, -1)
    starts = (kc.withColumn("_w", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
                .join(F.broadcast(offsets), "_bucket")
                .select(hex_key, "_n", (F.col("_off") + F.col("_w")).alias("_start")))
    keyed = df.join(starts, hex_key)
    # Salts come from row ids, which must be identical in both uses below:
    # the salted rows are written once to the shared checkpoint folder.
    from vecbench.session import cut_lineage
    keyed = cut_lineage(keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(),
                                                         F.ceil(F.col("_n") / group_rows).cast("bigint"))))
    sub = keyed.groupBy(hex_key, "_salt").agg(F.count("*").alias("_sn"))
    prev = Window.partitionBy(hex_key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.select(hex_key, "_salt", F.coalesce(F.sum("_sn").over(prev), F.lit(0)).alias("_soff"))
    within = F.row_number().over(Window.partitionBy(hex_key, "_salt").orderBy(hex_key))
    return (keyed.join(sub, [hex_key, "_salt"])
                 .withColumn(out, (F.col("_start") + F.col("_soff") + within).cast("bigint"))
                 .drop("_n", "_start", "_salt", "_soff"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str], *,
             explode_array: bool = False, total_row: bool = True) -> DataFrame:
    """Counts of ``row`` x ``col`` (zero-filled), a row sum, a grand-total row.

    With ``explode_array`` the ``row`` column is an array and each element
    counts (a multilingual task counts once in every language).
    """
    src = df.select(F.explode(row).alias(row) if explode_array else F.col(row), F.col(col))
    wide = src.groupBy(row).pivot(col, list(values)).count().na.fill(0, subset=list(values))
    wide = wide.withColumn("row_sum", sum((F.col(f"`{v}`") for v in values), F.lit(0)).cast("bigint"))
    if not total_row:
        return wide
    tot = wide.agg(*[F.sum(F.col(f"`{v}`")).alias(v) for v in values],
                   F.sum("row_sum").alias("row_sum")).withColumn(row, F.lit("Total"))
    return wide.unionByName(tot)


def group_overview(df: DataFrame, group: str, member: str, *, set_cols: Sequence[str] = (),
                   count_col: str | None = None) -> DataFrame:
    """Per group: number of members, sorted union of ``set_cols`` values,
    and ``value: count`` per ``count_col`` value as sorted text."""
    aggs = [F.count_distinct(member).alias("n_members")]
    for c in set_cols:
        aggs.append(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"all_{c}"))
    out = df.groupBy(group).agg(*aggs)
    if count_col:
        per = (df.groupBy(group, count_col).agg(F.count_distinct(member).alias("_n"))
                 .groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(
                     F.concat(F.col(count_col), F.lit(": "), F.col("_n").cast("string")))), ", ")
                     .alias(f"{count_col}_counts")))
        out = out.join(per, group, "left")
    return out


def describe(df: DataFrame, group: Sequence[str], text_col: str, distinct_col: str | None = None) -> DataFrame:
    """Samples, text length (avg / min / max) and distinct values per group."""
    ln = F.length(text_col)
    aggs = [F.count("*").alias("n_samples"), F.avg(ln).alias("avg_length"),
            F.min(ln).alias("min_length"), F.max(ln).alias("max_length")]
    if distinct_col:
        aggs.append(F.count_distinct(distinct_col).alias(f"n_distinct_{distinct_col}"))
    return df.groupBy(*group).agg(*aggs)
