"""Per-user points rollup (A14) and rule-based record validation (V1).

Records are long or wide tables of optional integer counts per category.
The rollup groups by user and sums every category with missing = 0; the
validation turns a rule table into one output row per violation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(records: DataFrame, user: str, categories: Sequence[str]) -> DataFrame:
    """Per user, the integer sum of every category (missing = 0) and ``total``."""
    sums = [F.sum(F.coalesce(F.col(f"`{c}`"), F.lit(0))).cast("bigint").alias(c) for c in categories]
    out = records.groupBy(user).agg(*sums)
    return out.withColumn("total", sum((F.col(f"`{c}`") for c in categories), F.lit(0)).cast("bigint"))


def long_to_records(df: DataFrame, user: str, category: str, amount: str,
                    categories: Sequence[str]) -> DataFrame:
    """One wide record per input row: the row's category column holds its amount."""
    return df.select(user, *[F.when(F.col(category) == c, F.col(amount)).alias(c) for c in categories])


def violations(records: DataFrame, id_cols: Sequence[str], *, allowed: Sequence[str] | None = None,
               required_nonempty: Sequence[str] = (), minima: Mapping[str, int] | None = None,
               maxima: Mapping[str, int] | None = None, exceptions_col: str | None = None,
               exceptions: Sequence[str] = ()) -> DataFrame:
    """V1: one row per (record, rule) that fails.

    Rules: no column outside ``allowed`` holds a value; ``required_nonempty``
    columns are non-empty strings; a present value of a column in
    ``minima`` / ``maxima`` is >= / <= the bound; the maxima are waived for
    records whose ``exceptions_col`` value is in ``exceptions``.
    """
    checks = []
    if allowed is not None:
        extra = [c for c in records.columns if c not in allowed and c not in id_cols]
        for c in extra:
            checks.append((f"unknown:{c}", F.col(f"`{c}`").isNotNull()))
    for c in required_nonempty:
        checks.append((f"empty:{c}", F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`")) == "")))
    for c, lo in (minima or {}).items():
        checks.append((f"min:{c}", F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") < lo)))
    waived = F.col(exceptions_col).isin(list(exceptions)) if exceptions_col and exceptions else F.lit(False)
    for c, hi in (maxima or {}).items():
        checks.append((f"max:{c}", F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") > hi) & ~waived))
    if not checks:
        return records.select(*id_cols, F.lit(None).cast("string").alias("rule")).where(F.lit(False))
    failed = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]),
                      lambda x: x.isNotNull())
    return records.select(*id_cols, F.explode(failed).alias("rule"))
