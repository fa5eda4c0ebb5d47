"""Plan-shape tests: the scale properties the design relies on."""
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vecbench.operators.search import grid_search, topk_search
from vecbench.sources.testdata import embedding_items, read


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_not_shuffled_and_partial_topk_before_exchange(spark):
    items = embedding_items(spark, SF_MID)
    plan = _plan(grid_search(items, items, 5, exclude_self=True, c_block_rows=100))
    # one hash exchange spreads the (small) query side, one carries the partial top-k;
    # the catalog goes scan -> pack -> broadcast without a shuffle
    assert plan.count("Exchange hashpartitioning") == 2
    assert "BroadcastExchange" in plan
    assert plan.count("WindowGroupLimit") == 2          # partial (map side) + final


def test_scan_reads_only_used_columns(spark):
    e = read(spark, SF_MID, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    plan = _plan(topk_search(e, e, 3, vector="embedding"))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("label" not in s for s in scans)
