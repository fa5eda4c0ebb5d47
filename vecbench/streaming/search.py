"""Structured Streaming: score arriving queries against a static catalog.

All search and metric operators are stateless per batch, so a stream of
query rows is handled by ``foreachBatch``: every micro-batch runs the same
DataFrame plan as a batch job (blocked exact search, optional NDCG) and is
written to ``<sink>/epoch=<id>`` with overwrite, so a re-run epoch after a
failure replaces its own output (idempotent). The checkpoint lives under
the session's shared ``spark.checkpoint.dir`` unless given.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecbench.operators.search import DEFAULT_WEIGHTS, grid_search
from vecbench.session import ensure_checkpoint_dir


def stream_search(queries: DataFrame, catalog: DataFrame, sink: str, *, k: int = 10,
                  alphas: Sequence[float] = DEFAULT_WEIGHTS, betas: Sequence[float] = DEFAULT_WEIGHTS,
                  key: str | None = "id", checkpoint: str | None = None, name: str = "vecbench_search",
                  available_now: bool = True, **search_kw) -> StreamingQuery:
    """Top-k hits for every streamed query row and every (alpha, beta), per micro-batch."""
    spark = queries.sparkSession
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", name)

    def run(batch: DataFrame, epoch: int) -> None:
        hits = grid_search(batch, catalog, k, alphas=alphas, betas=betas, key=key, **search_kw)
        hits.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))

    w = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
