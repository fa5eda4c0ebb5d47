"""Any-to-any retrieval (A28): every row names the modality that it is encoded in, on either side of the search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecbench.functions.slerp import slerp
from vecbench.operators.metrics import ndcg_wide, summarize_wide
from vecbench.operators.relevance import relevance_info
from vecbench.operators.search import DEFAULT_KS, topk_search

TEXT, IMAGE, BOTH = "text", "image", "text+image"


def modality_vector(items: DataFrame, *, modality: str = "modality", text: str = "text_embedding", image: str = "image_embedding",
                    weight: float = 0.5, out: str = "v") -> DataFrame:
    """``items`` with the vector that each row's ``modality`` names: text, image or text+image (fused by slerp at
    ``weight``). Another or a null modality, or a row without that vector, gives a null vector: it is not found and finds
    nothing."""
    m = F.col(modality)
    both = F.when(F.col(text).isNotNull() & F.col(image).isNotNull(), slerp(text, image, weight))
    return items.withColumn(out, F.when(m == TEXT, F.col(text)).when(m == IMAGE, F.col(image)).when(m == BOTH, both))


def any_to_any(queries: DataFrame, items: DataFrame, k: int = 10, *, key: str = "id", modality: str = "modality",
               weight: float = 0.5, exclude_self: bool = False, **search) -> DataFrame:
    """Top-k items of every query, whatever their modalities: query_row, rank, item_row, score, rel. One search serves all
    pairs of modalities."""
    def side(df: DataFrame) -> DataFrame:
        return modality_vector(df, modality=modality, weight=weight).where(F.col("v").isNotNull())

    return topk_search(side(queries), side(items), k, vector="v", key=key, exclude_self=exclude_self, **search)


def any_to_any_ndcg(queries: DataFrame, items: DataFrame, ks: Sequence[int] = DEFAULT_KS, *, key: str = "id", modality: str = "modality",
                    weight: float = 0.5, exclude_self: bool = False) -> DataFrame:
    """NDCG@k by the query's modality: modality, k, mean, std, min, max, n_queries. Queries without a hit count as 0."""
    hits = any_to_any(queries, items, max(ks), key=key, modality=modality, weight=weight, exclude_self=exclude_self)
    found = modality_vector(items, modality=modality, weight=weight).where(F.col("v").isNotNull())
    info = relevance_info(queries, found, key=key, exclude_self=exclude_self)
    with_group = hits.withColumn("g", F.lit(0.0))
    per = ndcg_wide(with_group, info, ks, group=("g",), grid=[(0.0,)])
    named = per.join(queries.select(F.col("row_id").cast("bigint").alias("query_row"), F.col(modality).alias("modality")), "query_row")
    return summarize_wide(named, ks, group=("modality",))
