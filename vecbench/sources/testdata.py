"""Readers for the driver's parquet tables and the embedding-table mapping.

The ``embeddings`` table (vec_id, embedding float[64], label) becomes a
two-modality item table: ``row_id = vec_id``, ``id = label`` (several rows
share an id: multi-instance relevance), text vector = the embedding,
image vector = the embedding rotated by 16 positions. Every row is both a
query and a catalog item; a query never retrieves itself (leave-one-out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.functions.vectors import as_double_vector, rotate
from vecbench.session import table_path

IMAGE_ROTATION = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def embedding_items(spark: SparkSession, sf_dir: str, dataset: str = "embeddings") -> DataFrame:
    """Item table (row_id, id, text_embedding, image_embedding) from ``embeddings``."""
    e = read(spark, sf_dir, "embeddings")
    t = as_double_vector("embedding")
    return e.select(
        F.lit(dataset).alias("dataset"),
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("id"),
        t.alias("text_embedding"),
        rotate(t, IMAGE_ROTATION).alias("image_embedding"),
    )
