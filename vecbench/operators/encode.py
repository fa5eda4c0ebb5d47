"""Embedding production (E1-E8) and the incremental embedding store.

An encoder is a plain Python function ``list[str] -> array (n, d)`` (E1).
It runs inside ``mapInArrow``: Spark partitions the rows, each task loads
the model once and calls it on batches of ``batch_size`` rows with bounded
retries (E3); vectors leave as Arrow lists over one flat buffer. Linear adapters (E4/E5) are native expressions or Arrow
matrix products; PCA (E6) is ``pyspark.ml``; composition (E7/E8) is
function composition over DataFrames.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecbench.functions.hashing import content_key, hash_vector
from vecbench.functions.vectors import EPS, normalize, scale
from vecbench.operators.blocks import _dense
from vecbench.operators.store import VectorStore

Encoder = Callable[[list], "np.ndarray"]
VEC = T.ArrayType(T.DoubleType())


def _with_retry(fn: Encoder, batch: list, retries: int, backoff: float):
    for attempt in range(retries + 1):
        try:
            return np.asarray(fn(batch), dtype=np.float64)
        except Exception:  # noqa: BLE001 - the user's encoder decides what is transient
            if attempt == retries:
                raise
            time.sleep(backoff * (2 ** attempt))
    raise RuntimeError("unreachable")


def encode(df: DataFrame, encoder: Encoder | Callable[[], Encoder], column: str, out: str, *,
           batch_size: int = 32, retries: int = 2, backoff: float = 0.5,
           factory: bool = False) -> DataFrame:
    """Add ``out`` = encoder(column) computed in Arrow batches.

    ``factory=True`` means ``encoder`` is a zero-argument function returning
    the encoder; it is called once per task (load the model once). NULL
    inputs give NULL vectors. Row order and identity are kept by Spark, not
    by list positions.
    """
    kept, schema = _output(df, out)

    def run(batches):
        fn = encoder() if factory else encoder
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            present = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            values = texts.to_pylist()
            parts = [_with_retry(fn, [values[i] for i in present[lo:lo + batch_size]], retries, backoff)
                     for lo in range(0, len(present), batch_size)]
            yield _appended(batch, kept, out, np.concatenate(parts) if parts else np.empty((0, 0)), present)
    return df.mapInArrow(run, schema)


def _output(df: DataFrame, out: str) -> tuple[list[str], T.StructType]:
    """Columns that stay and the schema with ``out`` last; an existing ``out`` is replaced."""
    kept = [f for f in df.schema.fields if f.name != out]
    return [f.name for f in kept], T.StructType([*kept, T.StructField(out, VEC)])


def vector_lists(m: np.ndarray, present: np.ndarray, n: int) -> pa.Array:
    """List array of ``n`` rows: row ``present[i]`` is ``m[i]``, the others are null. One flat buffer, no row objects."""
    if len(m) != len(present):
        raise ValueError(f"an encoder returned {len(m)} vectors for {len(present)} rows")
    length = np.zeros(n, np.int64)
    length[present] = m.shape[1] if len(m) else 0
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    null = np.ones(n, bool)
    null[present] = False
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m, np.float64).ravel()), mask=pa.array(null))
    return lists


def _appended(batch: pa.RecordBatch, kept: list[str], out: str, m: np.ndarray, present: np.ndarray) -> pa.RecordBatch:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
    return pa.RecordBatch.from_arrays([*columns, vector_lists(m, present, batch.num_rows)], [*kept, out])


def hash_encode(df: DataFrame, column: str, out: str, dim: int, salt: str = "text") -> DataFrame:
    """Deterministic hash encoder as native expressions (test data, baselines)."""
    return df.withColumn(out, hash_vector(column, dim, salt))


# ------------------------------------------------------------------ adapters
def adapt_identity(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def adapt_normalize(v: str | Column, eps: float = EPS) -> Column:
    """E5 ``normalize``."""
    return normalize(v, eps)


def adapt_scale(v: str | Column, factor: float) -> Column:
    """E5 ``scaling``."""
    return scale(v, factor)


def adapt_linear(df: DataFrame, column: str, matrix: np.ndarray, out: str | None = None,
                 normalize_output: bool = True, eps: float = EPS) -> DataFrame:
    """E4 (and E5 ``rotation`` for an orthogonal matrix): ``v @ matrix`` then L2 normalise.

    The matrix (d x d') is a small, bounded model parameter; it is shipped
    with the task closure and applied to Arrow batches as one matrix product.
    """
    out = out or column
    m = np.asarray(matrix, dtype=np.float64)
    kept, schema = _output(df, out)

    def run(batches):
        for batch in batches:
            x, has, _ = _dense(batch.column(batch.schema.get_field_index(column)).cast(pa.list_(pa.float64())))
            y = x[has] @ m if has.any() else np.empty((0, 0))
            if normalize_output and len(y):
                y = y / (np.linalg.norm(y, axis=1, keepdims=True) + eps)
            yield _appended(batch, kept, out, y, np.flatnonzero(has))
    return df.mapInArrow(run, schema)


def rotation_matrix(dim: int, seed: int = 0) -> np.ndarray:
    """A seeded random orthogonal matrix (QR of a Gaussian matrix)."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_pca(df: DataFrame, column: str, k: int):
    """Fit PCA on ``column`` (array<double>); returns the fitted model."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    vec = df.select(array_to_vector(F.col(column)).alias("_v")).where(F.col("_v").isNotNull())
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)


def apply_pca(model, df: DataFrame, column: str, out: str) -> DataFrame:
    """Project ``column`` with a fitted PCA model (fit on the catalog, applied to both sides)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    staged = df.withColumn("_v", array_to_vector(F.col(column)))
    return (model.transform(staged).withColumn(out, vector_to_array("_p"))
                 .drop("_v", "_p"))


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An ordered list of adapters (or an adapter over a base encoder)."""
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df
    return run


# ------------------------------------------------------- embedding store
def missing_rows(df: DataFrame, store: DataFrame | None, key_cols: Sequence[str]) -> DataFrame:
    """Rows whose content key is not in the store yet (``left_anti``)."""
    keyed = df.withColumn("content_key", content_key(*key_cols))
    if store is None:
        return keyed
    return keyed.join(store.select("content_key").distinct(), "content_key", "left_anti")


def store_of(spark, path: str, *, encoder_name: str, config: str, dataset: str, side: str, vector_cols: Sequence[str],
             buckets: int = 64) -> VectorStore:
    """The store of one (encoder, configuration, dataset, side): a folder of its own below ``path``."""
    fingerprint = hashlib.md5(f"{encoder_name}_{config}".encode()).hexdigest()[:8]
    parts = {"encoder": encoder_name, "config_hash": fingerprint, "dataset": dataset, "side": side}
    folder = "/".join(f"{k}={quote(v, safe='')}" for k, v in parts.items())
    return VectorStore(spark, f"{path.rstrip('/')}/{folder}", vector_cols, buckets)


def incremental_encode(spark, df: DataFrame, path: str, *, encoder_name: str, config: str,
                       dataset: str, side: str, key_cols: Sequence[str],
                       encode_fn: Callable[[DataFrame], DataFrame], vector_cols: Sequence[str], buckets: int = 64
                       ) -> DataFrame:
    """Read vectors from the store, encode only rows not stored yet, append them.

    The store is bucketed by content key (see ``store.VectorStore``), one for each (encoder, config_hash, dataset,
    side); a row's identity is the md5 of its content, so edited rows are
    re-encoded (the key changes) and unchanged rows never are. Returns the
    input rows joined to their vectors; the stored side is not shuffled.
    """
    store = store_of(spark, path, encoder_name=encoder_name, config=config, dataset=dataset, side=side, vector_cols=vector_cols, buckets=buckets)
    keyed = df.withColumn("content_key", content_key(*key_cols))
    # one encoding per distinct content: copies of a text (which may be a large
    # share of a corpus) are encoded once and stored once
    todo = store.missing(keyed).dropDuplicates(["content_key"])
    store.append(encode_fn(todo).select("content_key", *vector_cols))
    return keyed.join(store.read(), "content_key", "left")
