"""Helpers shared by the pipeline operators: shared-folder tables, word and shingle hashes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbench.session import ensure_checkpoint_dir, table_path

#: Rows a side may have to be broadcast as a key list (8 bytes a key: 8 MB).
BROADCAST_KEYS = 1_000_000
#: Distinct words a Python worker remembers before it starts anew.
MEMO_WORDS = 400_000


def ship(spark: SparkSession) -> None:
    """Give the package to executors that do not have it installed, once a Spark context.

    What workers keep between tasks (the token look-ups) lives in an imported module.
    """
    context = spark.sparkContext
    if getattr(context, "_vecbench_shipped", None) is None:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="vecbench-"), "vecbench"), "zip",
                                      os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        context._vecbench_shipped = archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends here, so a lost
    executor never costs more than the step that it was in. ``discard`` removes it."""
    ship(df.sparkSession)
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that no later step reads; their plans fail from then on."""
    for df in tables:
        if path := getattr(df, "_settled", None):
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def semi_by_key(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a list of keys, broadcast only if it is counted as small."""
    keys = settle(keys.select(key).distinct(), "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, key, how)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join of a written table with one that has a row a key, when a third of the left rows may
    share a key.

    Keys with at least 1/2000 of the left rows (so 2000 at most) are hot: their right rows are broadcast
    and their left rows stay where they are. All others are joined by shuffle; rows with a null key match
    nothing and are not shuffled.
    """
    known = left.dropna(subset=on)
    least = max(1000, left.count() // 2000)
    hot = settle(known.groupBy(*on).count().filter(F.col("count") >= least).select(*on), "hot")
    parts = [known.join(F.broadcast(hot), on, "left_anti").join(right, on, how)]
    if hot.limit(1).count():
        theirs = settle(right.join(F.broadcast(hot), on, "left_semi"), "hot")
        parts.append(known.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(theirs), on, how))
    if how == "left":
        parts.append(left.filter(~F.expr(" and ".join(f"`{c}` is not null" for c in on))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def binary(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; the memory is bounded by starting anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all ``width``-word shingles in order; fewer words are one shingle, none give none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mixed((hashes * _POWERS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = hashes[: n - width + 1] * _POWERS[0]
    for j in range(1, width):
        total += hashes[j : n - width + 1 + j] * _POWERS[j]
    return mixed(total)


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` hash functions x -> a*x + b mod 2**64."""
    z = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return z[:count] | np.uint64(1), z[count:]
