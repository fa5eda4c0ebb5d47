"""Vector blocks: pack rows of a partition into dense matrices (Arrow).

A block is one row holding up to ``block_rows`` vectors of one partition:
row ids, keys, the two modalities flattened row-major, and presence flags.
Packing is a narrow ``mapInArrow`` (no shuffle); blocks are what the search
operators pair and multiply, so the per-pair work is one BLAS call and the
number of Python rows crossing the Arrow boundary is tiny.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = ("blk bigint, part int, grp bigint, n int, row_ids array<bigint>, keys array<string>, "
                "dim_t int, dim_i int, t array<double>, i array<double>, "
                "has_t array<boolean>, has_i array<boolean>")


def _dense(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """ListArray of doubles -> (n, d) matrix (NULL rows are zeros), presence mask, d."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    n = len(arr)
    has = ~np.asarray(arr.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    offsets = np.asarray(arr.offsets.to_numpy(), dtype=np.int64)
    lens = np.diff(offsets)
    lens = np.where(has, lens, 0)
    present = lens[has]
    d = int(present.max()) if present.size else 0
    if present.size and (present != d).any():
        raise ValueError("vectors of one modality must share one dimension (validate first)")
    has = has & (lens > 0)
    mat = np.zeros((n, d), dtype=np.float64)
    if d and has.any():
        # flatten() drops the slots of NULL lists, so values align with present rows
        vals = arr.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
        mat[has] = np.asarray(vals, dtype=np.float64).reshape(-1, d)
    return mat, has, d


def _emit(part: int, seq: int, grp, row_ids, keys, t, ht, dt, im, hi, di) -> pa.RecordBatch:
    order = np.argsort(row_ids, kind="stable")
    row_ids, keys = row_ids[order], keys[order]
    t, ht, im, hi = t[order], ht[order], im[order], hi[order]
    n = len(row_ids)
    return pa.RecordBatch.from_pydict({
        "blk": pa.array([(part << 24) + seq], pa.int64()),
        "part": pa.array([part], pa.int32()),
        "grp": pa.array([grp], pa.int64()),
        "n": pa.array([n], pa.int32()),
        "row_ids": pa.array([row_ids], pa.list_(pa.int64())),
        "keys": pa.array([keys.tolist()], pa.list_(pa.string())),
        "dim_t": pa.array([dt], pa.int32()),
        "dim_i": pa.array([di], pa.int32()),
        "t": pa.array([t.ravel()], pa.list_(pa.float64())),
        "i": pa.array([im.ravel()], pa.list_(pa.float64())),
        "has_t": pa.array([ht], pa.list_(pa.bool_())),
        "has_i": pa.array([hi], pa.list_(pa.bool_())),
    })


def _pack_partition(block_rows: int, grouped: bool, whole: bool = False):
    def pack(batches):
        part = TaskContext.get().partitionId()
        seq = 0

        def flush(tbl: pa.Table, grp):
            nonlocal seq
            rid = np.asarray(tbl.column("row_id").to_numpy(), dtype=np.int64)
            keys = np.asarray(tbl.column("key").to_pylist(), dtype=object)
            t, ht, dt = _dense(tbl.column("t"))
            im, hi, di = _dense(tbl.column("i"))
            out = _emit(part, seq, grp, rid, keys, t, ht, dt, im, hi, di)
            seq += 1
            return out

        buf: list[pa.Table] = []
        held, cur = 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            tbl = pa.Table.from_batches([b])
            # split the batch where the group changes (input is sorted by group)
            if grouped:
                g = np.asarray(tbl.column("grp").to_numpy(), dtype=np.int64)
                cuts = np.flatnonzero(np.diff(g)) + 1
                pieces = [(int(g[a]), tbl.slice(a, e - a))
                          for a, e in zip(np.r_[0, cuts], np.r_[cuts, len(g)])]
            else:
                pieces = [(None, tbl)]
            for grp, piece in pieces:
                if whole:
                    # groups are kept whole: close the block before a group that would overflow it
                    if buf and grp != cur and held + piece.num_rows > block_rows:
                        yield flush(pa.concat_tables(buf), cur)
                        buf, held = [], 0
                    cur = grp
                    buf.append(piece)
                    held += piece.num_rows
                    continue
                if buf and grp != cur:
                    yield flush(pa.concat_tables(buf), cur)
                    buf, held = [], 0
                cur = grp
                buf.append(piece)
                held += piece.num_rows
                while held >= block_rows:
                    joined = pa.concat_tables(buf)
                    yield flush(joined.slice(0, block_rows), cur)
                    rest = joined.slice(block_rows)
                    buf, held = ([rest] if rest.num_rows else []), rest.num_rows
        if held:
            yield flush(pa.concat_tables(buf), cur)
    return pack


def _columns(df: DataFrame, row_id: str, key: str | None, text: str, image: str | None, *more) -> DataFrame:
    cols = [F.col(row_id).cast("bigint").alias("row_id"),
            (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
            F.col(text).cast("array<double>").alias("t"),
            (F.col(image).cast("array<double>") if image else
             F.lit(None).cast("array<double>")).alias("i"), *more]
    return df.select(*cols).where(F.col("t").isNotNull() | F.col("i").isNotNull())


def pack_blocks(df: DataFrame, block_rows: int, *, row_id: str = "row_id", key: str | None = "id",
                text: str = "text_embedding", image: str | None = "image_embedding",
                group: str | None = None, whole_groups: bool = False,
                partitions: int | None = None, pre_grouped: bool = False) -> DataFrame:
    """Pack each partition of ``df`` into blocks of at most ``block_rows`` rows.

    With ``group`` (a bigint column) the rows are hash-partitioned and sorted
    by it first, and a block never mixes two groups; the block's ``grp`` is
    the join key of grouped searches (IVF cells). With ``whole_groups`` a
    block instead holds several complete groups (a group larger than
    ``block_rows`` is one block of its own), so no group is split across
    blocks; ``partitions`` sets the number of hash partitions.
    ``pre_grouped`` says each group's rows are already adjacent inside one
    partition (e.g. the tokens one ``posexplode`` made), so no shuffle is needed.
    """
    src = _columns(df, row_id, key, text, image, *[F.col(group).cast("bigint").alias("grp")] if group else [])
    if group and not pre_grouped:
        src = (src.repartition(partitions, "grp") if partitions else src.repartition("grp"))
        src = src.sortWithinPartitions("grp", "row_id")
    return src.mapInArrow(_pack_partition(block_rows, bool(group), whole_groups), BLOCK_SCHEMA)


def unpack(batch: pa.RecordBatch, j: int, prefix: str):
    """Block ``j`` of a batch -> (row_ids, keys, T, has_t, I, has_i)."""
    def col(name):
        return batch.column(f"{prefix}{name}")
    n = col("n")[j].as_py()
    rid = np.asarray(col("row_ids")[j].values.to_numpy(), dtype=np.int64)
    keys = np.asarray(col("keys")[j].values.to_pylist(), dtype=object)
    dt, di = col("dim_t")[j].as_py(), col("dim_i")[j].as_py()
    t = np.asarray(col("t")[j].values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, dt)
    im = np.asarray(col("i")[j].values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, di)
    ht = np.asarray(col("has_t")[j].values.to_numpy(zero_copy_only=False), dtype=bool)
    hi = np.asarray(col("has_i")[j].values.to_numpy(zero_copy_only=False), dtype=bool)
    return rid, keys, t, ht, im, hi


TILE_SCHEMA = "tile int, query boolean, n int, ids binary, keys array<string>, t binary, i binary, has_t binary, has_i binary, wide boolean"


def tile_of(ids: np.ndarray, tiles: int) -> np.ndarray:
    """The tile of every row id: a hash of it."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles


def _tile_row(tile: int, query: bool, block: tuple) -> pa.RecordBatch:
    ids, keys, t, ht, im, hi = block
    v = [t, im]
    short = [x.astype(np.float32) for x in v]
    wide = not all(np.array_equal(x, y) for x, y in zip(v, short, strict=True))
    x, y = v if wide else short
    return pa.RecordBatch.from_pydict({
        "tile": pa.array([tile], pa.int32()), "query": pa.array([query]), "n": pa.array([len(ids)], pa.int32()),
        "ids": pa.array([ids.tobytes()]), "keys": pa.array([list(keys)], pa.list_(pa.string())),
        "t": pa.array([x.tobytes()]), "i": pa.array([y.tobytes()]), "has_t": pa.array([ht.tobytes()]),
        "has_i": pa.array([hi.tobytes()]), "wide": pa.array([wide])})


def pack_tiles(df: DataFrame, block_rows: int, tiles: int, *, query: bool, row_id: str = "row_id", key: str | None = "id",
               text: str = "text_embedding", image: str | None = "image_embedding") -> DataFrame:
    """Blocks of at most ``block_rows`` rows of one tile; a row's tile is a hash of its id. Vectors are bytes, in float32
    where that loses nothing."""
    src = _columns(df, row_id, key, text, image)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column("row_id").to_numpy(zero_copy_only=False), np.int64)
            (t, ht, _), (im, hi, _) = _dense(b.column("t")), _dense(b.column("i"))
            own = tile_of(ids, tiles)
            order = np.lexsort((ids, own))
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            for part in np.split(order, cuts):
                for lo in range(0, len(part), block_rows):
                    at = part[lo : lo + block_rows]
                    yield _tile_row(int(own[at[0]]), query, (ids[at], b.column("key").take(pa.array(at)).to_pylist(), t[at], ht[at], im[at], hi[at]))
    return src.mapInArrow(run, TILE_SCHEMA)


def unpack_tile(batch: pa.RecordBatch, j: int):
    """Row ``j`` of packed tiles -> (part, whether queries, block); a block as of :func:`unpack`."""
    return batch.column("part")[j].as_py(), batch.column("query")[j].as_py(), tile_block(batch, j)


def tile_block(batch: pa.RecordBatch, j: int, prefix: str = "") -> tuple:
    row = {name: batch.column(prefix + name)[j] for name in ("n", "wide", "t", "i", "has_t", "has_i", "keys", "ids")}
    n, kind = row["n"].as_py(), np.float64 if row["wide"].as_py() else np.float32
    t, im = (np.frombuffer(row[x].as_buffer(), kind).reshape(n, -1).astype(np.float64) if len(row[x].as_buffer()) else np.zeros((n, 0)) for x in ("t", "i"))
    ht, hi = (np.frombuffer(row[x].as_buffer(), bool) for x in ("has_t", "has_i"))
    keys = np.asarray(row["keys"].values.to_pylist(), dtype=object)
    return np.frombuffer(row["ids"].as_buffer(), np.int64), keys, t, ht, im, hi


def whole_tiles(tiles: DataFrame, most: int | None = None) -> DataFrame:
    """The blocks of a tile that follow each other as one row, or as rows of about ``most`` vectors."""
    def run(batches):
        held, own, n = [], None, 0
        for batch in batches:
            for j in range(batch.num_rows):
                now = batch.column("tile")[j].as_py(), batch.column("query")[j].as_py()
                if held and (now != own or (most and n >= most)):
                    yield _tile_row(*own, joined_blocks(held))
                    held, n = [], 0
                own = now
                held.append(tile_block(batch, j))
                n += len(held[-1][0])
        if held:
            yield _tile_row(*own, joined_blocks(held))
    return tiles.mapInArrow(run, TILE_SCHEMA)


def joined_blocks(blocks: list[tuple]) -> tuple:
    """Several blocks as one, by row id; a modality that a block lacks is absent from its rows."""
    if len(blocks) == 1:
        return blocks[0]

    def side(k: int) -> np.ndarray:
        d = max(b[k].shape[1] for b in blocks)
        if any(b[k].shape[1] not in (0, d) for b in blocks):
            raise ValueError("vectors of one modality must share one dimension (validate first)")
        return np.concatenate([b[k] if b[k].shape[1] == d else np.zeros((len(b[0]), d)) for b in blocks])[order]
    order = np.argsort(np.concatenate([b[0] for b in blocks]), kind="stable")
    flat = lambda k: np.concatenate([b[k] for b in blocks])[order]
    return flat(0), flat(1), side(2), flat(3), side(4), flat(5)


def prefixed(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(prefix + c) for c in blocks.columns])
