"""Exact top-k retrieval over fused vectors.

Plan shape
----------
1. A side whose size is checked to be under the broadcast bound is packed into
   blocks and broadcast, and the other side streams (no shuffle of the large
   side): an equi-join of blocks.
2. When neither side is bounded, rows are dealt to R query tiles and C catalog
   tiles by their id, and each pair of tiles is one task: the catalog tile is
   held, the query tile streams past it. Vectors travel in float32 where that
   loses nothing, queries C times and the catalog R times. Hits count in the
   choice of R and C, since C catalog tiles send k hits each per query and
   weight pair; many weights or a large k so lead to one catalog tile, if it
   fits a task.
3. In a task a query block is fused for every alpha and the catalog for one
   beta at a time (``slerp_np``); a running top-k per query and weight pair is
   kept over the products of chunks (``topk.running_topk``), so only k rows per
   query and weight pair leave a task, never all pairs.
   Where the hits of several weight pairs outweigh the vectors, the catalog streams instead: a task holds a query tile and its running
   top-k, and the catalog's blocks pass in the order of their ids, read from the one copy that a shuffle wrote (``stream_tiles``).
4. When the catalog spans several blocks or tiles, a ``row_number`` window keeps
   the final k per (query, alpha, beta); Spark runs it as a partial
   WindowGroupLimit before the exchange.

Ordering is score rounded to 9 digits descending, then item row id
ascending, so ties are resolved the same way by every plan.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecbench.functions.slerp import slerp_coefficients_np, slerp_np
from vecbench.functions.vectors import EPS
from vecbench.operators.blocks import joined_blocks, pack_blocks, pack_tiles, prefixed, tile_block, unpack, unpack_tile, whole_tiles
from vecbench.operators.topk import SCORE_DIGITS, Best, FourDot, FourProducts, Rough, _select_topk, more_topk, running_topk  # noqa: F401

HITS_SCHEMA = ("query_row bigint, alpha double, beta double, rank int, item_row bigint, "
               "score double, rel double")
HITS_KEYS_SCHEMA = HITS_SCHEMA + ", query_key string, item_key string"

# The default grid of the evaluation (weights of the second modality) and cut-offs.
DEFAULT_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
DEFAULT_KS = (1, 5, 10, 50)
#: Queries scored at a time, and gathered at a time before a catalog tile.
ROW_CHUNK = 256
QUERY_ROWS = 2048
#: Scores of a task, about (20 to 30 s); a further weight pair costs a third.
TASK_WORK = 4e9
#: Rows of the smaller side for each task, at most: the tasks grow in number with the rows, so a task's scores grow no faster than these.
TASK_ROWS = 4500
#: Bytes of a hit on its way to the final ranks, about; of a hit that a task holds.
HIT_BYTES = 48
HELD_BYTES = 32
#: Bytes of a catalog block that streams past a query tile, about.
STREAM_BYTES = 32 << 20


_TYPES = {"query_row": pa.int64(), "alpha": pa.float64(), "beta": pa.float64(), "rank": pa.int32(),
          "item_row": pa.int64(), "score": pa.float64(), "rel": pa.float64(),
          "query_key": pa.string(), "item_key": pa.string()}


def _batch(out: dict, names: list) -> pa.RecordBatch:
    cols = {}
    for n in names:
        v = np.concatenate(out[n])
        cols[n] = pa.array(v.tolist() if _TYPES[n] == pa.string() else v, _TYPES[n])
    return pa.RecordBatch.from_pydict(cols)


class _Search:
    """Top-k of a query block in a catalog block under every pair of weights. Blocks: row_ids, keys, T, has_t, I, has_i."""

    def __init__(self, alphas: Sequence[float], betas: Sequence[float], k: int, exclude_self: bool, keep_keys: bool,
                 relevant_only: bool = False, similarity: str = "ip", precision: str = "float64", method: str = "direct"):
        self.alphas, self.betas = [float(a) for a in alphas], [float(b) for b in betas]
        self.k, self.exclude_self, self.relevant_only, self.method = k, exclude_self, relevant_only, method
        self.cosine = similarity == "cosine"
        self.dtype = np.float32 if precision == "float32" else np.float64
        self.names = ["query_row", "alpha", "beta", "rank", "item_row", "score", "rel"] + (["query_key", "item_key"] if keep_keys else [])

    def _fused(self, block, weights) -> list[tuple[list[float], np.ndarray]]:
        """(weights, vectors): one entry a weight, or one for all where a modality is absent from the whole block."""
        _, _, t, ht, im, hi = block
        # a modality absent from the whole block: every row keeps the other one raw (F2)
        if im.shape[1] == 0 or t.shape[1] == 0:
            return [(list(weights), self._ready(t if im.shape[1] == 0 else im))]
        if t.shape[1] != im.shape[1]:
            raise ValueError("text and image vectors differ in dimension; adapt them first")
        return [([w], self._ready(slerp_np(t, im, w, has1=ht, has2=hi))) for w in weights]

    def _ready(self, v: np.ndarray) -> np.ndarray:
        if self.cosine:  # both sides divided by (norm + eps) before the dot
            v = v / (np.sqrt(np.einsum("ij,ij->i", v, v)) + EPS)[:, None]
        # fusion always runs in float64; only the products may run in float32
        return v.astype(self.dtype, copy=False)

    def __call__(self, q, c):
        """Record batches of hits."""
        codes: dict = {}
        qk, ck = (np.array([codes.setdefault(x, len(codes)) for x in side[1]], np.int64) for side in (q, c))
        for some, cells, finite, scores, rough in self.plans(q, c):
            best = running_topk(q[0][some], c[0], self.k, len(cells), scores, self.exclude_self, finite, rough)
            yield from self._hits(q, c, qk, ck, some, [(a, b, x) for own, x in zip(cells, best, strict=True) for a, b in own])

    def plans(self, q, c):
        """How to score slices of the queries: (slice, the weight pairs of each cell, whether all numbers are finite, scores, float32
        scores that sift, or None); see ``running_topk``."""
        if not len(q[0]) or not len(c[0]):
            return
        finite = all(np.isfinite(x).all() for x in (q[2], q[4], c[2], c[4]))
        widths = {x.shape[1] for x in (q[2], q[4], c[2], c[4])}
        alike = len(widths) == 1 and widths != {0}
        slices = [slice(lo, lo + ROW_CHUNK) for lo in range(0, len(q[0]), ROW_CHUNK)]
        four_dot = self.method == "four_dot" and alike
        # queries fused once per alpha (a query block is small); the catalog is fused for one beta at a
        # time, so a task holds the raw block plus a single fused copy whatever the grid size
        qf = self._fused(q, self.alphas)
        grid = [[(a, b)] for b in self.betas for a in self.alphas]
        four = self._four_rough(qf, q, c, FourDot if four_dot else FourProducts) if finite and alike and len(grid) > 4 else None
        if four:
            for some in slices:
                yield some, grid, finite, None, four(some)
            return
        if four_dot:
            scores = self._four_dot(q, c)
            for some in slices:
                yield some, grid, finite, scores(some), None
            return
        absent = c[4].shape[1] == 0 or c[2].shape[1] == 0
        for betas in [self.betas] if absent else [[b] for b in self.betas]:
            cf = self._fused(c, betas)[0][1]
            longest = float(np.sqrt(np.einsum("ij,ij->i", cf, cf).max()))
            # float32 products sift where that saves work and neither side leaves its range
            sift = self.dtype is np.float64 and finite and cf.shape[1] >= 8 and 1e-9 < longest < 1e9
            short = cf.astype(np.float32) if sift else None
            for some in slices:

                def scores(a, z, some=some, cf=cf):
                    for _, v in qf:
                        yield (v[some] @ cf[a:z].T).astype(np.float64, copy=False)
                own = [v[some] for _, v in qf]
                rough = Rough.of(own, cf, short, longest) if sift and max(np.abs(v).max() for v in own) < 1e9 else None
                yield some, [[(a, b) for a in ws for b in betas] for ws, _ in qf], finite, scores, rough

    def _four_rough(self, qf: list, q, c, kind):
        """Of a slice of the queries: float32 scores of all weight pairs by four products (``topk.FourProducts``). None if these
        would sift badly: other arithmetic asked for, numbers out of its range, or modalities that cancel out."""
        if self.cosine or self.dtype is not np.float64:
            return None
        raw, items = [q[2], q[4]], [c[2], c[4]]
        x = [slerp_coefficients_np(*raw, a, has1=q[3], has2=q[5]) for a in self.alphas]
        y = [slerp_coefficients_np(*items, b, has1=c[3], has2=c[5]) for b in self.betas]
        norms = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in items]
        longest = [float((abs(u1) * norms[0] + abs(u2) * norms[1]).max()) for u1, u2 in y]
        most = max(abs(v).max() for v in [*raw, *items, *(v for _, v in qf), *(u for pair in x + y for u in pair)])
        if not (most < 1e9 and all(1e-9 < z < 16 * max(1.0, *(n.max() for n in norms)) for z in longest)):
            return None
        short = [v.astype(np.float32) for v in items]
        return lambda some: kind([v[some] for _, v in qf], [v[some] for v in raw], [(u1[some], u2[some]) for u1, u2 in x],
                                 items, short, y, longest)

    def _four_dot(self, q, c):
        """Fused vectors are linear in the raw modalities (q = u1 t + u2 i), so
        four products t.t', t.i', i.t', i.i' serve every (alpha, beta)."""
        _, _, qt, qht, qi, qhi = q
        _, _, ct, cht, ci, chi = c
        qc = {a: slerp_coefficients_np(qt, qi, a, has1=qht, has2=qhi) for a in self.alphas}
        cc = {b: slerp_coefficients_np(ct, ci, b, has1=cht, has2=chi) for b in self.betas}
        cT, cI = ct.astype(self.dtype, copy=False), ci.astype(self.dtype, copy=False)

        def norms(u, t, i):
            tt, ii, ti = (np.einsum("ij,ij->i", x, y) for x, y in ((t, t), (i, i), (t, i)))
            return np.sqrt(np.maximum(0.0, u[0] * u[0] * tt + u[1] * u[1] * ii + 2 * u[0] * u[1] * ti)) + EPS
        qn = {a: norms(u, qt, qi) for a, u in qc.items()} if self.cosine else {}
        cn = {b: norms(u, ct, ci) for b, u in cc.items()} if self.cosine else {}

        def of(some):
            Qt, Qi = qt[some].astype(self.dtype, copy=False), qi[some].astype(self.dtype, copy=False)

            def scores(x, z):
                TT, TI = (Qt @ cT[x:z].T).astype(np.float64), (Qt @ cI[x:z].T).astype(np.float64)
                IT, II = (Qi @ cT[x:z].T).astype(np.float64), (Qi @ cI[x:z].T).astype(np.float64)
                for b in self.betas:
                    y1, y2 = cc[b][0][None, x:z], cc[b][1][None, x:z]
                    A, B = TT * y1 + TI * y2, IT * y1 + II * y2
                    for a in self.alphas:
                        S = qc[a][0][some, None] * A + qc[a][1][some, None] * B
                        yield S / (qn[a][some, None] * cn[b][None, x:z]) if self.cosine else S
            return scores
        return of

    def _hits(self, q, c, qk, ck, some: slice, cells):
        out = {n: [] for n in self.names}
        for a, b, best in cells:
            r, place = best.found()
            at = best.item[r, place]
            rel = qk[some][r] == ck[at]
            if self.relevant_only:
                r, place, at, rel = r[rel], place[rel], at[rel], rel[rel]
            new = {"query_row": q[0][some][r], "alpha": np.full(len(r), a), "beta": np.full(len(r), b), "rank": place + 1, "item_row": c[0][at],
                   "score": best.score[r, place], "rel": rel.astype(np.float64)}
            if "query_key" in out:
                new |= {"query_key": q[1][some][r], "item_key": c[1][at]}
            for n, x in new.items():
                out[n].append(x)
        yield _batch(out, self.names)


def _pair_search(search: _Search):
    """Rows that pair a query block with a catalog block; the catalog blocks that follow each other for a query block are searched as one."""
    def run(batches):
        cur, q, held, last, cat = None, None, [], None, None

        def searched():
            nonlocal last, cat
            names = [n for n, _ in held]
            if names != last:
                last, cat = names, joined_blocks([b for _, b in held])
            yield from search(q, cat)
        for batch in batches:
            for j in range(batch.num_rows):
                blk = batch.column("q_blk")[j].as_py()
                if blk != cur:
                    if held:
                        yield from searched()
                    cur, q, held = blk, unpack(batch, j, "q_"), []
                held.append((batch.column("c_blk")[j].as_py(), unpack(batch, j, "c_")))
        if held:
            yield from searched()
    return run


def _tile_search(search: _Search):
    """Rows of one pair of tiles after another, the catalog's blocks first: the catalog tile is held, queries stream."""
    def run(batches):
        part, blocks, cat, queries, n = None, [], None, [], 0
        for batch in batches:
            for j in range(batch.num_rows):
                own, is_query, block = unpack_tile(batch, j)
                full = n >= QUERY_ROWS
                if queries and (full or own != part):
                    yield from search(joined_blocks(queries), cat)
                    queries, n = [], 0
                if own != part:
                    part, blocks, cat = own, [], None
                if not is_query:
                    blocks.append(block)
                    continue
                if cat is None and blocks:
                    cat, blocks = joined_blocks(blocks), []
                if cat is not None:
                    queries.append(block)
                    n += len(block[0])
        if queries:
            yield from search(joined_blocks(queries), cat)
    return run


class _Stream:
    """The best items of a tile of queries in a catalog that comes block by block: k items a query and weight pair are held, no more."""

    def __init__(self, search: _Search, q):
        self.search, self.q, self.best = search, q, {}
        codes: dict = {}
        self.qk, self.codes = np.array([codes.setdefault(x, len(codes)) for x in q[1]], np.int64), codes
        self.last, self.widths = None, {2: q[2].shape[1], 4: q[4].shape[1]}

    def _held(self, some: slice, cells: list) -> list[list[Best]]:
        """The running top-k that each cell adds to: one for all of its weight pairs, if they were in one cell so far."""
        mine = {p: self.best.get((some.start, p)) for own in cells for p in own}
        out = []
        for own in cells:
            found: dict = {}
            for p in own:
                found.setdefault(id(mine[p]), []).append(p)
            held = []
            for pairs in found.values():
                b = mine[pairs[0]]
                if b is None:
                    b = Best(len(self.q[0][some]), self.search.k)
                elif any(x is b for p, x in mine.items() if p not in pairs):
                    b = copy.deepcopy(b)  # pairs that were in one cell are in several now
                held.append(b)
                for p in pairs:
                    self.best[some.start, p] = b
            out.append(held)
        return out

    def add(self, c) -> None:
        for m in self.widths:
            if self.widths[m] and c[m].shape[1] and c[m].shape[1] != self.widths[m]:
                raise ValueError("vectors of one modality must share one dimension (validate first)")
            self.widths[m] = self.widths[m] or c[m].shape[1]
        s, ids = self.search, c[0]
        ck = np.array([self.codes.get(x, -1) for x in c[1]], np.int64)
        later = self.last is not None and ids[0] >= self.last
        self.last = max(ids[-1], ids[-1] if self.last is None else self.last)
        for some, cells, finite, scores, rough in s.plans(self.q, c):
            own, qk, held = self.q[0][some], self.qk[some], self._held(some, cells)

            def rel(r, at, qk=qk):
                return (qk[r] == ck[at]).astype(np.float64)
            if rough is not None and all(len(h) == 1 and np.isfinite(h[0].rounded[:, -1]).all() for h in held):
                more_topk(own, ids, [h[0] for h in held], s.exclude_self, rough, later, rel)
                continue
            for found, into in zip(running_topk(own, ids, s.k, len(cells), scores, s.exclude_self, finite, rough), held, strict=True):
                r, place = found.found()
                at = found.item[r, place]
                for b in into:
                    b.merge(r, found.score[r, place], ids[at], rel(r, at))

    def hits(self):
        """Record batches of hits; rows of one query id share one ranking."""
        s = self.search
        slices = sorted({lo for lo, _ in self.best})
        for a in s.alphas:
            for b in s.betas:
                out = []
                for lo in slices:
                    x = self.best[lo, (a, b)]
                    r, place = x.found()
                    out.append((self.q[0][lo : lo + ROW_CHUNK][r], x.rounded[r, place], x.item[r, place], x.score[r, place], x.extra[r, place]))
                query, rounded, item, score, rel = (np.concatenate(v) for v in zip(*out, strict=True))
                order = np.lexsort((item, -rounded, query))
                query, item, score, rel = (v[order] for v in (query, item, score, rel))
                first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.empty(0, bool)
                place = np.arange(len(query))
                rank = place - np.maximum.accumulate(np.where(first, place, 0)) + 1
                keep = rank <= s.k
                if s.relevant_only:
                    keep &= rel > 0
                new = {"query_row": query, "alpha": np.full(len(query), a), "beta": np.full(len(query), b), "rank": rank, "item_row": item, "score": score,
                       "rel": rel}
                yield _batch({n: [v[keep]] for n, v in new.items()}, s.names)


def _stream_search(search: _Search):
    """Rows of catalog blocks, each with the query tile of the task: the tile and its best items so far are held, the blocks stream."""
    def run(batches):
        streams: dict[int, _Stream] = {}
        for batch in batches:
            for j in range(batch.num_rows):
                tile = batch.column("q_tile")[j].as_py()
                if tile not in streams:
                    streams[tile] = _Stream(search, tile_block(batch, j, "q_"))
                streams[tile].add(tile_block(batch, j, "c_"))
        for stream in streams.values():
            yield from stream.hits()
    return run


def table_stats(df: DataFrame, cols: Sequence[str | None]) -> tuple[int, int]:
    """(row count, summed largest vector width of the given columns), exact, in one aggregate."""
    present = [c for c in cols if c]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.size(c)).alias(f"w{i}") for i, c in enumerate(present)]).first()
    return row["n"], int(sum(max(row[f"w{i}"] or 0, 0) for i in range(len(present))))


def broadcast_limit_bytes(spark) -> int:
    """The broadcast bound: the session's autoBroadcastJoinThreshold as Spark parses it; 0 when off."""
    return max(0, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))


def tiling(q_bytes: int, c_bytes: int, tasks: int, partition_bytes: int = 128 << 20) -> tuple[int, int]:
    """(query tiles R, catalog tiles C) with R * C >= p pairs of tiles and the least data moved.

    Queries are copied C times and the catalog R times; q * C + c * R is least at
    C = sqrt(p * c / q), so sides of equal size are copied sqrt(p) times each and a
    much larger side is not copied at all.
    """
    p = max(tasks, math.ceil((q_bytes + c_bytes) / partition_bytes), 1)
    r = min(p, max(1, round(math.sqrt(p * q_bytes / max(c_bytes, 1)))))
    return r, math.ceil(p / r)


def pair_blocks(qb: DataFrame, cb: DataFrame, q_bytes: int, c_bytes: int, limit: int, tasks: int,
                partition_bytes: int = 128 << 20) -> DataFrame:
    """Every query block with every catalog block, as an equi-join.

    A side whose size is within ``limit`` is broadcast and the other stays where it lies.
    Otherwise the pairs form a grid of R x C tiles (see :func:`tiling`): a block belongs to one
    tile of its side and meets each tile of the other side once.
    """
    if min(q_bytes, c_bytes) <= limit:
        q, c = (side.withColumn("_p", F.pmod(f"{x}_blk", F.lit(1))) for side, x in ((qb, "q"), (cb, "c")))
        return q.join(F.broadcast(c), "_p") if c_bytes <= limit else c.join(F.broadcast(q), "_p")
    r, n = tiling(q_bytes, c_bytes, tasks, partition_bytes)
    own = lambda x, k: F.pmod(F.xxhash64(f"{x}_blk"), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = qb.withColumn("_j", each(n)).withColumn("_p", own("q", r) * n + F.col("_j")).drop("_j")
    c = cb.withColumn("_i", each(r)).withColumn("_p", F.col("_i") * n + own("c", n)).drop("_i")
    return q.join(c, "_p")


def tile_grid(q_bytes: int, c_bytes: int, hit_bytes: int, tasks: int, partition_bytes: int = 128 << 20, work: float = 0,
              rows: int = 0) -> tuple[int, int]:
    """(query tiles R, catalog tiles C) with about ``tasks`` pairs (half of them if C is 1, so that the catalog is copied
    less), none larger than ``partition_bytes`` a side or with more than ``TASK_WORK`` of the ``work``, about, a pair at least for
    ``TASK_ROWS`` of the ``rows`` of the smaller side, and the least data moved: queries and their hits C times, the catalog R times."""
    r_min, c_min = (max(1, math.ceil(x / partition_bytes)) for x in (q_bytes, c_bytes))
    need = max(math.ceil(work / TASK_WORK), math.ceil(rows / TASK_ROWS))
    p = max(tasks, r_min * c_min, need)
    c = min(p, max(c_min, round(math.sqrt(p * c_bytes / max(q_bytes + hit_bytes, 1)))))
    return max(r_min, math.ceil((p if c > 1 else max(tasks / 2, need)) / c)), c


def stream_grid(nq: int, nc: int, q_bytes: int, hit_bytes: int, pairs: int, k: int, target: tuple[int, int] | None, tasks: int,
                partition_bytes: int) -> tuple[int, int]:
    """(query tiles R, catalog tiles C) of a search that streams the catalog, with about TASK_WORK scores a task: one catalog tile, or,
    for a ``target`` of R x C tiles, these, or two catalog tiles if the work needs more tasks. Each further one sends all hits again."""
    held = nq * pairs * k * HELD_BYTES + q_bytes
    need = max(math.ceil(nq * nc * (1 + pairs / 3) / TASK_WORK), math.ceil(min(nq, nc) / TASK_ROWS), math.ceil(held / partition_bytes))
    if not target:
        return min(nq, max(tasks, need)), 1
    r, c = target
    if r * c >= need:
        return r, c
    c = min(c, 2)
    return math.ceil(need / c), c


def stream_tiles(queries: DataFrame, items: DataFrame, r: int, n: int, nc: int, width: int, q_block_rows: int, c_block_rows: int, *,
                 row_id: str, **cols: str | None) -> DataFrame:
    """Every query tile with every block of a catalog tile, a task each pair of tiles. Both sides are written once by a shuffle,
    each row in one place, and read as often as there are tiles of the other side: no copy is written. The catalog's blocks
    are ranges of row ids, in their order."""
    qt = whole_tiles(pack_tiles(queries, q_block_rows, r, query=True, row_id=row_id, **cols).repartitionById(r, "tile"))
    rows = max(1, STREAM_BYTES // (width * 8))
    p = max(n, math.ceil(nc / rows))
    by_id = items.repartitionByRange(p, F.col(row_id).cast("bigint")).sortWithinPartitions(F.col(row_id).cast("bigint"))
    ct = whole_tiles(pack_tiles(by_id, c_block_rows, 1, query=False, row_id=row_id, **cols), rows)
    ct = ct.withColumn("tile", F.spark_partition_id()).repartitionById(p, "tile").coalesce(n)
    return prefixed(ct, "c_").hint("shuffle_replicate_nl").crossJoin(prefixed(qt, "q_"))


def grid_search(queries: DataFrame, items: DataFrame, k: int = max(DEFAULT_KS), *,
                alphas: Sequence[float] = DEFAULT_WEIGHTS, betas: Sequence[float] = DEFAULT_WEIGHTS,
                key: str | None = "id", row_id: str = "row_id",
                text: str = "text_embedding", image: str | None = "image_embedding",
                exclude_self: bool = False, q_block_rows: int | None = None,
                c_block_rows: int | None = None, broadcast_bytes: int | None = None,
                target_tasks: int | None = None, keep_keys: bool = False,
                relevant_only: bool = False, stats: dict | None = None,
                partition_bytes: int = 128 << 20, similarity: str = "ip",
                precision: str = "float64", method: str = "direct") -> DataFrame:
    """top-``k`` catalog items for every query and every (alpha, beta).

    ``alpha`` fuses the query's two modalities, ``beta`` the catalog's
    (F3, F1 rule). With ``image=None`` the plain ``text`` vectors are
    searched (F6). ``exclude_self`` drops the pair of a row with itself
    (leave-one-out when queries and catalog are one table).

    Returns ``query_row, alpha, beta, rank, item_row, score, rel`` where
    ``rel`` = 1.0 when the query's key equals the item's key (binary id
    relevance), plus ``query_key, item_key`` when ``keep_keys``.
    ``similarity``: ``ip`` (inner product of the fused vectors, the engine's
    flat index) or ``cosine`` (both normalised with the same epsilon first).
    ``precision="float32"`` runs the products in float32 (half the block
    memory, about twice the BLAS speed, scores good to about 1e-7); the
    default float64 gives scores identical to a double-precision reference.
    ``method``, one for the whole call: ``direct`` fuses vectors and multiplies
    per (alpha, beta); ``four_dot`` multiplies the raw modalities four times and
    combines the products per cell (fewer flops for wide vectors and large
    grids; blocks without both modalities are fused).
    ``relevant_only`` keeps only rows with ``rel = 1`` (ranks stay the ranks
    among all items); with one catalog block the filter runs inside the
    Arrow task, otherwise after the final rank window. Pass
    ``stats`` (a dict) to receive the row counts used for sizing.
    """
    spark = queries.sparkSession
    schema = HITS_KEYS_SCHEMA if keep_keys else HITS_SCHEMA
    nc, width = table_stats(items, [text, image])
    nq = nc if queries is items else queries.count()
    if stats is not None:
        stats.update(n_queries=nq, n_items=nc)
    if nq == 0 or nc == 0:
        return spark.createDataFrame([], schema)
    limit = broadcast_limit_bytes(spark) if broadcast_bytes is None else broadcast_bytes
    width = max(width, 1)
    # blocks are sized in bytes of raw vectors (both modalities): about 64 MB per
    # catalog block and 8 MB per query block, within fixed row bounds
    if c_block_rows is None:
        c_block_rows = int(min(8192, max(512, (64 << 20) // (width * 8))))
    if q_block_rows is None:
        q_block_rows = int(min(1024, max(128, (8 << 20) // (width * 8))))
    c_bytes = nc * (width * 8 + 64)
    q_bytes = nq * (width * 8 + 64)
    tasks = target_tasks or spark.sparkContext.defaultParallelism * 2

    # A catalog of one block is gathered (the rank in its block is then the final rank).
    single_catalog_block = nc <= c_block_rows
    args = (alphas, betas, k, exclude_self, keep_keys)
    if min(q_bytes, c_bytes) <= limit:
        # Blocks are packed where their rows lie, with the upstream's parallelism.
        cat = items.repartition(1) if single_catalog_block else items
        # a query side within the broadcast bound is cheap to move and is spread evenly
        qry, qrows = queries, min(q_block_rows, nq)
        if q_bytes <= limit:
            want_q = max(1, min(tasks, nq)) if c_bytes <= limit else max(1, math.ceil(nq / q_block_rows))
            qry, qrows = queries.repartition(want_q, row_id), min(q_block_rows, max(1, math.ceil(nq / want_q)))
        qb = prefixed(pack_blocks(qry, qrows, row_id=row_id, key=key, text=text, image=image), "q_")
        cb = prefixed(pack_blocks(cat, c_block_rows, row_id=row_id, key=key, text=text, image=image), "c_")
        final = single_catalog_block
        pairs, run = pair_blocks(qb, cb, q_bytes, c_bytes, limit, tasks, partition_bytes), _pair_search
    else:
        hit_bytes = nq * k * len(alphas) * len(betas) * HIT_BYTES
        cols = dict(row_id=row_id, key=key, text=text, image=image)
        # Hits that outweigh the vectors are not sent once a catalog tile, nor is the catalog copied so that there are few tiles.
        if len(alphas) * len(betas) > 1 and hit_bytes > q_bytes + c_bytes and not keep_keys:
            target = tiling(q_bytes, c_bytes, target_tasks, partition_bytes) if target_tasks and not single_catalog_block else None
            r, n = stream_grid(nq, nc, q_bytes, hit_bytes, len(alphas) * len(betas), k, target, tasks, partition_bytes)
            final = n == 1
            pairs, run = stream_tiles(queries, items, r, n, nc, width, q_block_rows, c_block_rows, **cols), _stream_search
            return _ranked(pairs, run(_Search(*args, relevant_only and final, similarity, precision, method)), schema, final, k, relevant_only)
        r, n = (tiling(q_bytes, c_bytes, target_tasks, partition_bytes) if target_tasks else
                tile_grid(q_bytes, c_bytes, hit_bytes, tasks, partition_bytes, nq * nc * (1 + len(alphas) * len(betas) / 3), min(nq, nc)))
        if single_catalog_block:
            r, n = max(1, r * n), 1
        # With one catalog tile a task sees all items: its ranks are final, unless a query id repeats (its rows share one ranking).
        final = single_catalog_block or (n == 1 and queries.groupBy(row_id).count().where("count > 1").isEmpty())
        qt = pack_tiles(queries, q_block_rows, r, query=True, **cols).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
            .withColumn("part", (F.col("tile") * n + F.col("_j")).cast("int")).drop("_j", "tile")
        ct = pack_tiles(items, c_block_rows, n, query=False, **cols).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))) \
            .withColumn("part", (F.col("_j") * n + F.col("tile")).cast("int")).drop("_j", "tile")
        pairs, run = ct.unionByName(qt).repartitionById(r * n, "part").sortWithinPartitions("part", "query"), _tile_search

    return _ranked(pairs, run(_Search(*args, relevant_only and final, similarity, precision, method)), schema, final, k, relevant_only)


def _ranked(pairs: DataFrame, run, schema: str, final: bool, k: int, relevant_only: bool) -> DataFrame:
    """The hits of all tasks; their ranks are merged, unless they are ``final``."""
    hits = pairs.mapInArrow(run, schema)
    if final:
        return hits
    w = Window.partitionBy("query_row", "alpha", "beta").orderBy(
        F.round("score", SCORE_DIGITS).desc(), F.col("item_row").asc())
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.where(F.col("rel") > 0) if relevant_only else ranked


def topk_search(queries: DataFrame, items: DataFrame, k: int = 10, *, vector: str = "embedding",
                key: str | None = None, row_id: str = "row_id", exclude_self: bool = False,
                **kw) -> DataFrame:
    """Exact inner-product top-k of one vector column (flat search)."""
    hits = grid_search(queries, items, k, alphas=(0.0,), betas=(0.0,), key=key, row_id=row_id,
                       text=vector, image=None, exclude_self=exclude_self, **kw)
    return hits.drop("alpha", "beta") if key else hits.drop("alpha", "beta", "rel")


def retrieve_top_k(query: DataFrame, items: DataFrame, alpha: float, beta: float, k: int = 50,
                   similarity: str = "cosine", **kw) -> DataFrame:
    """top-``k`` items for the given query row(s) at one (alpha, beta), best first,
    by cosine of the fused vectors (F4) unless ``similarity="ip"``.

    The fused catalog is derived inside the search (never stored per call);
    the result is ordered by rank, so ``.collect()`` gives the ranked list.
    """
    h = grid_search(query, items, k, alphas=(alpha,), betas=(beta,), similarity=similarity, **kw)
    return h.orderBy("query_row", "rank")
