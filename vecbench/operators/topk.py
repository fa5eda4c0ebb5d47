"""Best items of a block of queries: selection in one score matrix, and running over many."""

from __future__ import annotations

import numpy as np

SCORE_DIGITS = 9
#: Items scored at a time, and at first in a run, at least.
ITEM_CHUNK = 2048
FIRST_ITEMS = 256
#: Items scored at a time in float32 (the matrices of about a hundred queries stay in a core's cache), and pairs scored exactly at a time.
SIFT_BITS = 10
SIFT_CHUNK = 1 << SIFT_BITS
PAIR_CHUNK = 1024
#: One comparison serves all alphas of a beta where it leaves one pair in FEW at most; if not, it is left out in so many further chunks.
FEW = 24
SKIPPED = 15
#: Stands for a coefficient of 0 in every row.
NONE = object()


def _select_topk(S: np.ndarray, k: int):
    """Rows/cols of the top ``k`` per row of S (ties -> lower column first), with ranks."""
    nq, nc = S.shape
    Sr = np.round(S, SCORE_DIGITS)
    if k >= nc:
        keep = np.ones_like(Sr, dtype=bool)
    else:
        kth = -np.partition(-Sr, k - 1, axis=1)[:, k - 1]
        gt = Sr > kth[:, None]
        eq = Sr == kth[:, None]
        need = k - gt.sum(axis=1)
        keep = gt | (eq & (np.cumsum(eq, axis=1) <= need[:, None]))
    keep &= np.isfinite(S)
    rows, cols = np.nonzero(keep)
    order = np.lexsort((cols, -Sr[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    counts = np.bincount(rows, minlength=nq)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    rank = np.arange(len(rows)) - np.repeat(starts, counts) + 1
    return rows, cols, rank


class Best:
    """Running top-k of a set of queries: by score rounded to SCORE_DIGITS, then item id; ``extra`` goes along."""

    def __init__(self, n: int, k: int):
        self.rounded = np.full((n, k), -np.inf)
        self.score = np.full((n, k), -np.inf)
        self.item = np.full((n, k), np.iinfo(np.int64).max)
        self.extra = np.zeros((n, k))

    def add(self, rows: np.ndarray, s: np.ndarray, items: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Scores (and extras) of ``rows`` (distinct) x ``items`` (ascending ids); -inf is no candidate."""
        k = self.score.shape[1]
        floor = self.rounded[rows, -1]
        hit = s >= (floor - 10.0**-SCORE_DIGITS)[:, None]
        if np.isneginf(floor).any():
            r, c, _ = _select_topk(s, k)
            keep = hit[r, c]
            r, c = r[keep], c[keep]
        else:
            r, c = np.nonzero(hit)
        self.merge(rows[r], s[r, c], items[c], extra[r, c] if extra is not None else None)

    def merge(self, rows: np.ndarray, score: np.ndarray, items: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Single candidates: the score of an item for a row."""
        if not len(rows):
            return
        k = self.score.shape[1]
        target, local = np.unique(rows, return_inverse=True)
        new = {"score": score, "rounded": np.round(score, SCORE_DIGITS), "item": items, "extra": extra if extra is not None else np.zeros(len(rows))}
        both = {n: np.concatenate([getattr(self, n)[target].ravel(), x]) for n, x in new.items()}
        row = np.concatenate([np.repeat(np.arange(len(target)), k), local])
        order = np.lexsort((both["item"], -both["rounded"], row))
        count = np.bincount(row, minlength=len(target))
        take = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
        for n, x in both.items():
            getattr(self, n)[target] = x[take]

    def append(self, rows: np.ndarray, score: np.ndarray, items: np.ndarray, extra: np.ndarray | None = None) -> None:
        """As :meth:`merge`, where the items of a row ascend and none is below those held: ties stay in their order."""
        if not len(rows):
            return
        n, k = self.score.shape
        count = np.bincount(rows, minlength=n)
        wide = int(count.max(initial=0))
        if n * wide > 16 * (len(rows) + n):  # few rows have most of the candidates
            self.merge(rows, score, items, extra)
            return
        order = np.argsort(rows.astype(np.min_scalar_type(n)), kind="stable")
        at = (rows[order], k + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count))
        new = {"rounded": np.round(score, SCORE_DIGITS), "score": score, "item": items, "extra": extra if extra is not None else np.zeros(len(rows))}
        take = None
        for name, x in new.items():
            own = getattr(self, name)
            both = np.full((n, k + wide), -np.inf if name == "rounded" else 0, own.dtype)
            both[:, :k] = own
            both[at] = x[order]
            take = np.argsort(-both, axis=1, kind="stable")[:, :k] if take is None else take
            own[:] = np.take_along_axis(both, take, axis=1)

    def fill(self, rows: np.ndarray, score: np.ndarray, items: np.ndarray) -> None:
        """As :meth:`merge`, where nothing is held yet and the items of a row ascend."""
        k, rounded = self.score.shape[1], np.round(score, SCORE_DIGITS)
        order = np.argsort(-rounded, kind="stable")
        order = order[np.argsort(rows[order].astype(np.min_scalar_type(len(self.score))), kind="stable")]
        rows, score, rounded, items = rows[order], score[order], rounded[order], items[order]
        count = np.bincount(rows, minlength=len(self.score))
        place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        top = place < k
        at = (rows[top], place[top])
        self.score[at], self.rounded[at], self.item[at] = score[top], rounded[top], items[top]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.isfinite(self.score))


def mask_self(s: np.ndarray, query_ids: np.ndarray, items: np.ndarray) -> None:
    """-inf where a row meets itself; ``items`` ascend."""
    a, b = np.searchsorted(items, query_ids, "left"), np.searchsorted(items, query_ids, "right")
    for j in range(int((b - a).max(initial=0))):  # once, if row ids are distinct
        rows = np.flatnonzero(a + j < b)
        s[rows, a[rows] + j] = -np.inf


def _floor(best: Best) -> np.ndarray:
    """Scores that an item with a larger id must exceed: they round to more than the k-th best."""
    kth = best.rounded[:, -1]
    with np.errstate(invalid="ignore"):
        return np.where(np.abs(kth) < 1e4, kth + 0.4 * 10.0**-SCORE_DIGITS, kth)[:, None]


def _level(best: Best) -> np.ndarray:
    """Scores that an item with any id must exceed: what rounds to the k-th best does."""
    kth = best.rounded[:, -1:]
    return np.minimum(kth - 10.0**-SCORE_DIGITS, np.nextafter(kth, -np.inf))


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def _dots(a: np.ndarray, row: np.ndarray, right, item: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, some pairs at a time; ``right(item)``: the item vectors."""
    out = np.empty(len(row))
    for lo in range(0, len(row), PAIR_CHUNK):
        at = slice(lo, lo + PAIR_CHUNK)
        out[at] = np.einsum("ij,ij->i", a.take(row[at], axis=0), right(item[at]))
    return out


class Rough:
    """Float32 scores that only sift: times ``scale`` they are by at most ``slack`` off the exact ones (both a column, one a query,
    for each cell); here one product a cell. ``allowed(row, item)``: whether a pair counts; None: every pair does."""

    allowed = None

    def __init__(self, left: list[np.ndarray], right: np.ndarray, right32: np.ndarray, longest: float):
        d = right.shape[1]
        self.slack = [_norms(v)[:, None] * longest * (d + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS for v in left]
        self.left, self.right, self.right32 = left, right, right32
        self.left32 = [v.astype(np.float32) for v in left]
        self.scale = [np.ones((len(v), 1)) for v in left]

    @classmethod
    def of(cls, left: list[np.ndarray], right: np.ndarray, right32: np.ndarray, longest: float) -> Rough:
        """``longest``: the largest norm in ``right``. The bound of the error of a float32 product of d elements, twice."""
        return cls(left, right, right32, longest)

    def scores(self, a: int, z: int):
        """The float32 scores of the items from ``a`` to ``z``, a matrix a cell; one may be overwritten by the next."""
        for v in self.left32:
            yield v @ self.right32[a:z].T

    def above(self, a: int, z: int, floors: list[np.ndarray]):
        """Of those, (query, float32 score, place from ``a`` on) of the scores above the floors (a column each), a cell each."""
        for s, floor in zip(self.scores(a, z), floors, strict=True):
            yield _above(s, floor)

    def exact(self, cell: int, a: int, z: int) -> np.ndarray:
        return self.left[cell] @ self.right[a:z].T

    def of_pairs(self, cell: int, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        return _dots(self.left[cell], row, self.right.__getitem__, item)


class FourProducts(Rough):
    """Fused vectors are linear in the raw modalities: four float32 products serve all pairs of weights, ``alphas`` in turn for
    each of ``betas``. ``left``: fused queries, an alpha each; ``x``, ``y``: coefficients of both modalities, a weight each."""

    def __init__(self, left: list[np.ndarray], q: list[np.ndarray], x: list[tuple], c: list[np.ndarray], c32: list[np.ndarray],
                 y: list[tuple], longest: list[float]):
        """``longest``: the largest |y1| |t| + |y2| |i| of the items, a beta each."""
        d = c[0].shape[1]
        reach = [abs(u1) * _norms(q[0]) + abs(u2) * _norms(q[1]) for u1, u2 in x]
        self.slack = [r[:, None] * most * (d + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS for most in longest for r in reach]
        self.left, self.c, self.c32, self.y = left, c, c32, y
        self.q32 = [v.astype(np.float32) for v in q]
        self.y32 = [tuple(u.astype(np.float32) if u.any() else None for u in pair) for pair in y]
        # a score is divided by the first modality's coefficient where that saves work: its order does not change
        self.x32, scale = [], []
        for u1, u2 in x:
            by = u1 if u1.min() > 1e-9 else u2 if u2.min() > 1e-9 and not u1.any() else np.ones(len(u1))
            self.x32.append(tuple(None if (u == by).all() else (u / by).astype(np.float32)[:, None] if u.any() else NONE for u in (u1, u2)))
            scale.append(by[:, None])
        self.scale = scale * len(y)
        one, none = (np.full((len(q[0]), 1), x, np.float32) for x in (1, 0))
        self.factors = [tuple(none if u is NONE else one if u is None else u for u in pair) for pair in self.x32]
        self.reach = [abs(u1) + abs(u2) for u1, u2 in self.factors]
        self.signed = [any((pair[m] < 0).any() for pair in self.factors) for m in (0, 1)]
        self.plain = [0] * len(y)

    def _mixed(self, a: int, z: int):
        """For each of the betas, the products of both modalities of the queries with the items, and two matrices to write to."""
        tt, ti, it, ii = (v @ w[a:z].T for v in self.q32 for w in self.c32)
        s, other, left, right = (np.empty_like(tt) for _ in range(4))

        def items_mixed(out, m1, u1, m2, u2):
            if u2 is None:
                return np.multiply(m1, u1[None, a:z], out=out)
            if u1 is None:
                return np.multiply(m2, u2[None, a:z], out=out)
            np.multiply(m1, u1[None, a:z], out=out)
            np.multiply(m2, u2[None, a:z], out=other)
            return np.add(out, other, out=out)

        for y1, y2 in self.y32:
            items_mixed(left, tt, y1, ti, y2)
            items_mixed(right, it, y1, ii, y2)
            yield left, right, s, other

    def _cells(self, left: np.ndarray, right: np.ndarray, s: np.ndarray, other: np.ndarray):
        def times(m, u, out):
            return m if u is None else np.multiply(m, u, out=out)
        for u1, u2 in self.x32:
            if u2 is NONE or u1 is NONE:
                yield times(*((left, u1) if u2 is NONE else (right, u2)), s)
            else:
                yield np.add(times(left, u1, s), times(right, u2, other), out=s)

    def scores(self, a: int, z: int):
        for mixed in self._mixed(a, z):
            yield from self._cells(*mixed)

    def above(self, a: int, z: int, floors: list[np.ndarray]):
        """A score u1 l + u2 r is at most (abs(u1) + abs(u2)) max(abs(l), abs(r)): one comparison leaves few pairs for all alphas of
        a beta. Where it leaves many, every score is compared, here and in the next chunks."""
        n = len(self.x32)
        for beta, mixed in enumerate(self._mixed(a, z)):
            own, at = floors[beta * n : (beta + 1) * n], None
            if self.plain[beta]:
                self.plain[beta] -= 1
            else:
                least = np.minimum.reduce([f / u for f, u in zip(own, self.reach, strict=True)]) * np.float32(1 - 1e-5)
                if least.min() > 0:
                    left, right, s, other = mixed
                    most = [np.abs(m, out=out) if signed else m for m, out, signed in zip((left, right), (s, other), self.signed, strict=True)]
                    at = _true(np.maximum(*most, out=s) > least)
                if at is None or len(at) * FEW > s.size:
                    self.plain[beta], at = SKIPPED, None
            if at is None:
                for s, floor in zip(self._cells(*mixed), own, strict=True):
                    yield _above(s, floor)
                continue
            r, c = _places(at, z - a)
            x1, x2 = left.reshape(-1)[at], right.reshape(-1)[at]
            for (u1, u2), floor in zip(self.factors, own, strict=True):
                v = x1 * u1[r, 0] + x2 * u2[r, 0]
                more = np.flatnonzero(v > floor[r, 0])
                yield r[more], v[more], c[more]

    def _items(self, beta: int, at) -> np.ndarray:
        (u1, u2), (t, i) = self.y[beta], self.c
        out = t[at] * u1[at, None]
        out += i[at] * u2[at, None]
        return out

    def exact(self, cell: int, a: int, z: int) -> np.ndarray:
        beta, alpha = divmod(cell, len(self.left))
        return self.left[alpha] @ self._items(beta, slice(a, z)).T

    def of_pairs(self, cell: int, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        beta, alpha = divmod(cell, len(self.left))
        return _dots(self.left[alpha], row, lambda at: self._items(beta, at), item)


class FourDot(FourProducts):
    """As its base, and the exact scores are combined from four float64 products too."""

    def __init__(self, left: list[np.ndarray], q: list[np.ndarray], x: list[tuple], *args):
        super().__init__(left, q, x, *args)
        self.q, self.x = q, x

    def _combined(self, cell: int, products: list[np.ndarray], row, item) -> np.ndarray:
        beta, alpha = divmod(cell, len(self.x))
        (u1, u2), (y1, y2) = self.x[alpha], self.y[beta]
        tt, ti, it, ii = products
        return u1[row] * (tt * y1[item] + ti * y2[item]) + u2[row] * (it * y1[item] + ii * y2[item])

    def exact(self, cell: int, a: int, z: int) -> np.ndarray:
        rows = np.arange(len(self.q[0]))[:, None]
        return self._combined(cell, [v @ w[a:z].T for v in self.q for w in self.c], rows, np.arange(a, z)[None])

    def of_pairs(self, cell: int, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        return self._combined(cell, [_dots(v, row, w.__getitem__, item) for v in self.q for w in self.c], row, item)


def _true(hit: np.ndarray) -> np.ndarray:
    """As ``np.flatnonzero``, faster where few are true: words of eight first."""
    if hit.size % 8:
        return np.flatnonzero(hit)
    eight = hit.reshape(-1).view(np.uint64)
    words = np.flatnonzero(eight != 0)
    at = np.flatnonzero(eight[words].view(bool))
    return (words[at >> 3] << 3) + (at & 7)


def _places(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns in a matrix so wide."""
    return np.divmod(at, width) if width != SIFT_CHUNK else (at >> SIFT_BITS, at & (SIFT_CHUNK - 1))


def _above(s: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = _true(s > floor)
    return (*(p := _places(at, s.shape[1]))[:1], s.reshape(-1)[at], p[1])


def _joined(some: list[tuple]) -> tuple:
    return some[0] if len(some) == 1 else tuple(np.concatenate(x) for x in zip(*some, strict=True))


class _Sieve:
    """Candidates of one cell: pairs whose float32 score may be among the k best. They are scored exactly once at the end;
    or, if too many cannot be told apart in float32 (copies, say), from then on as they come, in a running top-k.
    ``names``: what that holds for an item and, if called for, along with a pair."""

    def __init__(self, rough: Rough, cell: int, query_ids: np.ndarray, items: np.ndarray, k: int, exclude_self: bool):
        self.rough, self.cell, self.k = rough, cell, k
        self.query_ids, self.items, self.exclude_self = query_ids, items, exclude_self
        self.slack, self.scale = rough.slack[cell][:, 0], rough.scale[cell][:, 0]
        self.some: list[tuple] = []
        self.held = self.settled = 0
        self.top = np.full((len(query_ids), k), -np.inf, np.float32)  # the best scores so far, the k-th first
        self.best: Best | None = None
        self.most = 2 * (4 * k + FIRST_ITEMS)
        self.names = self.extra = None
        self.later = True

    def carry_on(self, best: Best, names: np.ndarray, extra, later: bool) -> None:
        """With the best items of earlier blocks; ``later``: no id is below theirs."""
        self.best, self.names, self.extra, self.later = best, names, extra, later
        self._exact()

    def first(self, s: np.ndarray, z: int) -> None:
        """Scores of the first items."""
        s = s.copy()
        if self.exclude_self:
            mask_self(s, self.query_ids, self.items[:z])
        if self.rough.allowed:
            s[~self.rough.allowed(np.arange(len(s))[:, None], np.arange(z)[None])] = -np.inf
        k = min(self.k, z)
        self.top[:, -k:] = np.partition(s, z - k, axis=1)[:, z - k :]
        self._floor(self.top[:, 0])
        at = _true((s >= self.floor) & (s > -np.inf))
        r, c = np.divmod(at, z)
        self.some, self.held, self.settled = [(r, s[r, c], c)], len(r), 1
        if self.held > len(s) * self.most:  # copies: what follows is scored exactly
            self.best = Best(len(s), self.k)
            self.best.fill(r, self.rough.of_pairs(self.cell, r, c), c)
            self.some, self.held, self.settled = [], 0, 0
            self._exact()

    def _floor(self, kth: np.ndarray) -> None:
        self.floor = (kth - 2 * self.slack / self.scale).astype(np.float32)[:, None]

    def add(self, r: np.ndarray, s: np.ndarray, c: np.ndarray, a: int, z: int) -> None:
        """Pairs of the items from ``a`` to ``z`` with a score above the floors."""
        if not len(r):
            return
        if self.best is not None and len(r) > len(self.slack) * (z - a) // 16:
            self.settle()  # items with lower ids come first
            scores = self.rough.exact(self.cell, a, z)
            r, c = np.nonzero(scores > self.exact_floor)
            more = self._other(r, a + c)
            if self.rough.allowed:
                more &= self.rough.allowed(r, a + c)
            r, c = r[more], c[more]
            self._merge(r, scores[r, c], a + c)
            return
        if self.rough.allowed:
            some = self.rough.allowed(r, a + c)
            r, s, c = r[some], s[some], c[some]
        self.some.append((r, s, a + c))
        self.held += len(r)
        if self.held > len(self.slack) * self.most:
            self.settle()

    def _other(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Pairs that are not a row with itself."""
        return self.items[c] != self.query_ids[r] if self.exclude_self else np.ones(len(r), bool)

    def _merge(self, r: np.ndarray, score: np.ndarray, c: np.ndarray) -> None:
        (self.best.append if self.later else self.best.merge)(r, score, c if self.names is None else self.names[c], self.extra(r, c) if self.extra else None)
        self._exact()

    def settle(self) -> None:
        """Raise the floors by the scores found since the last time."""
        if len(self.some) == self.settled:
            return
        r, s, c = _joined(self.some[self.settled :])
        if self.exclude_self:
            other = self._other(r, c)
            if not other.all():
                r, s, c = r[other], s[other], c[other]
        n, k = len(self.slack), self.k
        if self.best is not None:
            self.some, self.held = [], 0
            score = self.rough.of_pairs(self.cell, r, c)
            more = score > self.exact_floor[r, 0]
            self._merge(r[more], score[more], c[more])
            return
        self.some[self.settled :] = [(r, s, c)]
        count = np.bincount(r, minlength=n)
        order = np.argsort(r.astype(np.min_scalar_type(n)), kind="stable")
        wide = np.full((n, k + int(count.max(initial=0))), -np.inf, np.float32)
        wide[:, :k] = self.top
        wide[r[order], k + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = s[order]
        wide.partition(wide.shape[1] - k, axis=1)
        self.top = wide[:, -k:].copy()
        self._floor(self.top[:, 0])
        self.settled = len(self.some)
        if self.held > n * self.most:
            r, s, c = self._left()
            if np.bincount(r, minlength=n).max(initial=0) > self.most // 2:
                self.best = Best(n, k)
                self.best.fill(r, self.rough.of_pairs(self.cell, r, c), c)
                self.some, self.held, self.settled = [], 0, 0
                self._exact()
                return
            self.some, self.held, self.settled = [(r, s, c)], len(r), 1

    def _left(self) -> tuple:
        """Candidates above the floors, in the order of the items."""
        r, s, c = _joined(self.some) if self.some else (np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64))
        keep = s >= self.floor[r, 0]
        return r[keep], s[keep], c[keep]

    def _exact(self) -> None:
        self.exact_floor = _floor(self.best) if self.later else _level(self.best)
        self.floor = ((self.exact_floor - self.slack[:, None]) / self.scale[:, None]).astype(np.float32)

    def result(self) -> Best:
        self.settle()
        if self.best is None:
            r, _, c = self._left()
            self.best = Best(len(self.slack), self.k)
            self.best.fill(r, self.rough.of_pairs(self.cell, r, c), c)
        return self.best


def _sifted_topk(query_ids: np.ndarray, items: np.ndarray, k: int, cells: int, exclude_self: bool, rough: Rough) -> list[Best]:
    n = len(items)
    upto = min(n, max(4 * k, 2 * FIRST_ITEMS))
    sieves = [_Sieve(rough, cell, query_ids, items, k, exclude_self) for cell in range(cells)]
    for sieve, s in zip(sieves, rough.scores(0, upto), strict=True):
        sieve.first(s, upto)
    seen, upto = upto, min(n, 2 * upto)
    while seen < n:
        for a in range(seen, upto, SIFT_CHUNK):
            z = min(a + SIFT_CHUNK, upto)
            for sieve, found in zip(sieves, rough.above(a, z, [sieve.floor for sieve in sieves]), strict=True):
                sieve.add(*found, a, z)
        for sieve in sieves:
            sieve.settle()
        seen, upto = upto, min(n, 2 * upto)
    return [sieve.result() for sieve in sieves]


def more_topk(query_ids: np.ndarray, items: np.ndarray, best: list[Best], exclude_self: bool, rough: Rough, later: bool, extra) -> None:
    """Adds a further block of items to the top-k of each cell, which hold row ids and are full. ``later``: no id of the block is below
    those seen so far, so an item must exceed the k-th best; ``extra(row, place)`` goes along."""
    sieves = [_Sieve(rough, cell, query_ids, items, b.score.shape[1], exclude_self) for cell, b in enumerate(best)]
    for sieve, b in zip(sieves, best, strict=True):
        sieve.carry_on(b, items, extra, later)
    for a in range(0, len(items), SIFT_CHUNK):
        z = min(a + SIFT_CHUNK, len(items))
        for sieve, found in zip(sieves, rough.above(a, z, [sieve.floor for sieve in sieves]), strict=True):
            sieve.add(*found, a, z)
    for sieve in sieves:
        sieve.settle()


def running_topk(query_ids: np.ndarray, items: np.ndarray, k: int, cells: int, scores, exclude_self: bool, finite: bool = True,
                 rough: Rough | None = None) -> list[Best]:
    """Top-k of the queries among ``items`` (ascending ids), for each of ``cells`` ways to score: ``scores(a, z)`` yields, in turn,
    their score matrices of the items from ``a`` to ``z``. ``item`` of the result are places in ``items``.

    Candidates must beat the k-th best so far, and are merged whenever the number of items seen has doubled: a matrix is
    read once, and few of its scores are sorted. With ``rough`` (finite scores only), float32 scores find the candidates and
    raise the floors, and what is left at the end is scored exactly."""
    if rough is not None and len(items):
        return _sifted_topk(query_ids, items, k, cells, exclude_self, rough)
    n, every = len(items), np.arange(len(query_ids))
    best = [Best(len(query_ids), k) for _ in range(cells)]
    seen, upto = 0, min(n, max(4 * k, FIRST_ITEMS))
    while seen < n:
        floors = [_floor(b) for b in best]
        found: list[list] = [[] for _ in best]
        for a in range(seen, upto, ITEM_CHUNK):
            z = min(a + ITEM_CHUNK, upto)
            for cell, s in enumerate(scores(a, z)):
                if not finite:
                    s[~np.isfinite(s)] = -np.inf
                if exclude_self:
                    mask_self(s, query_ids, items[a:z])
                if seen == 0:
                    best[cell].add(every, s, np.arange(a, z))
                    continue
                at = np.flatnonzero(s > floors[cell])
                if len(at):
                    r, c = np.divmod(at, z - a)
                    found[cell].append((r, s[r, c], a + c))
        for b, some in zip(best, found, strict=True):
            if some:
                b.merge(*(np.concatenate(x) for x in zip(*some, strict=True)))
        seen, upto = upto, min(n, 2 * upto)
    return best
