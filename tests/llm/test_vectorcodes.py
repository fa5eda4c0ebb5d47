import hashlib
import math
import random

import numpy as np
import pytest
from cases import CLASH
from pyspark.sql import functions as F

from vecbench.llm import vectorcodes as M


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes by comparing every part with every entry, in plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(cut(v, p)) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, c in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), c))
    sums = {}
    for _, _, e, c in out:
        sums[c] = sums.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, sums[c], digest) for i, code, e, c in out), key=repr)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in [*CLASH, "part", "entry", "grouped", "trees", "v"]:
        df = df.withColumn(c, F.lit("x"))
    return df


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def awkward(seed=1, n=330):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(k, [x + rnd.gauss(0, 0.2) for x in rnd.choice(centres)], rnd.choice([None, 0, 1, 2])) for k in range(n)]
    rows += [(1000 + k, [0.5] * 8, 7) for k in range(150)]  # one common vector
    rows += [(5, rows[5][1], 3), (5, rows[5][1], 3), (None, rows[7][1], None), (2000, None, 1), (2001, [None] + [0.0] * 7, 1),
             (2002, [math.nan] + [0.0] * 7, 1), (2003, [math.inf] + [0.0] * 7, 1), (-1, [-0.0001] * 8, 1), (2004, [1 / 1024] * 8, 1)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 100)
    rows = awkward()
    assert got(M.vector_codes(table(spark, rows))) == brute(rows)
    few = rows[:40]
    assert got(M.vector_codes(table(spark, few), parts=2, entries=7, rounds=3)) == brute(few, 2, 7, 3)


def test_ties_go_to_the_lower_index(spark):
    grid = [(k, [float(x), float(y)] * 2, 0) for k, (x, y) in enumerate((x, y) for x in range(6) for y in range(6))]
    assert got(M.vector_codes(table(spark, grid), parts=2, entries=4, rounds=4)) == brute(grid, 2, 4, 4)


def test_empty_tables(spark):
    assert M.vector_codes(table(spark, [])).count() == 0
    assert M.vector_codes(table(spark, [(1, None, 2), (2, [math.nan] * 4, 2)])).count() == 0


def test_bad_lengths_fail(spark):
    with pytest.raises(ValueError):
        M.vector_codes(table(spark, [(1, [0.0] * 6, 1)]))
    with pytest.raises(Exception, match="another length"):
        M.vector_codes(table(spark, [(k, [0.0] * 4, 1) for k in range(300)] + [(999, [0.0] * 8, 1)]))


def test_tree_covers_nests_and_separates():
    rnd = np.random.default_rng(3)
    rows = np.floor(np.concatenate([rnd.normal(c, 30, (60, 3)) for c in (0, 900, 4000)])).astype(np.int64)
    t = M.cover_tree(rows)
    assert (t.points[t.place] == rows).all() and t.counts[-1] == len(rows) and (t.sums[-1] == rows.sum(axis=0)).all()
    far = lambda a, b: np.sqrt(((t.points[a] - t.points[b]) ** 2).sum())
    for n in range(len(t.low)):
        assert max(far(t.low[n], k) for k in range(t.low[n], t.high[n])) <= t.radius[n] + 1e-9
        own = range(t.child[n], t.child[n] + t.children[n])
        if own:
            assert [t.low[n], *[t.high[c] for c in own]] == [*[t.low[c] for c in own], t.high[n]]
            assert all(t.radius[c] <= t.radius[n] / 2 for c in own)
            assert all(far(t.low[a], t.low[b]) > max(t.radius[a], t.radius[b]) for a in own for b in own if a < b)
    assert len(t.low) > 10


def test_whole_subtrees_are_assigned():
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-4000, 4000, (20, 8))
    rows = (np.repeat(centres, 50, axis=0) + rnd.integers(-20, 20, (1000, 8))).astype(np.int64)
    t = M.cover_tree(rows)
    nearest, sums, counts, compared = M.assign(t, centres)
    want = M.squared(rows, centres).argmin(axis=1)
    assert (nearest[t.place] == want).all() and (counts == np.bincount(want, minlength=20)).all()
    assert all((sums[k] == rows[want == k].sum(axis=0)).all() for k in range(20))
    assert compared < 50


def test_large_components_fail():
    with pytest.raises(ValueError, match="too large"):
        M.squared(np.array([[2**30, 0]]), np.array([[0, 2**30]]))
