import random

import pytest
from cases import documents, empty, prose

from vecbench.llm import minhash as M


def brute(rows, percent=75, width=5):
    sets = []
    for d, t in rows:
        w = M.words((t or "").encode())
        sets.append((d, {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    best = {k: d for k, (d, _) in enumerate(sets)}
    changed = True
    while changed:
        changed = False
        for i, (di, si) in enumerate(sets):
            for j, (dj, sj) in enumerate(sets):
                if di is None or dj is None or not si or not sj:
                    continue
                n = len(si & sj)
                if 100 * n >= percent * (len(si) + len(sj) - n) and best[j] < best[i]:
                    best[i], changed = best[j], True
    return sorted(((d, len(s), best[k], d is None or d == best[k]) for k, (d, s) in enumerate(sets)), key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=repr)


def test_awkward_rows_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(M.near_duplicates(docs)) == brute(rows)


def test_empty_table(spark):
    assert M.near_duplicates(empty(spark)).count() == 0
    assert M.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("small", [0, 6, 10_000])
def test_group_of_mutated_copies_needs_pivot_turns(spark, monkeypatch, small):
    """Pairs of small and of large buckets. Copies of one text with random edits, many of them not linked to the smallest one."""
    rnd = random.Random(5)
    base = prose(9, 60).split()
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = prose(1000 + rnd.randrange(10**6), 1)
        rows.append((k * 3 + 1, " ".join(w)))
    monkeypatch.setattr(M, "PIVOT_TURNS", 2)
    monkeypatch.setattr(M, "COMPARISONS", 4)
    monkeypatch.setattr(M, "SMALL_BUCKET", small)
    monkeypatch.setattr(M, "BLOCK_CLASSES", 25)
    monkeypatch.setattr(M, "COLUMNS", 64)
    assert got(M.near_duplicates(documents(spark, rows))) == brute(rows)


def test_keep_one_keeps_columns_and_smallest(spark):
    docs = documents(spark)
    kept = M.keep_one(docs)
    assert kept.columns == ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    assert 1 in {r.doc_id for r in kept.collect()} and not {2, 3, 8} & {r.doc_id for r in kept.collect()}


def test_keep_one_judges_rows(spark):
    """Repeated rows, null doc_ids, and a doc_id with two texts: one row a group, by its own text."""
    a, b, c = prose(50, 40), prose(51, 40), prose(52, 40)
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, a), (None, c), (None, c), (7, c), (8, None), (8, None), (9, " ")]
    kept = sorted([(r.doc_id, r.text) for r in M.keep_one(documents(spark, rows)).collect()], key=repr)
    assert kept == sorted([(1, a), (2, b), (7, c), (8, None), (8, None), (9, " ")], key=repr)
    only = [(None, a), (None, a), (None, b)]
    assert sorted(r.text for r in M.keep_one(documents(spark, only)).collect()) == sorted([a, b])


def test_a_doc_id_with_two_texts(spark):
    a, b = prose(60, 50), prose(61, 50)
    near = b.split()
    near[3] = "other"
    rows = [(5, a), (5, b), (6, " ".join(near)), (4, a), (3, "x y"), (3, a), (5, b)]
    assert got(M.near_duplicates(documents(spark, rows))) == brute(rows)


def test_repeated_rows_cost_a_row_each(spark, monkeypatch):
    """A thousand repeats of a text and of a near copy: the classes, pairs and links are those of two rows."""
    counts = {}
    settle = M.settle

    def counted(df, tag):
        out = settle(df, tag)
        counts[tag] = max(counts.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(M, "settle", counted)
    a = prose(70, 60).split()
    near = [*a[:30], "changed", *a[31:]]
    rows = [(1, " ".join(a))] * 500 + [(2, " ".join(near))] * 500 + [(k, " ".join(a)) for k in range(3, 503)]
    out = M.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == 1500 and {r.component_id for r in out} == {1} and sum(r.kept for r in out) == 500
    assert counts["classes"] == 2 and counts["pairs"] <= 1 and counts["links"] <= 1 and counts["sets"] == 2 and counts["buckets"] <= 64


def test_estimate_is_corrected_for_chance(spark):
    import numpy as np
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 900).astype(np.uint64)
    rows = []
    for share in (0.0, 0.5, 0.9):
        b = a.copy()
        n = int(len(a) * (1 - share))
        b[:n] = rnd.integers(0, 2**63, n).astype(np.uint64)
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        pack = lambda v: ((M.mixed(M.minima(v)) & np.uint64(15)).reshape(M.LONGS, M.PER_LONG) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
        rows.append((true, pack(a), pack(b)))
    df = spark.createDataFrame(rows, "j double, x array<long>, y array<long>").withColumn("e", M.estimate("x", "y"))
    for r in df.collect():
        assert abs(r.e - r.j) < 0.2


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)], "a long, b long")
    assert {r.comp for r in M.components(links).collect()} == {0}
    with pytest.raises(RuntimeError):
        M.components(links, rounds=1)


def test_blocks_of_a_bucket_equal_brute_force():
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(8)
    sets = [sorted(rnd.sample(range(60), rnd.choice([8, 9, 10, 40]))) for _ in range(50)]
    sets += [s[1:] for s in sets[:20]]
    comp = [k % 7 for k in range(len(sets))]
    side = lambda ks: {"id": ks, "comp": [comp[k] for k in ks], "shingles": pa.array([sets[k] for k in ks], pa.list_(pa.int64()))}
    out, every = [k for k in range(len(sets)) if comp[k]], list(range(len(sets)))
    got = M._linked(75)(pa.table(side(out)), pa.table(side(every) | {"big": [comp[k] == 0 for k in every]}))
    links = {(max(i, j), min(i, j)) for i in out for j in every if comp[i] != comp[j] and 100 * len({*sets[i]} & {*sets[j]}) >= 75 * len({*sets[i]} | {*sets[j]})}
    found = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert found <= links and {frozenset((comp[a], comp[b])) for a, b in found} == {frozenset((comp[a], comp[b])) for a, b in links} and links
    empty = pa.table(side([])).cast(pa.schema([("id", pa.int64()), ("comp", pa.int64()), ("shingles", pa.list_(pa.int64()))]))
    assert M._linked(75)(empty, pa.table(side(every) | {"big": [True] * len(every)})).num_rows == 0 and np.array(sets[0]).size
