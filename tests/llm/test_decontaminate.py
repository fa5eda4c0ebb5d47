from cases import documents, empty, prose

from vecbench.llm import decontaminate as D


def brute(rows, items, c=0.75):
    def shingles(t):
        w = D.words((t or "").encode())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    out = []
    for d, t in rows:
        s = shingles(t)
        for i, q in items:
            q = shingles(q)
            if i is not None and q and s and len(q & s) >= c * len(q):
                out.append((d, i, len(q & s), len(q)))
    return sorted(out, key=repr)


def test_items_in_short_and_very_long_documents(spark):
    items = [(k, prose(100 + k, 12 + 4 * k)) for k in range(12)] + [(50, "one two"), (51, None), (None, "one two"), (52, ""), (53, prose(200, 900)), (50, prose(101, 16))]
    rows = [(k, f"{prose(300 + k, 400 * k)} {items[k][1].upper()}. {prose(400 + k, 3000)}") for k in range(12)]
    rows += [(20, prose(500, 50)), (21, None), (22, ""), (23, "One, two!"), (24, prose(600, 100) + " " + prose(200, 900) + " z"), (None, items[3][1])]
    cut = items[9][1].split()
    rows.append((25, prose(700, 2000) + " " + " ".join(cut[: len(cut) * 9 // 10]) + " " + prose(701, 2000)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([tuple(r)[:4] for r in D.contained_items(documents(spark, rows), benchmark).collect()], key=repr)
    assert got == brute(rows, items) and len(got) >= 15
    # blocks of items give the same
    assert sorted([tuple(r)[:4] for r in D.contained_items(documents(spark, rows), benchmark, block_shingles=40).collect()], key=repr) == got
    kept = D.drop_contaminated(documents(spark, rows), benchmark, block_shingles=40)
    assert kept.columns == documents(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {g[0] for g in got}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert D.contained_items(empty(spark), items).count() == 0
    assert D.contained_items(documents(spark), items.limit(0)).count() == 0
    assert D.drop_contaminated(documents(spark), items.limit(0)).count() == documents(spark).count()


def test_small_items_are_never_missed(spark):
    """Items of one to six shingles, placed in a thousand texts, are all found."""
    items = [(k, prose(9000 + k, 5 + k % 6)) for k in range(300)]
    rows = [(k, f"{prose(20_000 + k, 37 + k % 23)} {items[k % 300][1]} {prose(30_000 + k, 31 + k % 17)}") for k in range(900)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contained_items(documents(spark, rows), benchmark).collect()}
    assert {(k, k % 300) for k in range(900)} <= got
    only = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert D.contained_items(documents(spark, [(1, "Zero one, two three four five six"), (2, "one two three four six five")]), only).count() == 1
