"""Batches, late interaction of long texts, re-ranking in blocks, validation on the pass, contamination by split,
prompted zero-shot labels, any-to-any retrieval and encoders."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbench.operators import compare, tasks
from vecbench.operators.anymodal import any_to_any, any_to_any_ndcg
from vecbench.operators.catalogops import collect_batches, unpivot_documents
from vecbench.operators.encode import adapt_linear, encode
from vecbench.operators.late import DOC_TILE, QUERY_TILE, maxsim, maxsim_search, segments, together
from vecbench.operators.quality import validated
from vecbench.operators.rerank import rerank


# ------------------------------------------------------------- batches
def test_planted_clusters_are_recovered_in_every_batch(spark):
    rng = np.random.default_rng(4)
    rows = []
    for batch in range(6):
        centres = rng.normal(0, 10, (5 + batch % 2, 8))
        rows += [(batch * 1000 + k, "test" if batch < 4 else "dev", batch, f"c{k % len(centres)}", [float(x) for x in centres[k % len(centres)] + rng.normal(0, 0.1, 8)])
                 for k in range(120)]
    rows.append((99_999, "dev", 5, "c0", None))
    df = spark.createDataFrame(rows, "row_id long, split string, batch int, label string, v array<double>")
    assigned = tasks.kmeans_batches(df, "v", "label", by=("split", "batch"))
    assert assigned.count() == 720 and assigned.columns == ["split", "batch", "row_id", "truth", "cluster"]
    score = {r.split: r for r in tasks.clustering_score(assigned, by=("split", "batch"), split=("split",)).collect()}
    assert all(abs(s.v_measure - 1) < 1e-9 and s.v_measure_std < 1e-9 for s in score.values())
    assert (score["test"].n_batches, score["dev"].n_batches) == (4, 2)
    again = tasks.kmeans_batches(df.repartition(7), "v", "label", by=("split", "batch"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, assigned.collect()))


def test_kmeans_batches_of_one_row_and_of_copies(spark):
    df = spark.createDataFrame([(1, 0, "a", [1.0, 2.0]), *[(k, 1, "ab"[k % 2], [3.0, 3.0]) for k in range(2, 8)]], "row_id long, batch int, label string, v array<double>")
    got = tasks.kmeans_batches(df, "v", "label").collect()
    assert len(got) == 7 and {r.cluster for r in got} == {0}
    assert tasks.kmeans_batches(df.limit(0), "v", "label").count() == 0


def test_collected_batches_hold_texts_in_order(spark):
    rows = [(k, f"title {k}", None if k % 5 == 0 else f"body {k}", f"l{k % 3}") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, title string, body string, label string")
    long = unpivot_documents(df, "id", ["title", "body"], "label", batch_size=16)
    got = {r.batch: r for r in collect_batches(long, "label").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and all(r.n == len(r.sentences) == len(r.labels) == 16 for r in got.values())
    for r in long.collect():
        at = (r.position - 1) % 16
        assert (got[r.batch].sentences[at], got[r.batch].labels[at]) == (r.document, r.label)
    assert collect_batches(long).columns == ["batch", "sentences", "n"] and collect_batches(long.limit(0)).count() == 0


# ------------------------------------------------------------- late interaction
def test_tiles_equal_the_plain_score():
    rng = np.random.default_rng(2)
    qk = np.repeat(np.arange(4), [3, QUERY_TILE + 70, 1, 400])
    ck = np.repeat(np.arange(5), [1, DOC_TILE + 33, 2, 2 * DOC_TILE + 5, 7])
    q, c = rng.normal(size=(len(qk), 6)), rng.normal(size=(len(ck), 6))
    qs, cs = segments(qk), segments(ck)
    want = np.array([[(q[qk == i] @ c[ck == j].T).max(axis=1).sum() for j in range(5)] for i in range(4)])
    parts = list(together(qs, len(qk), QUERY_TILE))
    assert parts[0] == (0, 1) and parts[-1][1] == 4
    got = np.concatenate([maxsim(q, qs, c, cs, a, b) for a, b in parts])
    assert np.allclose(got, want, atol=1e-9)


def test_a_text_of_a_hundred_thousand_tokens_stays_within_its_vectors_and_a_tile():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(100_000, 8))
    q = rng.normal(size=(20_000, 8))
    tracemalloc.start()
    total = maxsim(q, np.array([0]), c, np.array([0]), 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total.shape == (1, 1) and peak < 3 * 8 * QUERY_TILE * DOC_TILE  # the whole matrix takes 16 GB


def test_long_texts_are_searched(spark):
    rnd = random.Random(1)
    tokens = [(d * 100_000 + p, d, p, [rnd.random(), rnd.random()]) for d, n in ((1, 9000), (2, 3), (3, 600)) for p in range(n)]
    t = spark.createDataFrame(tokens, "row_id long, text_id long, pos int, v array<double>").repartition(1).sortWithinPartitions("row_id")
    hits = {(r.query_id, r.doc_id): r.score for r in maxsim_search(t, t, 3, exclude_self=True, corpus_chunk_rows=500).collect()}
    v = {d: np.array([x[3] for x in tokens if x[1] == d]) for d in (1, 2, 3)}
    assert set(hits) == {(a, b) for a in v for b in v if a != b}
    assert all(abs(s - (v[a] @ v[b].T).max(axis=1).sum()) < 1e-6 for (a, b), s in hits.items())


# ------------------------------------------------------------- re-ranking
def test_rerank_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(30, 5)), rng.normal(size=(50, 5))
    c[7] = c[8]
    vec = lambda m: spark.createDataFrame([(k, [float(x) for x in v] if k != 20 else None) for k, v in enumerate(m)], "row_id long, f array<double>")
    first = [(i, r + 1, int(j)) for i in range(30) for r, j in enumerate(rng.permutation(50)[:20])] + [(99, 1, 3), (1, 30, 3), (2, 1, 777)]
    hits = spark.createDataFrame(first, "query_row long, rank int, item_row long")
    want = []
    for i in range(30):
        own = [(j, round(float(q[i] @ c[j]), 9)) for a, r, j in first if a == i and r <= 15 and j < 50 and j != 20]
        want += [(i, k + 1, j) for k, (j, _) in enumerate(sorted(own, key=lambda x: (-x[1], x[0]))[:6])] if i != 20 else []
    for size in (None, 4):
        out = rerank(hits, vec(q), vec(c), "f", top_k=15, keep=6, block_queries=size)
        assert sorted((r.query_row, r.rank, r.item_row) for r in out.collect()) == sorted(want)
    assert rerank(hits.limit(0), vec(q), vec(c), "f", top_k=5).count() == 0


def test_rerank_sends_a_vector_once_a_block(spark):
    rng = np.random.default_rng(9)
    vecs = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(40)], "row_id long, f array<double>")
    hits = spark.createDataFrame([(i, r + 1, (i + r) % 40) for i in range(40) for r in range(10)], "query_row long, rank int, item_row long")
    plan = rerank(hits, vecs, vecs, "f", top_k=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan
    # the pairs are made distinct by (block, item) below the join that fetches item vectors
    assert plan.count("Aggregate [block") + plan.count("Aggregate [_") >= 1 or "Deduplicate" in plan


# ------------------------------------------------------------- validation
def test_validation_rides_on_the_write(spark, scratch):
    rows = [("1", "ok", "p", "{}", [1.0, 2.0]), (None, "b�d", "p", "{x", [0.0, 0.0]), (" ", "t", None, None, None), ("4", "t", "p", "{}", [1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "id string, text string, image_path string, metadata string, text_embedding array<double>").withColumn("surplus", F.lit(1))
    out, found = validated(df.drop("image_path"), name="v1")
    out.write.parquet(f"{scratch}/t")
    r = found.report()
    assert r["missing_columns"] == ["image_path"] and r["extra_columns"] == ["surplus"] and not r["ok"]
    assert (r["n_rows"], r["n_null_id"], r["n_bad_utf8_text"], r["n_null_text_embedding"], r["n_bad_text_embedding"], r["n_zero_text_embedding"], r["n_bad_metadata"]) == (4, 2, 1, 1, 1, 1, 1)
    assert (r["text_embedding_min_dim"], r["text_embedding_max_dim"], r["text_embedding_same_dim"]) == (2, 3, False)
    raw = spark.createDataFrame([(bytearray(b"a\xff"),), (bytearray(b"ok"),)], "b binary").select(F.lit("1").alias("id"), F.col("b").cast("string").alias("text"))
    out, found = validated(raw, required=["id", "text"], name="v2")
    out.write.format("noop").mode("overwrite").save()
    assert found.report()["n_bad_utf8_text"] == 1
    good, found = validated(df.limit(1).drop("surplus"), name="v3")
    good.write.format("noop").mode("overwrite").save()
    assert found.report()["ok"] and found.report()["problems"] == []


# ------------------------------------------------------------- contamination, members
def test_contamination_by_split(spark):
    results = spark.createDataFrame([("m", "t", s, 0.5) for s in ("train", "test")] + [("m", "u", "test", 0.1), ("m", "w", "test", 0.2), ("n", "t", "test", 0.3)],
                                    "model string, task string, split string, score double")
    training = spark.createDataFrame([("m", {"t": ["test"], "u": [], "w": None, "x": ["test"]})], "model string, training_datasets map<string, array<string>>")
    key = lambda df: {(r.model, r.task, r.split) for r in df.collect()}
    assert key(compare.contamination(results, training)) == {("m", "t", "test"), ("m", "u", "test"), ("m", "w", "test")}
    assert key(compare.contamination(results, training, False)) == {("m", "t", "train"), ("n", "t", "test")}
    whole = results.drop("split").distinct()
    assert {(r.model, r.task) for r in compare.contamination(whole, training).collect()} == {("m", "t"), ("m", "u"), ("m", "w")}


def test_members_of_one_and_of_every_benchmark(spark):
    results = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0), ("m", "c", 3.0)], "model string, task string, score double")
    members = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "b")], "benchmark string, task string")
    assert {r.task for r in compare.select_members(results, members, "x").collect()} == {"a", "b"}
    assert sorted((r.benchmark, r.task) for r in compare.select_members(results, members).collect()) == [("x", "a"), ("x", "b"), ("y", "b")]


# ------------------------------------------------------------- zero-shot, any-to-any
def test_zero_shot_by_prompted_labels(spark):
    axes = {"a photo of cat!": [1.0, 0.0], "a photo of dog!": [0.0, 1.0]}
    vector = F.when(F.col("prompt") == "a photo of cat!", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    labels = spark.createDataFrame([("dog",), ("cat",), ("dog",), (None,)], "label string")
    items = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.7]), (3, [0.5, 0.5]), (4, None)], "row_id long, v array<double>")
    seen = []

    def fn(df):
        seen.extend(r.prompt for r in df.collect())
        return df.withColumn("v", vector)
    got = {r.row_id: r.predicted for r in tasks.zero_shot(items, labels, fn, template="a photo of {label}!").collect()}
    assert got == {1: "cat", 2: "dog", 3: "cat"} and sorted(seen) == sorted(axes)


def test_any_to_any_picks_the_vector_of_each_row(spark):
    rows = [(1, "a", "text", [1.0, 0.0], [0.0, 1.0]), (2, "a", "image", [0.0, -1.0], [1.0, 0.0]), (3, "b", "audio", [1.0, 0.0], [1.0, 0.0]),
            (4, "b", "image", [1.0, 0.0], None), (5, "b", "text+image", [0.6, 0.8], [0.6, 0.8]), (6, "c", None, [1.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, id string, modality string, text_embedding array<double>, image_embedding array<double>")
    hits = sorted((r.query_row, r.rank, r.item_row, round(r.score, 6), r.rel) for r in any_to_any(df, df, 2, exclude_self=True).collect())
    assert [h[:3] for h in hits] == [(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 1), (5, 2, 2)]
    ndcg = {(r.modality, r.k): (r.mean, r.n_queries) for r in any_to_any_ndcg(df, df, (1,), exclude_self=True).collect()}
    assert ndcg["text", 1] == (1.0, 1) and ndcg["image", 1] == (0.5, 2) and ndcg["text+image", 1] == (0.0, 1)


# ------------------------------------------------------------- encoders
def test_encode_batches_nulls_and_wrong_counts(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else "x" * k) for k in range(50)], "id long, text string").withColumn("v", F.lit("old"))
    sizes = encode(df, lambda texts: np.array([[len(t), len(texts)] for t in texts]), "text", "v", batch_size=8)
    got = {r.id: r.v for r in sizes.collect()}
    assert sizes.columns == ["id", "text", "v"] and all((got[k] is None) if k % 4 == 0 else (got[k][0] == k and got[k][1] <= 8) for k in got)
    with pytest.raises(Exception, match="vectors for"):
        encode(df, lambda texts: np.zeros((1, 2)), "text", "v", retries=0).count()
    assert encode(df.limit(0), lambda t: np.zeros((len(t), 2)), "text", "v").count() == 0


def test_linear_adapter_values_and_nulls(spark):
    m = np.array([[1.0, 2.0, 0.0], [0.0, 1.0, -1.0]])
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "id long, v array<double>")
    got = {r.id: r.v for r in adapt_linear(df, "v", m, normalize_output=False).collect()}
    assert got == {1: [3.0, 10.0, -4.0], 2: None, 3: [0.0, 0.0, 0.0]}
    unit = {r.id: r.w for r in adapt_linear(df, "v", m, out="w").collect()}
    assert abs(np.linalg.norm(unit[1]) - 1) < 1e-6 and unit[3] == [0.0, 0.0, 0.0] and adapt_linear(df, "v", m, out="w").columns == ["id", "v", "w"]
