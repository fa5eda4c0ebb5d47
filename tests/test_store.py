import json
import os

import pytest
from pyspark.sql import functions as F

from vecbench.functions.hashing import content_key
from vecbench.operators.encode import incremental_encode, store_of
from vecbench.operators.store import VectorStore
from vecbench.sources.files import read_results_store, read_runs, write_runs


def _rows(spark, ids, value=1.0):
    return spark.createDataFrame([(f"k{i}", [float(i), value]) for i in ids], "content_key string, v array<double>")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_side_is_not_exchanged(spark, scratch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = VectorStore(spark, f"{scratch}/s", ["v"], buckets=4)
        assert store.read() is None
        store.append(_rows(spark, range(100)))
        store.append(_rows(spark, range(100, 150)))
        asked = spark.createDataFrame([(f"k{i}",) for i in range(0, 300, 3)], "content_key string")
        joined = asked.join(store.read(), "content_key", "left")
        plan = _plan(joined)
        assert plan.count("Exchange hashpartitioning") == 1, plan  # the asked side alone
        assert joined.where("v is not null").count() == 50
        missing = store.missing(asked)
        assert _plan(missing).count("Exchange hashpartitioning") == 1 and missing.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compaction_and_repeated_keys(spark, scratch):
    store = VectorStore(spark, f"{scratch}/s", ["v"], buckets=4)
    for _ in range(3):
        store.append(_rows(spark, range(40)))  # runs that did not see each other
    assert store.read().count() == 40
    files = lambda g, b: [f for f in os.listdir(f"{scratch}/s/gen={g}-buckets={b}") if f.startswith("part-")]
    assert len(files(1, 4)) > 4
    store.compact(buckets=2)
    assert store.generations() == [(1, 4), (2, 2)] and len(files(2, 2)) == 2
    assert store.read().count() == 40
    os.remove(f"{scratch}/s/gen=2-buckets=2/_SUCCESS")  # a compaction that died is not read
    assert store.generations() == [(1, 4)] and store.read().count() == 40
    open(f"{scratch}/s/gen=2-buckets=2/_SUCCESS", "w").close()
    store.drop_old()
    assert store.generations() == [(2, 2)] and VectorStore(spark, f"{scratch}/s", ["v"]).read().count() == 40


def test_incremental_encoding_encodes_once(spark, scratch):
    seen = []

    def run(rows, config="{}"):
        df = spark.createDataFrame(rows, "row_id long, text string")

        def fn(todo):
            seen.append(sorted(r.text for r in todo.collect()))
            return todo.withColumn("v", F.array(F.length("text").cast("double")))
        return incremental_encode(spark, df, scratch, encoder_name="e/1", config=config, dataset="d d", side="catalog", key_cols=["text"],
                                  encode_fn=fn, vector_cols=["v"], buckets=3)

    first = run([(1, "a"), (2, "bb"), (3, "a")])
    assert {r.row_id: r.v for r in first.collect()} == {1: [1.0], 2: [2.0], 3: [1.0]}
    second = run([(1, "a"), (4, "ccc")])
    assert {r.row_id: r.v for r in second.collect()} == {1: [1.0], 4: [3.0]}
    run([(1, "a")], config="other")
    assert seen == [["a", "bb"], ["ccc"], ["a"]]
    stored = store_of(spark, scratch, encoder_name="e/1", config="{}", dataset="d d", side="catalog", vector_cols=["v"])
    assert stored.read().count() == 3 and stored.missing(spark.createDataFrame([("a",), ("z",)], "text string").withColumn("content_key", content_key("text"))).count() == 1


def test_a_rerun_replaces_only_its_cells(spark, scratch):
    rows = lambda score, *cells: spark.createDataFrame([(*c, "test", "default", score, None) for c in cells],
                                                       "model string, revision string, task string, split string, subset string, score double, error string")
    path = f"{scratch}/runs"
    write_runs(rows(1.0, ("m/1", "r", "t1"), ("m/1", "r", "t2"), ("n", "r", "t1")), path)
    write_runs(rows(2.0, ("m/1", "r", "t2")), path)
    got = {(r.model, r.task): r.score for r in read_runs(spark, path).collect()}
    assert got == {("m/1", "t1"): 1.0, ("m/1", "t2"): 2.0, ("n", "t1"): 1.0}
    with pytest.raises(Exception, match="without task"):
        write_runs(rows(3.0, ("m/1", "r", None)), path)
    assert {(r.model, r.task): r.score for r in read_runs(spark, path).collect()} == got


def test_results_store_reads_without_inference(spark, scratch):
    for model, task, text in (("m", "t1", json.dumps({"task_name": "t1", "x": [1], "scores": {"test": [{"hf_subset": "a", "main_score": 0.5}, {"hf_subset": "b", "main_score": 1}]}})),
                              ("m", "t2", json.dumps({"task_name": "t2"})), ("n", "t1", "{broken"),
                              ("o p+q", "t#3", json.dumps({"scores": {"dev": [{"hf_subset": "a", "main_score": 2}]}}))):
        os.makedirs(f"{scratch}/{model}/main", exist_ok=True)
        with open(f"{scratch}/{model}/main/{task}.json", "w") as f:
            f.write(text)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    store = read_results_store(spark, scratch)
    assert jobs() == before
    assert sorted((r.model, r.revision, r.task, r.split, r.subset, r.score) for r in store.collect()) == [
        ("m", "main", "t1", "test", "a", 0.5), ("m", "main", "t1", "test", "b", 1.0),
        ("o p+q", "main", "t#3", "dev", "a", 2.0)]
