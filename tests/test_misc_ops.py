import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vecbench.operators import compare as C
from vecbench.operators.catalogops import filter_models, filter_splits
from vecbench.operators.encode import apply_pca, compose, fit_pca
from vecbench.operators.quality import triviality
from vecbench.sources.files import read_vectors, write_table
from vecbench.sources.testdata import read


def test_pca_adapter_invariants(spark):
    e = read(spark, SF_MID, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    model = fit_pca(e, "v", 8)
    out = apply_pca(model, e, "v", "p")
    rows = out.select("p").collect()
    assert all(len(r.p) == 8 for r in rows)
    var = np.var(np.array([r.p for r in rows]), axis=0)
    assert np.all(np.diff(var) <= 1e-9)          # components come in decreasing variance
    chain = compose(lambda d: apply_pca(model, d, "v", "p"), lambda d: d.withColumn("n", F.size("p")))
    assert chain(e).agg(F.max("n")).first()[0] == 8


def test_split_and_model_filters(spark):
    rows = spark.createDataFrame([("test", "fr-en", 1.0), ("dev", "de-en", 2.0), ("test", "default", 3.0)],
                                 "split string, subset string, score double")
    assert filter_splits(rows, splits=["test"], languages=["en"]).count() == 1
    assert filter_splits(rows, subsets=["default"]).count() == 1
    models = spark.createDataFrame([("org/small-v1", 100), ("org/large-v2", 900)], "name string, n_parameters bigint")
    assert [r.name for r in filter_models(models, "v2", F.col("n_parameters") > 500).collect()] == ["org/large-v2"]


def test_wide_long_roundtrip_and_triviality(spark):
    r = spark.createDataFrame([("m1", "t1", 0.5, None), ("m2", "t1", 0.7, None), ("m1", "t2", 0.9, "err")],
                              "model string, task string, score double, error string")
    w = C.to_wide(r, "task", "model", ["m1", "m2"], row_average=True)
    got = {x.task: x for x in w.collect()}
    assert got["t1"].row_average == 0.6 and got["t2"].m1 is None and got["t2"].row_average is None
    back = C.to_long(w.drop("row_average"), "task", ["m1", "m2"], ("model", "score"))
    assert back.count() == 2
    m = spark.createDataFrame([("a", 0.99), ("b", 0.305), ("c", 0.6)], "task string, mean double")
    b = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 0.3)], "task string, mean double")
    t = {x.task: (x.too_easy, x.near_random) for x in triviality(m, b, ["task"]).collect()}
    assert t == {"a": (True, False), "b": (False, True), "c": (False, False)}


def test_vector_reader_drops_zero_rows(spark, scratch):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    write_table(df, scratch + "/vecs")
    assert [r.id for r in read_vectors(spark, scratch + "/vecs").collect()] == [2]
