import json
import os

import pytest

import numpy as np
from pyspark.sql import functions as F

from vecbench.operators.encode import adapt_linear, encode, incremental_encode, rotation_matrix
from vecbench.sources.files import (list_datasets, load_dataset, read_jsonl_folder, read_results_store,
                                    repair_csv)
from vecbench.streaming.search import stream_search

CATALOG = '''id,text,image_path,metadata,text_embedding,image_embedding
A1,"Lamp, desk",img/a1.jpg,"{""category"": ""home"", ""price"": 12.5}","[0.1, 0.2, 0.3]","[0.3, 0.2, 0.1]"
A1,"Lamp ""pro""
two lines",img/a1b.jpg,"{""category"": ""home""}","[0.2, 0.2, 0.2]",
B2,Chair,img/b2.jpg,{},"[0.9, 0.1, 0.0]","[0.0, 0.1, 0.9]"
'''
QUERIES = '''id,text,image_path,metadata,product_counts,text_embedding,image_embedding
A1,lamp,img/q1.jpg,{},,"[0.1, 0.2, 0.31]","[0.3, 0.2, 0.1]"
'''


def _dataset(base):
    for side, name, body in (("catalog", "b.csv", CATALOG), ("catalog", "a.csv", CATALOG),
                             ("test", "q.csv", QUERIES)):
        d = os.path.join(base, "shop", side)
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(body)


def test_csv_dataset_scan(spark, scratch):
    _dataset(scratch)
    cat, qry = load_dataset(spark, scratch, "shop")
    assert cat.count() == 6                                     # both files of the catalog
    cat, _ = load_dataset(spark, scratch, "shop", catalog_file="a.csv")
    rows = cat.orderBy("image_path").collect()
    assert [r.id for r in rows] == ["A1", "A1", "B2"]
    assert json.loads(rows[0].metadata)["price"] == 12.5        # doubled quotes kept one cell
    assert rows[1].text == 'Lamp "pro"\ntwo lines'
    assert rows[1].image_embedding is None and rows[1].text_embedding == [0.2, 0.2, 0.2]
    assert cat.select("source_file").distinct().first()[0].endswith("a.csv")
    q = qry.first()
    assert 1 <= q.product_counts <= 20 and q.dataset == "shop"
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, scratch, "shop", catalog_file="none.csv")
    ds = list_datasets(spark, scratch).first()
    assert ds.dataset == "shop" and ds.catalog == ["a.csv", "b.csv"] and ds.test == ["q.csv"]


def test_repair_csv_sink(spark, scratch):
    src = os.path.join(scratch, "raw.csv")
    with open(src, "w") as f:
        f.write('Unnamed: 0,sku_artc,text_embedding\n0,X1,"[0.1  0.2\n 0.3]"\n')
    out = repair_csv(spark, src, os.path.join(scratch, "fixed"), rename={"sku_artc": "id"})
    r = out.first()
    assert out.columns == ["id", "text_embedding"] and r.text_embedding == "[0.1, 0.2, 0.3]"


def test_jsonl_and_results_store(spark, scratch):
    pts = os.path.join(scratch, "points")
    os.makedirs(pts)
    with open(os.path.join(pts, "101.jsonl"), "w") as f:
        f.write('{"GitHub": "u1", "New dataset": 2}\n{"GitHub": "u2", "Bug fixes": 3}\n')
    with open(os.path.join(pts, "102.jsonl"), "w") as f:
        f.write('{"GitHub": "u1", "Review PR": 2}\n')
    df = read_jsonl_folder(spark, pts)
    assert df.count() == 3 and set(df.columns) >= {"GitHub", "New dataset", "Bug fixes", "Review PR", "file"}
    assert sorted(r.file for r in df.collect()) == ["101", "101", "102"]
    res = os.path.join(scratch, "results", "m1", "rev1")
    os.makedirs(res)
    with open(os.path.join(res, "TaskA.json"), "w") as f:
        json.dump({"task_name": "TaskA", "scores": {"test": [{"hf_subset": "default", "main_score": 0.5}]}}, f)
    r = read_results_store(spark, os.path.join(scratch, "results")).first()
    assert (r.model, r.revision, r.task, r.split, r.subset, r.score) == ("m1", "rev1", "TaskA", "test", "default", 0.5)


def test_encoder_store_and_adapter(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "row_id bigint, text string")

    def enc(texts):
        return np.array([[len(t), 1.0] for t in texts])

    out = {r.row_id: r.v for r in encode(df, enc, "text", "v", batch_size=2).collect()}
    assert out[1] == [1.0, 1.0] and out[2] == [2.0, 1.0] and out[3] is None
    again = encode(df.withColumn("v", F.lit(None).cast("array<double>")), enc, "text", "v")
    assert again.columns == ["row_id", "text", "v"] and again.where("v is not null").count() == 2
    store = os.path.join(scratch, "store")
    calls = spark.sparkContext.accumulator(0)

    def counted(d):
        return encode(d, enc, "text", "v").withColumn("_c", F.lit(1))

    a = incremental_encode(spark, df.where("text is not null"), store, encoder_name="len", config="v1",
                           dataset="d", side="catalog", key_cols=["text"], encode_fn=counted, vector_cols=["v"])
    assert a.where("v is null").count() == 0
    more = spark.createDataFrame([(1, "a"), (4, "cccc"), (5, "cccc"), (6, "cccc")], "row_id bigint, text string")
    b = incremental_encode(spark, more, store, encoder_name="len", config="v1", dataset="d", side="catalog",
                           key_cols=["text"], encode_fn=counted, vector_cols=["v"])
    assert {r.row_id: r.v for r in b.collect()}[4] == [4.0, 1.0]
    stored = spark.read.parquet(store)
    assert stored.count() == 3          # 'a' was not encoded twice, 'cccc' once for three copies
    assert b.where("v is null").count() == 0
    del calls
    m = rotation_matrix(2, 1)
    rot = adapt_linear(spark.createDataFrame([(1, [3.0, 4.0])], "row_id bigint, v array<double>"), "v", m).first()
    assert abs(np.linalg.norm(rot.v) - 1.0) < 1e-6


def test_stream_search(spark, scratch):
    src = os.path.join(scratch, "qstream")
    rows = [(i, str(i % 2), [float(i), 1.0], [1.0, float(i)]) for i in range(6)]
    schema = "row_id bigint, id string, text_embedding array<double>, image_embedding array<double>"
    spark.createDataFrame(rows, schema).write.parquet(src)
    catalog = spark.createDataFrame(rows, schema)
    sink = os.path.join(scratch, "hits")
    q = stream_search(spark.readStream.schema(schema).parquet(src), catalog, sink, k=2,
                      alphas=(0.5,), betas=(0.5,), checkpoint=os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 12 and out.select("query_row").distinct().count() == 6


def test_encoder_retries_transient_failures(spark):
    import os
    import tempfile
    marker = tempfile.mkdtemp(prefix="vb-retry-", dir="/tmp")

    def flaky(texts):
        # fails the first time it is called in each task, then succeeds
        flag = os.path.join(marker, str(os.getpid()))
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("transient")
        return np.ones((len(texts), 2))

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "row_id bigint, text string").coalesce(1)
    out = encode(df, flaky, "text", "v", batch_size=4, retries=2, backoff=0.01).collect()
    assert all(r.v == [1.0, 1.0] for r in out)


def test_stream_search_default_checkpoint(spark, scratch):
    import uuid
    src = os.path.join(scratch, "qs")
    schema = "row_id bigint, id string, text_embedding array<double>, image_embedding array<double>"
    rows = [(i, "a", [1.0, float(i)], [float(i), 1.0]) for i in range(4)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    sink = os.path.join(scratch, "out")
    q = stream_search(spark.readStream.schema(schema).parquet(src), spark.createDataFrame(rows, schema), sink,
                      k=1, alphas=(0.0,), betas=(1.0,), name=f"t{uuid.uuid4().hex[:8]}")
    q.awaitTermination(120)
    assert spark.read.parquet(sink).count() == 4
