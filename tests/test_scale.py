"""Scale paths and sizing rules: exact statistics, tiles, running sums under any plan."""
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vecbench.operators.ann import lsh_search
from vecbench.operators.search import broadcast_limit_bytes, grid_search, table_stats, tiling, topk_search
from vecbench.operators.tasks import average_ranks, global_cumulative
from vecbench.sources.testdata import embedding_items, read


def test_width_is_exact_behind_null_vectors(spark):
    e = read(spark, SF_MID, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))
    nulls = spark.range(64).select((-1 - F.col("id")).alias("row_id"), F.lit(None).cast("array<double>").alias("v"))
    both = nulls.unionByName(e).coalesce(1)
    assert table_stats(both, ["v"]) == (e.count() + 64, 64)
    key = ["query_row", "rank", "item_row"]
    one = {tuple(r) for r in lsh_search(e, e, 5, bits=4, exclude_self=True).select(*key).collect()}
    two = {tuple(r) for r in lsh_search(both.dropna(), both.dropna(), 5, bits=4, exclude_self=True).select(*key).collect()}
    assert one == two


def test_broadcast_bound_is_the_session_setting(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, value in (("256MB", 256 << 20), ("256m", 256 << 20), ("1048576", 1 << 20), ("-1", 0)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert broadcast_limit_bytes(spark) == value
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_copies_a_side_grow_as_the_square_root():
    for p in (16, 256, 4096):
        r, c = tiling(1 << 30, 1 << 30, p, 1 << 40)
        assert r * c >= p and max(r, c) <= math.sqrt(p) + 1
    # a much larger catalog is not copied at all, and no side is copied once a partition of the other
    r, c = tiling(600 << 20, 100 << 40, 1000)
    assert r <= 3 and r * c >= (100 << 40) / (128 << 20)


@pytest.mark.parametrize("method", ["direct", "four_dot"])
def test_tiles_and_many_blocks_equal_one_block(spark, method):
    items = embedding_items(spark, SF_MID)
    key = ["query_row", "alpha", "beta", "rank", "item_row"]
    kw = dict(alphas=(0.0, 0.5), betas=(0.25,), exclude_self=True)
    want = {tuple(r) for r in grid_search(items, items, 7, **kw).select(*key).collect()}
    tiles = grid_search(items.repartition(5), items.repartition(4), 7, broadcast_bytes=0, c_block_rows=37, q_block_rows=23,
                        target_tasks=9, method=method, **kw)
    assert {tuple(r) for r in tiles.select(*key).collect()} == want


@pytest.mark.parametrize("reuse,aqe", [("true", "true"), ("false", "true"), ("true", "false"), ("false", "false")])
def test_running_sum_with_payload(spark, scratch, reuse, aqe):
    n = 60_000
    spark.range(n).select(((F.col("id") * 7919) % 1009).alias("v"), F.col("id").alias("payload"), F.lit(1).alias("one")) \
        .repartition(40).write.mode("overwrite").parquet(scratch + "/t")
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        out = global_cumulative(spark.read.parquet(scratch + "/t"), [F.col("v").desc()], "one", "cum", "pos")
        r = out.agg(F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.sum((F.col("cum") == F.col("pos")).cast("int")).alias("same"),
                    F.countDistinct("payload").alias("p")).first()
        assert (r.d, r.m, r.same, r.p) == (n, n, n, n)
        # larger values come first
        last = out.groupBy("v").agg(F.max("pos").alias("hi"), F.min("pos").alias("lo")).orderBy(F.desc("v")).collect()
        assert all(a.hi < b.lo for a, b in zip(last, last[1:]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_average_ranks_of_a_hot_value(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"), F.col("id"))
    r = {x.id: x.rank for x in average_ranks(df, "x", "rank").collect()}
    assert len(r) == 900 and r[0] == 300.5 and r[600] == 601.0 and r[899] == 900.0


def test_logistic_classification_on_held_out_rows(spark):
    from vecbench.operators.quality import hash_split
    from vecbench.operators.tasks import classification_report, logistic_classification, regression_r2
    e = read(spark, SF_MID, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    s = hash_split(e, "row_id", 0.3)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    pred = logistic_classification(train, test, "v", "label")
    assert pred.count() == test.count()
    share = e.groupBy("label").count().agg(F.max("count")).first()[0] / e.count()
    assert classification_report(pred).first().accuracy >= share
    planted = e.withColumn("y", F.col("v")[0] * 2 - F.col("v")[1] + 1)
    p = hash_split(planted, "row_id", 0.3)
    assert regression_r2(p.where("split = 'train'"), "v", "y", p.where("split = 'test'")).first().r2 > 0.99


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from vecbench import session

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                @staticmethod
                                def isDefined():
                                    return False
                            return O()
                    return S()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())


def test_empty_catalog_with_an_index(spark):
    e = spark.createDataFrame([], "row_id long, v array<double>")
    assert topk_search(e, e, 3, vector="v").count() == 0
