import numpy as np
import pytest
from pyspark.sql import functions as F

from vecbench.functions.slerp import slerp, slerp_np
from vecbench.functions.vectors import normalize, parse_vector, repair_vector_string, rotate


def _one(spark, expr, schema="a array<double>, b array<double>", row=None):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b,t,expected", [
    ([1.0, 0.0], [-1.0, 0.0], 0.5, [0.0, 0.0]),                   # antiparallel: linear branch, no sign flip
    ([1.0, 0.0], [-0.6, 0.8], 0.5, [0.894427, -0.447214]),        # obtuse: second weight negated
    ([3.0, 4.0], [1.0, 0.0], 0.0, [0.6, 0.8]),                    # t <= 0 -> unit first vector
    ([3.0, 4.0], [2.0, 0.0], 1.0, [1.0, 0.0]),                    # t >= 1 -> unit second vector
])
def test_slerp_golden(spark, a, b, t, expected):
    got = _one(spark, slerp("a", "b", t), row=(a, b))
    assert np.allclose(got, expected, atol=1e-6)
    assert np.allclose(slerp_np(np.array([a]), np.array([b]), t)[0], expected, atol=1e-6)


def test_slerp_missing_modality_returns_other_raw(spark):
    assert _one(spark, slerp("a", "b", 0.5), row=([3.0, 4.0], None)) == [3.0, 4.0]
    assert _one(spark, slerp("a", "b", 0.5), row=(None, [0.0, 2.0])) == [0.0, 2.0]


def test_slerp_native_equals_numpy(spark):
    rng = np.random.default_rng(7)
    A, B = rng.standard_normal((40, 8)), rng.standard_normal((40, 8))
    B[0] = -A[0] * 2          # antiparallel row
    B[1] = A[1] * 3           # parallel row
    rows = [(A[i].tolist(), B[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for t in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = np.array([r["x"] for r in df.select(slerp("a", "b", t).alias("x")).collect()])
        assert np.allclose(got, slerp_np(A, B, t), atol=1e-12)
        if 0 < t < 1:
            norms = np.linalg.norm(got[2:], axis=1)
            assert np.allclose(norms, 1.0, atol=1e-6)


def test_parse_and_normalize(spark):
    df = spark.createDataFrame([("[0.5, 1e-3, -2]",), ("",), (None,), ("[1, x]",)], "s string")
    got = [r["v"] for r in df.select(parse_vector("s").alias("v")).collect()]
    assert got[0] == [0.5, 0.001, -2.0]
    assert got[1] is None and got[2] is None
    assert got[3] == [1.0, None]
    n = _one(spark, normalize("a"), schema="a array<double>", row=([3.0, 4.0],))
    assert np.allclose(n, [0.6, 0.8], atol=1e-7)
    assert _one(spark, rotate("a", 1), schema="a array<double>", row=([1.0, 2.0, 3.0],)) == [2.0, 3.0, 1.0]


@pytest.mark.parametrize("raw,expected", [
    ('"[0.1  0.2\n 0.3]"', "[0.1, 0.2, 0.3]"),
    ("  ", ""),
    ("no brackets", "no brackets"),
    ("'[1 2]' tail [3]", "[1, 2]"),
    ("[1, 2]", "[1, 2]"),    # a good vector stays as it is
    ("[1,2 , 3\n4]", "[1, 2, 3, 4]"),
])
def test_repair_vector_string(spark, raw, expected):
    assert _one(spark, repair_vector_string("s"), schema="s string", row=(raw,)) == expected


def test_repair_vector_string_strict(spark):
    assert _one(spark, repair_vector_string("s", strict=True), schema="s string", row=("[1, 2]",)) == "[1,, 2]"


def test_round_floats_and_default_vector(spark):
    from vecbench.functions.vectors import round_floats, with_default_vector
    df = spark.createDataFrame([(1.23456, {"a": 2.345}, (3.14159, [1.005, 2.0]))],
                               "x double, m map<string,double>, s struct<p:double, q:array<double>>")
    r = round_floats(df, 2).first()
    assert r.x == 1.23 and r.m == {"a": 2.35} and r.s.p == 3.14 and r.s.q[1] == 2.0
    d = spark.createDataFrame([(1, None), (2, [1.0, 2.0, 3.0])], "id int, v array<double>")
    got = {x.id: x.v for x in with_default_vector(d, "v", 3).collect()}
    assert got[1] == [0.0, 0.0, 0.0] and got[2] == [1.0, 2.0, 3.0]
