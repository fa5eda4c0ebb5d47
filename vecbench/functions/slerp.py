"""Spherical interpolation (F1) as native Spark expressions, plus a NumPy twin.

Rule (t is the weight of the second vector):

  a = v1/(|v1|+eps), b = v2/(|v2|+eps), eps = 1e-8
  t <= 0 -> a ; t >= 1 -> b
  d = clip(a.b, -1, 1)
  |d| > 0.9995            -> r = (1-t)a + t b, return r/(|r|+eps)
  theta = acos(|d|), s = sin(theta); s < 1e-6 -> same linear rule
  f1 = sin((1-t)theta)/s, f2 = sin(t theta)/s, f2 = -f2 when d < 0
  return (f1 a + f2 b)/(|f1 a + f2 b| + eps)

The fused vector is linear in the raw inputs: ``u1*v1 + u2*v2``. The Spark
form binds the per-row scalars (norms, dot, u1, u2) once per row and then
runs one ``zip_with``, so the trigonometry runs once per row and the
per-element work is a multiply-add.

F2 (per row): a missing modality returns the other one unchanged (not
normalised), as the batch rule does for a missing matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbench.functions.vectors import EPS, bind, dot, sumsq

# Fixed values of the interpolation rule.
LINEAR_DOT = 0.9995
MIN_SIN = 1e-6


def _coefficients(nt: Column, ni: Column, ti: Column, t: Column,
                  eps: float = EPS) -> tuple[Column, Column]:
    """u1, u2 such that slerp(v1, v2, t) = u1*v1 + u2*v2, from |v1|, |v2|, v1.v2."""
    da = nt + F.lit(eps)
    db = ni + F.lit(eps)
    aa = (nt * nt) / (da * da)
    bb = (ni * ni) / (db * db)
    ab = ti / (da * db)
    d = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ab))
    theta = F.acos(F.abs(d))
    s = F.sin(theta)
    linear = (F.abs(d) > F.lit(LINEAR_DOT)) | (s < F.lit(MIN_SIN))
    g1 = F.when(linear, F.lit(1.0) - t).otherwise(F.sin((F.lit(1.0) - t) * theta) / s)
    g2 = F.when(linear, t).otherwise(
        F.when(d < 0, -F.sin(t * theta) / s).otherwise(F.sin(t * theta) / s))
    rn = F.sqrt(F.greatest(F.lit(0.0), g1 * g1 * aa + g2 * g2 * bb + F.lit(2.0) * g1 * g2 * ab)) + F.lit(eps)
    u1 = F.when(t <= 0, F.lit(1.0) / da).when(t >= 1, F.lit(0.0)).otherwise(g1 / da / rn)
    u2 = F.when(t <= 0, F.lit(0.0)).when(t >= 1, F.lit(1.0) / db).otherwise(g2 / db / rn)
    return u1, u2


def slerp(v1: str | Column, v2: str | Column, t: str | float | Column,
          eps: float = EPS) -> Column:
    """F1/F2 as one Column: slerp(v1, v2, t) row by row.

    ``t`` is a column (name) or a constant. Rows where one vector is NULL get
    the other vector as is; both NULL gives NULL. The per-row scalars are
    bound once per row (:func:`bind`), so the per-element work is one
    multiply-add whatever the optimizer does with the expression.
    """
    a = F.col(v1) if isinstance(v1, str) else v1
    b = F.col(v2) if isinstance(v2, str) else v2
    tc = (F.col(t) if isinstance(t, str) else t if isinstance(t, Column) else F.lit(float(t)))

    def with_inputs(p):
        va, vb, vt = p["a"], p["b"], p["t"]
        scalars = F.struct(F.sqrt(sumsq(va)).alias("nt"), F.sqrt(sumsq(vb)).alias("ni"),
                           dot(va, vb).alias("ti"), vt.alias("t"))

        def with_scalars(s):
            u1, u2 = _coefficients(s["nt"], s["ni"], s["ti"], s["t"], eps)
            mixed = bind(F.struct(u1.alias("u1"), u2.alias("u2")),
                         lambda u: F.zip_with(va, vb, lambda x, y: x * u["u1"] + y * u["u2"]))
            return (F.when(s["t"] <= 0, bind(u1, lambda c: F.transform(va, lambda x: x * c)))
                     .when(s["t"] >= 1, bind(u2, lambda c: F.transform(vb, lambda y: y * c)))
                     .otherwise(mixed))

        return bind(scalars, with_scalars)

    # inputs, then per-row scalars, are bound once per row
    inputs = F.struct(a.alias("a"), b.alias("b"), tc.cast("double").alias("t"))
    return (F.when(a.isNull(), b)
             .when(b.isNull(), a)
             .otherwise(bind(inputs, with_inputs)))


def with_slerp(df: DataFrame, v1: str, v2: str, t: str | float, out: str = "fused",
               eps: float = EPS) -> DataFrame:
    """DataFrame form of :func:`slerp`."""
    return df.withColumn(out, slerp(v1, v2, t, eps))


def slerp_coefficients_np(v1: np.ndarray, v2: np.ndarray, t: float, eps: float = EPS,
                          has1: np.ndarray | None = None, has2: np.ndarray | None = None):
    """(u1, u2) per row with slerp(v1, v2, t) = u1 * v1 + u2 * v2 (same rule as :func:`slerp_np`).

    A row missing one modality keeps the other raw: (1, 0) or (0, 1) (F2).
    """
    n1 = np.sqrt(np.einsum("ij,ij->i", v1, v1))
    n2 = np.sqrt(np.einsum("ij,ij->i", v2, v2))
    da, db = n1 + eps, n2 + eps
    if t <= 0:
        u1, u2 = 1.0 / da, np.zeros_like(da)
    elif t >= 1:
        u1, u2 = np.zeros_like(db), 1.0 / db
    else:
        ab = np.einsum("ij,ij->i", v1, v2) / (da * db)
        aa, bb = (n1 / da) ** 2, (n2 / db) ** 2
        d = np.clip(ab, -1.0, 1.0)
        theta = np.arccos(np.abs(d))
        s = np.sin(theta)
        linear = (np.abs(d) > LINEAR_DOT) | (s < MIN_SIN)
        safe_s = np.where(linear, 1.0, s)
        g1 = np.where(linear, 1.0 - t, np.sin((1.0 - t) * theta) / safe_s)
        g2 = np.where(linear, t, np.sin(t * theta) / safe_s)
        g2 = np.where(~linear & (d < 0), -g2, g2)
        rn = np.sqrt(np.maximum(0.0, g1 * g1 * aa + g2 * g2 * bb + 2 * g1 * g2 * ab)) + eps
        u1, u2 = g1 / da / rn, g2 / db / rn
    if has1 is not None and has2 is not None:
        u1 = np.where(~has2, 1.0, np.where(~has1, 0.0, u1))
        u2 = np.where(~has2, 0.0, np.where(~has1, 1.0, u2))
    return u1, u2


def slerp_np(v1: np.ndarray, v2: np.ndarray, t: float, eps: float = EPS,
             has1: np.ndarray | None = None, has2: np.ndarray | None = None) -> np.ndarray:
    """Row-wise slerp of two (n, d) matrices under one weight ``t`` (same rule).

    ``has1``/``has2`` mark rows where a modality exists; a row missing one
    modality returns the other raw row (F2).
    """
    u1, u2 = slerp_coefficients_np(v1, v2, t, eps)
    out = v1 * u1[:, None] + v2 * u2[:, None]
    if has1 is not None and has2 is not None:
        out = np.where((~has2)[:, None], v1, out)
        out = np.where((~has1)[:, None], v2, out)
    return out
