"""Vector expressions on ``array<double>`` columns (P1, P2, P7, dot/norm/cosine).

Scalar results (dot, norm) are plain Column expressions. Operations that
need a per-row scalar inside a per-element lambda (normalise, scale) are
DataFrame functions that stage the scalar in its own column first, so the
scalar is computed once per row and not once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the epsilon added to every norm before dividing.
EPS = 1e-8


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def sumsq(a: str | Column) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a: str | Column) -> Column:
    """Euclidean length."""
    return F.sqrt(sumsq(a))


def as_double_vector(a: str | Column) -> Column:
    """float32 storage -> double arithmetic."""
    return _c(a).cast("array<double>")


def rotate(a: str | Column, shift: int) -> Column:
    """Cyclic left rotation by ``shift`` positions: [x_{s+1}..x_n, x_1..x_s]."""
    a = _c(a)
    n = F.size(a)
    return F.concat(F.slice(a, shift + 1, n - shift), F.slice(a, 1, shift))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    ``element_at(transform(array(value), body), 1)``: the scalar is computed
    once even when the optimizer inlines the expression into a filter or
    another projection, so per-element lambdas never recompute per-row work.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(a: str | Column, eps: float = EPS) -> Column:
    """``v / (||v|| + eps)``; ``eps=0`` gives the plain unit vector."""
    # the input is bound too: an expression input (e.g. a generated vector) is
    # evaluated once, not once for the norm and again for the division
    return bind(_c(a), lambda v: bind(norm(v) + F.lit(eps), lambda n: F.transform(v, lambda x: x / n)))


def scale(a: str | Column, factor: float | Column) -> Column:
    """E5 scaling adapter: every element times ``factor``."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_c(a), lambda x: x * f)


def with_normalized(df: DataFrame, col: str, out: str | None = None,
                    eps: float = EPS) -> DataFrame:
    """DataFrame form of :func:`normalize`."""
    return df.withColumn(out or col, normalize(col, eps))


def with_cosine(df: DataFrame, a: str, b: str, out: str = "cosine",
                eps: float = EPS) -> DataFrame:
    """cosine of ``a`` and ``b`` with the same epsilon on both norms."""
    return df.withColumn(out, dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps))))


def parse_vector(s: str | Column) -> Column:
    """``"[0.1, 0.2]"`` -> array<double>.

    Strips the outer brackets, splits on commas, trims each token. An empty
    or missing cell is NULL (not an empty vector); a token that is not a
    number becomes a NULL element, which the dataset validation (V2) counts.
    """
    s = _c(s)
    body = F.regexp_replace(F.trim(s), r"^\[|\]$", "")
    parts = F.split(body, ",")
    vec = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    return F.when(F.trim(body) == "", F.lit(None).cast("array<double>")).otherwise(vec)


def format_vector(a: str | Column) -> Column:
    """Inverse of :func:`parse_vector` for writing CSV: ``[x1, x2, ...]``."""
    return F.concat(F.lit("["), F.array_join(_c(a).cast("array<string>"), ", "), F.lit("]"))


# What separates the numbers of a broken vector cell (default and strict mode).
SEPARATORS = r"[\s,]+"
STRICT_SEPARATORS = r"\s+"


def repair_vector_string(s: str | Column, strict: bool = False) -> Column:
    """Turn a multi-line, whitespace-separated vector into ``[a, b, c]``.

    Rules: blank -> ``''``; strip surrounding quote characters; take the text
    between the first ``[`` and the first ``]`` (across newlines); split on
    whitespace and commas (``strict``: on whitespace alone, which keeps commas
    in the tokens), drop empty tokens, join with ``', '`` inside brackets. Text
    without a bracket pair comes back stripped but otherwise unchanged.
    """
    s = _c(s)
    stripped = F.regexp_replace(F.trim(s), r"^['\"]+|['\"]+$", "")
    has_pair = stripped.rlike(r"(?s)\[.*?\]")
    inner = F.regexp_extract(stripped, r"(?s)\[(.*?)\]", 1)
    tokens = F.filter(F.split(inner, STRICT_SEPARATORS if strict else SEPARATORS), lambda t: t != "")
    fixed = F.concat(F.lit("["), F.array_join(tokens, ", "), F.lit("]"))
    return (F.when(s.isNull() | (F.trim(s) == ""), F.lit(""))
             .when(has_pair, fixed)
             .otherwise(stripped))


def zero_vector(dim: Column | int) -> Column:
    """Zeros of a given dimension."""
    d = dim if isinstance(dim, Column) else F.lit(dim)
    return F.array_repeat(F.lit(0.0), d)


def is_nonzero(a: str | Column) -> Column:
    """True when at least one element is non-zero (drops zero placeholders)."""
    return F.exists(_c(a), lambda x: x != 0)


def with_default_vector(df: DataFrame, col: str, dim: int | Column) -> DataFrame:
    """A missing vector (e.g. an image that could not be encoded) becomes zeros of ``dim``."""
    return df.withColumn(col, F.coalesce(F.col(col), zero_vector(dim)))


def round_floats(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every float/double in the frame to ``digits``, inside structs,
    arrays and map values too (driven by the schema, one projection)."""
    from pyspark.sql import types as T

    def rnd(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.FloatType, T.DoubleType)):
            return F.round(c, digits)
        if isinstance(t, T.StructType):
            return F.struct(*[rnd(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: rnd(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, v: rnd(v, t.valueType))
        return c

    return df.select(*[rnd(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
