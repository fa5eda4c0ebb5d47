"""Hash-derived values: config fingerprint (S8), default relevance counts (P5),
content keys (S7) and the deterministic hash encoder (E2).

Everything is an md5-based Column expression, so results do not depend on
row order, partitioning or the Python process (unlike a process-salted
``hash()``), and the same values can be recomputed in plain SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecbench.functions.vectors import bind, normalize

TWO32 = float(2 ** 32)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def config_hash(*parts: str | Column) -> Column:
    """First 8 hex digits of md5 over the parts joined by ``_``."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.md5(F.concat_ws("_", *cols)), 1, 8)


def hex8_to_unit(h: Column, start: int) -> Column:
    """8 hex digits at ``start`` (1-based) -> integer in [0, 2^32)."""
    return F.conv(F.substring(h, start, 8), 16, 10).cast("double")


def default_count(key: str | Column, modulus: int = 20) -> Column:
    """P5: seeded default relevance count in 1..modulus, from md5 of the key."""
    return (F.pmod(hex8_to_unit(F.md5(_c(key).cast("string")), 1).cast("bigint"),
                   F.lit(modulus)) + 1).cast("int")


def content_key(*cols: str | Column) -> Column:
    """md5 of the whole content (all columns, NULL-safe), the cache key of a row."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(_c(c).cast("string"), F.lit("\u0000"))
                                         for c in cols]))


def hash_vector(text: str | Column, dim: int, salt: str = "text", eps: float = 1e-8) -> Column:
    """Deterministic pseudo-Gaussian unit vector of ``dim`` from a text.

    h = md5(salt || text) over the whole text (hashed once per row); element
    i uses g = md5(h || '#' || i): u1 = (first 8 hex + 1) / (2^32 + 1),
    u2 = (next 8 hex) / 2^32, z = sqrt(-2 ln u1) cos(2 pi u2) (Box-Muller);
    the vector is then L2-normalised with ``eps``.
    """
    h = F.md5(F.concat(F.lit(salt), _c(text).cast("string")))

    def element(hv, i):
        g = F.md5(F.concat(hv, F.lit("#"), i.cast("string")))
        u1 = (hex8_to_unit(g, 1) + F.lit(1.0)) / F.lit(TWO32 + 1.0)
        u2 = hex8_to_unit(g, 9) / F.lit(TWO32)
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)

    raw = bind(h, lambda hv: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                         lambda i: element(hv, i)))
    return F.when(_c(text).isNull(), F.lit(None).cast("array<double>")).otherwise(
        normalize(raw, eps))
