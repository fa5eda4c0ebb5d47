"""Property tests (hypothesis) of the pure NumPy kernels used inside Arrow tasks."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecbench.functions.slerp import slerp_np
from vecbench.operators.search import _select_topk


@settings(max_examples=60, deadline=None)
@given(nq=st.integers(1, 6), nc=st.integers(1, 30), k=st.integers(1, 35), seed=st.integers(0, 10_000),
       levels=st.integers(1, 4), mask=st.booleans())
def test_select_topk_equals_full_sort(nq, nc, k, seed, levels, mask):
    rng = np.random.default_rng(seed)
    S = rng.integers(0, levels, size=(nq, nc)).astype(float) / levels    # many exact ties
    if mask:
        S[np.arange(nq), rng.integers(0, nc, size=nq)] = -np.inf
    r, c, rank = _select_topk(S, k)
    for i in range(nq):
        cand = [(-round(S[i, j], 9), j) for j in range(nc) if np.isfinite(S[i, j])]
        exp = [j for _, j in sorted(cand)[:k]]
        got = list(c[r == i])
        assert got == exp
        assert list(rank[r == i]) == list(range(1, len(exp) + 1))


@settings(max_examples=60, deadline=None)
@given(d=st.integers(2, 16), t=st.floats(0.0, 1.0), seed=st.integers(0, 10_000))
def test_slerp_invariants(d, t, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((1, d)), rng.standard_normal((1, d))
    out = slerp_np(a, b, t)
    ua, ub = a / (np.linalg.norm(a) + 1e-8), b / (np.linalg.norm(b) + 1e-8)
    assert np.allclose(slerp_np(a, b, 0.0), ua) and np.allclose(slerp_np(a, b, 1.0), ub)
    dot = float((ua @ ub.T)[0, 0])
    if abs(dot) < 0.999:      # away from the antiparallel/linear corner, the result is a unit vector
        assert abs(np.linalg.norm(out) - 1.0) < 1e-6
    if 0.0 < t < 1.0 and dot > 0:
        # on the short arc between the two: closer to each endpoint than they are to each other
        # (tolerance covers the 1e-8 epsilon of the normalisations)
        assert float(out @ ua.T) >= dot - 1e-7 and float(out @ ub.T) >= dot - 1e-7
