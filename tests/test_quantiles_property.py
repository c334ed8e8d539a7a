"""Property test: exact_quantiles equals the textbook definitions on random
groups (duplicates, single values, NULLs), for both quantile kinds."""

from __future__ import annotations

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vitrine.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.2, 0.5, 0.8, 1.0]
NAMES = ["a", "b", "c", "d", "e"]


def _cont(values: list[float], p: float) -> float:
    v = sorted(values)
    pos = p * (len(v) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or v[lo] == v[hi]:
        return v[lo]
    return (hi - pos) * v[lo] + (pos - lo) * v[hi]


def _disc(values: list[float], p: float) -> float:
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


rows_strategy = st.lists(
    st.tuples(
        st.sampled_from(["x", "y", "z"]),
        st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e3, 1e3, allow_nan=False)),
    ),
    min_size=1,
    max_size=60,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, discrete=st.booleans())
def test_matches_definition(spark, rows, discrete):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {
        r.g: tuple(r[n] for n in NAMES)
        for r in exact_quantiles(df, "v", PROBS, NAMES, ["g"], discrete=discrete, sketch_k=16).collect()
    }
    groups: dict[str, list[float]] = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    ref = _disc if discrete else _cont
    expected = {g: tuple(ref(vs, p) for p in PROBS) for g, vs in groups.items()}
    assert got.keys() == expected.keys()
    for g in expected:
        for a, b in zip(got[g], expected[g]):
            assert math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9), (g, got[g], expected[g])
