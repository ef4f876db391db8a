"""Ranked differences and the rank-sum shift against plain sorting."""

import random

import pytest

from cladeframe.functions import selection as sl
from cladeframe.operators import stats as st


def hist_of(spark, first, second):
    values = sorted({*first, *second})
    return spark.createDataFrame([(float(v), first.count(v), second.count(v)) for v in values], "v double, n1 long, n2 long")


def test_ordinals_follow_doubles():
    values = [float("-inf"), -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 1.0, 2.0, 1e300, float("inf")]
    assert sorted(values, key=sl._ordinal) == values and [sl._double(sl._ordinal(v)) for v in values] == values
    assert sl._ordinal(-0.0) == sl._ordinal(0.0) == 0


@pytest.mark.parametrize("kind", ["years", "real", "wide", "single"])
def test_ranked_differences(spark, kind):
    rng = random.Random(kind)
    draw = {"years": lambda: float(rng.randrange(1990, 2005)), "real": lambda: rng.uniform(-3, 3), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-4, 8), "single": lambda: 4.0}[kind]
    first, second = [draw() for _ in range(60)], [draw() for _ in range(45)]
    diffs = sorted(a - b for a in first for b in second)
    ranks = [1, 2, len(diffs) // 3, (len(diffs) + 1) // 2, len(diffs)]
    hist = hist_of(spark, first, second)
    want = [diffs[r - 1] for r in ranks]
    for limit in (10**6, 1) if kind == "real" else (1,):
        assert sl.ranked_differences(hist, ranks, pair_limit=limit, fan=63) == pytest.approx(want, rel=1e-12, abs=max(map(abs, first + second)) * 2.0**-50)


def test_rank_sum_of_a_continuous_measure(spark):
    rng = random.Random(5)
    data = [("a", rng.gauss(1.5, 1)) for _ in range(80)] + [("b", rng.gauss(0, 1)) for _ in range(70)] + [("a", None), ("c", 99.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = st.rank_sum_test(df, "v", "g", "a", "b", pair_limit=10).first()
    diffs = sorted(x - y for g, x in data[:80] for h, y in data[80:150])
    assert (got["n1"], got["n2"], got["w"]) == (80, 70, sum(d > 0 for d in diffs))
    assert got["shift"] == pytest.approx((diffs[2799] + diffs[2800]) / 2) and got["ci_low"] < got["shift"] < got["ci_high"] and got["pvalue"] < 1e-6
    none = st.rank_sum_test(df, "v", "g", "a", "nobody").first()
    assert none["n2"] == 0 and none["shift"] is None
