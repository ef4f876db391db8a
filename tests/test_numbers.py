"""Spark-free helpers against exact small calculations."""

import itertools
import math

import numpy as np
import pytest

from cladeframe.functions import distributions as d
from cladeframe.operators.recombination import _fit_mixture, _null_sums, spectrum_ssd
from cladeframe.sources.readers import newick_edges


def test_log_gamma_matches_math():
    x = np.array([0.3, 1, 2, 2.5, 7.7, 15.9, 16, 17, 40.5, 1e4, 1e7])
    assert np.allclose(d.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)


def test_binomial_quantile_by_definition():
    for n, p, q in itertools.product((1, 5, 40), (0.01, 0.3, 0.9), (0.5, 0.95, 1 - 0.05 / 7)):
        cdf, k = 0.0, -1
        while cdf < q - 1e-13 and k < n:
            k += 1
            cdf += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        assert d.binomial_quantile(q, n, p) == k


def test_fisher_small_tables():
    assert d.fisher_two_sided(3, 0, 0, 3) == pytest.approx(0.1)
    for a, b, c, e in itertools.product(range(4), repeat=4):
        n, r1, c1 = a + b + c + e, a + b, a + c
        prob = lambda k: math.comb(r1, k) * math.comb(n - r1, c1 - k) / math.comb(n, c1)
        ks = range(max(0, c1 - (n - r1)), min(r1, c1) + 1)
        want = sum(prob(k) for k in ks if prob(k) <= prob(a) * (1 + 1e-7))
        assert d.fisher_two_sided(a, b, c, e) == pytest.approx(want)


def test_spectrum_ssd_against_direct_sum():
    rng = np.random.default_rng(3)
    for size, div in ((200, 0.2), (3000, 0.004), (500, 0.9)):
        runs = rng.integers(0, size // 4, 9)
        values, counts = np.unique(runs, return_counts=True)
        mass = np.zeros(size)
        for r in runs:
            mass[r] += r
        curve = 1 - np.cumsum(mass) / runs.sum()
        w = np.arange(size)
        want = ((curve - np.exp(-div * w) * (div * w + 1)) ** 2).sum()
        assert spectrum_ssd(values, counts, size, div)[0] == pytest.approx(want, rel=1e-9)


def test_mixture_recovers_components():
    rng = np.random.default_rng(5)
    p = 3 / (3 + 30)
    data = np.concatenate([rng.poisson(2.0, 7000), rng.negative_binomial(3, p, 3000)])
    k, n = np.unique(data, return_counts=True)
    mu, mnb, size, fc, converged = _fit_mixture(k.astype(float), n.astype(float), 500, data.mean())
    assert converged
    assert mu == pytest.approx(2.0, abs=0.15) and mnb == pytest.approx(30, rel=0.1)
    assert size == pytest.approx(3, abs=0.6) and fc == pytest.approx(70, abs=3)


def test_mixture_is_the_best_of_a_grid():
    rng = np.random.default_rng(8)
    for mean, other, share in ((0.5, 12.0, 0.6), (3.0, 25.0, 0.9), (1.0, 6.0, 0.3)):
        data = np.where(rng.random(600) < share, rng.poisson(mean, 600), rng.negative_binomial(4, 4 / (4 + other), 600))
        k, n = np.unique(data, return_counts=True)
        likelihood = lambda t: (n * np.log(d.poisson_pmf(k, t[0]) * t[3] + d.neg_binomial_pmf(k, t[2], t[1]) * (100 - t[3]) + 1e-32)).sum()
        *found, converged = _fit_mixture(k.astype(float), n.astype(float), 500, data.mean())
        grid = itertools.product(np.linspace(0.1, 6, 7), np.linspace(1, 40, 7), (2, 4, 10), np.linspace(5, 95, 7))
        assert converged and likelihood(found) >= max(map(likelihood, grid)) - 1e-6


def test_mixture_that_does_not_settle_says_so():
    k, n = np.array([0.0, 1, 5, 30]), np.array([50.0, 20, 6, 3])
    assert _fit_mixture(k, n, 500, 2.0, rounds=1)[-1] is False and _fit_mixture(k, n, 500, 2.0)[-1] is True
    # one value only, at either end of the box
    assert _fit_mixture(np.array([0.0]), np.array([9.0]), 500, 0.0)[-1] is True
    assert _fit_mixture(np.array([400.0]), np.array([9.0]), 500, 400.0)[:2] == (50.0, 500 / 3)


def test_incomplete_beta_and_binomial_tails():
    for n, p in ((7, 0.3), (200, 0.02), (5000, 0.7)):
        logs = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)])
        assert d.binomial_cdf(np.arange(n + 1), n, p) == pytest.approx(np.cumsum(np.exp(logs)), abs=1e-10)
    assert list(d.incomplete_beta([0.0, 1.0, 0.5], 2.0, 2.0)) == pytest.approx([0.0, 1.0, 0.5])
    # far beyond what a walk along the distribution could do
    n, p = 10**7, 1e-3
    k = int(d.binomial_quantile(0.975, n, p))
    assert abs(k - (n * p + 1.959964 * math.sqrt(n * p))) < 3 and d.binomial_cdf(k - 1, n, p) < 0.975 <= d.binomial_cdf(k, n, p)
    assert list(d.binomial_quantile([0.5, 0.5, 0.5], [0, 9, 9], [0.5, 0.0, 1.0])) == [0, 0, 9]


def test_fisher_wide_tables_by_both_tails():
    rng = np.random.default_rng(2)
    tables = np.concatenate([rng.integers(0, 400, (60, 4)), np.c_[rng.integers(0, 6, (60, 1)), rng.integers(0, 900, (60, 3))]])
    for got, (a, b, c, e) in zip(d.fisher_two_sided(*tables.T), tables.tolist()):
        n, r1, c1 = a + b + c + e, a + b, a + c
        ways = {k: math.comb(r1, k) * math.comb(n - r1, c1 - k) for k in range(max(0, c1 - (n - r1)), min(r1, c1) + 1)}
        want = sum(w for w in ways.values() if w * 10**7 <= ways[a] * (10**7 + 1)) / math.comb(n, c1)
        assert got == pytest.approx(want, rel=1e-8)


def test_null_curve_sums_are_closed():
    for size, div in ((2000, 0.01), (5, 1.5), (400000, 3e-5)):
        w = np.arange(size)
        curve = np.exp(-div * w) * (div * w + 1)
        ends = np.array([0, 1, size // 3, size])
        for got, values in zip(_null_sums(ends, div), (curve, curve**2)):
            assert got == pytest.approx(np.concatenate([[0], np.cumsum(values)])[ends], rel=1e-9, abs=1e-9)


def test_newick_numbers_inner_nodes():
    rows = list(newick_edges("t", "((a:1,'b c':2)x:0.5,(d:3,e:4):1.5);"))
    assert ("t", "b c", "node1", 2.0, "b c", None, None) in rows and ("t", "d", "node4", 3.0, "d", None, None) in rows
    assert ("t", "node1", "node0", 0.5, None, "x", None) in rows
    assert [r for r in rows if r[2] is None] == [("t", "node0", None, None, None, None, None)]


def test_newick_repeated_supports_stay_apart():
    rows = list(newick_edges("t", "((a:1,b:1)100:1,(c:1,d:1)100:1);"))
    assert {r[1]: r[2] for r in rows} == {"node0": None, "node1": "node0", "a": "node1", "b": "node1", "node4": "node0", "c": "node4", "d": "node4"}
    assert [r[6] for r in rows if r[5] == "100"] == [100.0, 100.0]


def test_newick_several_trees_comments_and_odd_names():
    rows = list(newick_edges("f", "[a;b](out_node1:1[c],'it''s':2); \n(x,x,)r;y;", "out_"))
    assert [r[:3] for r in rows] == [
        ("f#1", "_node0", None), ("f#1", "node1", "_node0"), ("f#1", "it's", "_node0"),
        ("f#2", "node0", None), ("f#2", "node1", "node0"), ("f#2", "node2", "node0"), ("f#2", "node3", "node0"), ("f#3", "y", None),
    ]
    assert [r[4] for r in rows[4:7]] == ["x", "x", None] and list(newick_edges("f", " ; ")) == []
    for broken in ("((a,b);", "(a,b));"):
        with pytest.raises(ValueError, match="tree f"):
            list(newick_edges("f", broken))
