"""Most likely paths and trained transitions against plain searches."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions.paths import best_paths
from cladeframe.operators import recombination as rc

INF = float("-inf")


def plain_path(emit, start, move):
    """Viterbi search; the lower state wins ties at the end and at every step back."""
    weight, back = [start[j] + emit[0][j] for j in range(len(start))], []
    for e in emit[1:]:
        back.append([max(range(len(start)), key=lambda i: (weight[i] + move[i][j], -i)) for j in range(len(start))])
        weight = [weight[back[-1][j]] + move[back[-1][j]][j] + e[j] for j in range(len(start))]
    path = [max(range(len(start)), key=lambda j: (weight[j], -j))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def chains_of(spark, chains):
    data = [(n, i, e, start, [x for r in move for x in r]) for n, (emit, start, move) in enumerate(chains) for i, e in enumerate(emit)]
    return spark.createDataFrame(data, "k long, at long, emit array<double>, start array<double>, move array<double>").repartition(3)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_best_paths_against_plain_search(spark, bucket):
    rng = random.Random(3)
    log = lambda: math.log(rng.random())
    chains = []
    for states, size in ((2, 1), (2, 2), (2, 7), (2, 200), (3, 50), (3, 64)):
        chains.append(([[log() for _ in range(states)] for _ in range(size)], [log() for _ in range(states)], [[log() for _ in range(states)] for _ in range(states)]))
    chains.append(([[0.0, 0.0]] * 9, [0.0, 0.0], [[0.0, 0.0], [0.0, 0.0]]))  # all paths alike
    chains.append(([[-1.0, -2.0], [-9.0, -1.0], [-1.0, -3.0], [-8.0, -1.0]], [INF, 0.0], [[0.0, INF], [-1.0, -1.0]]))  # no way back from state 0
    got = {}
    for r in best_paths(chains_of(spark, chains), ["k"], "at", bucket=bucket).collect():
        got.setdefault(r["k"], {})[r["at"]] = r["state"]
    for n, chain in enumerate(chains):
        assert [got[n][i] for i in range(len(chain[0]))] == plain_path(*chain)


def test_short_chain_is_the_best_of_all_paths(spark):
    rng = random.Random(8)
    emit = [[math.log(rng.random()) for _ in range(2)] for _ in range(9)]
    start, move = [math.log(0.3), math.log(0.7)], [[math.log(0.9), math.log(0.1)], [math.log(0.4), math.log(0.6)]]
    weight = lambda p: start[p[0]] + emit[0][p[0]] + sum(move[p[i - 1]][p[i]] + emit[i][p[i]] for i in range(1, 9))
    best = max(itertools.product((0, 1), repeat=9), key=weight)
    got = [r["state"] for r in best_paths(chains_of(spark, [(emit, start, move)]), ["k"], "at", bucket=2).orderBy("at").collect()]
    assert tuple(got) == best


WINDOWS = "strain1 string, strain2 string, window_no long, start long, length long, divergence double"
FIT = "strain1 string, strain2 string, mu double, mnb double, nb_size double, fc double"


def true_states():
    return np.random.default_rng(6).integers(0, 2, (3, 40)).repeat(25, axis=1)


@pytest.fixture(scope="module")
def windows(spark):
    rng, data = np.random.default_rng(5), []
    for pair, state in enumerate(true_states()):
        k = np.where(state == 0, rng.poisson(2, 1000), rng.poisson(14, 1000))
        data += [("a", f"b{pair}", i, 50 * i, 500, float(x) / 500) for i, x in enumerate(k)]
    return spark.createDataFrame(data, WINDOWS)


@pytest.fixture(scope="module")
def fit(spark):
    return spark.createDataFrame([("a", f"b{i}", 2.0, 14.0, 8.0, 60.0) for i in range(3)] + [("a", "none", 0.0, 0.0, 1.0, 100.0)], FIT)


def test_even_transitions_agree_with_the_scan(spark, windows, fit):
    alone = rc.segment_states(windows, fit)
    even = fit.withColumn("move", F.array(*[F.log(F.lit(0.5))] * 4))
    scanned = rc.segment_states(windows, even)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, scanned.collect()))


def test_training_joins_broken_stretches(spark, windows, fit):
    flips = lambda df: df.join(df.select("strain2", (F.col("window_no") - 1).alias("window_no"), F.col("state").alias("n")), ["strain2", "window_no"]).filter("state <> n").count()
    trained = rc.train_segment_states(windows, fit)
    alone = rc.segment_states(windows, fit)
    assert trained.count() == windows.count() == 3000
    true = int((np.diff(true_states(), axis=1) != 0).sum())
    assert abs(flips(trained) - true) < abs(flips(alone) - true) / 4
    # a fixed point: labelling again with the shares of the labels changes nothing
    again = rc.segment_states(windows, fit.join(rc.transition_shares(trained), ["strain1", "strain2"]))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, trained.collect()))


def test_transition_shares(spark):
    data = [("a", "b", i, 50 * i, 500, 0.0, s) for i, s in enumerate("CCRRRC")]
    got = rc.transition_shares(spark.createDataFrame(data, WINDOWS + ", state string"), prior=1.0).first()["move"]
    assert np.allclose(np.exp(got), [2 / 4, 2 / 4, 2 / 5, 3 / 5])
    assert rc.transition_shares(spark.createDataFrame(data[:0], WINDOWS + ", state string")).count() == 0
