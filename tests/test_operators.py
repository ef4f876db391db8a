"""Hand-made cases for the operators."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import labels as lb, scan
from cladeframe.functions.cooccur import cooccurrence_counts
from cladeframe.operators import (
    blocks as bl, clusters as cl, features as ft, intervals as iv, membership as mb, recombination as rc, sequences as sq,
    stats as st, trees as tr,
)
from cladeframe.sources import readers as rd


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def blocks(spark, *pairs):
    data = [("A", "B", i, a, b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(data, "strain1 string, strain2 string, block_no long, seq1 string, seq2 string")


def test_interval_union(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 50, 90), ("b", 0, 5), ("b", 5, 9), ("b", 11, 12)], "k string, start long, end long")
    merged = iv.merge_intervals(df, ["k"], bucket_width=7)
    assert rows(merged) == [("a", 0, 100), ("b", 0, 9), ("b", 11, 12)]
    assert rows(iv.merge_intervals(merged, ["k"], bucket_width=3)) == rows(merged)


def test_complement(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("b", 5, 20), ("c", 0, 4)], "k string, start long, end long")
    gone = spark.createDataFrame([("a", 0, 2), ("a", 4, 6), ("b", 0, 30), ("c", 3, 9)], "k string, start long, end long")
    assert rows(iv.complement_intervals(spans, gone, ["k"], bucket_width=3)) == [("a", 2, 4), ("a", 6, 10), ("c", 0, 3)]


def test_prefix_scan_equals_plain_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"), F.hash("id").cast("long").alias("v"))
    got = scan.prefix_scan(df, ["k"], ["x"], F.floor(F.col("x") / 64), {"s": ("sum", "v"), "m": ("max", "v")}).toPandas().sort_values("x")
    plain = df.toPandas().sort_values("x")
    want = plain.groupby("k")["v"].transform(lambda s: s.cumsum().shift(fill_value=0))
    top = plain.groupby("k")["v"].transform(lambda s: s.cummax().shift())
    assert (got["s"].to_numpy() == want.to_numpy()).all()
    assert np.allclose(got["m"].to_numpy(float), top.to_numpy(float), equal_nan=True)


def test_gaps_and_parts(spark):
    b = blocks(spark, ("AC--GT-A", "ACGTGTTA"), ("----", "ACGT"))
    assert rows(sq.gap_runs(b))[0][2:] == (0, 2, 4)
    fast, general = sq.split_at_gaps(b), sq.split_by_removed_intervals(b, sq.gap_runs(b))
    assert rows(fast.select("block_no", "start", "seq1", "seq2")) == [(0, 0, "AC", "AC"), (0, 4, "GT-A", "GTTA")]
    assert rows(general.select("block_no", "start", "seq1", "seq2", "length")) == rows(fast.select("block_no", "start", "seq1", "seq2", "length"))


@pytest.mark.parametrize("a,b,want", [("AAAA", "ATAA", [(1, 1), (2, 1)]), ("AAAA", "TAAA", [(0, 1), (3, 1)]), ("AAAA", "AAAA", [(4, 1)])])
def test_identical_runs(spark, a, b, want):
    parts = sq.with_mismatches(sq.split_at_gaps(blocks(spark, (a, b))))
    assert rows(sq.identical_run_lengths(parts).select("run", "n")) == want


@pytest.mark.parametrize("size,starts", [(1800, [0, *range(500, 1201, 50), 1250]), (900, [0])])
def test_window_starts(spark, size, starts):
    parts = sq.with_mismatches(sq.split_at_gaps(blocks(spark, ("A" * size, "A" * (size - 1) + "C"))))
    w = sq.sliding_window_divergence(sq.place_parts(parts), sq.pair_divergence(parts)).orderBy("window_no").collect()
    assert [r["start"] for r in w] == starts
    assert w[-1]["mismatches"] == 1 and w[-1]["start"] + w[-1]["length"] == size


def test_windows_against_direct_count(spark):
    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("AC"), n)), "".join(rng.choice(list("AC"), n))) for n in (700, 1300, 90)]
    parts = sq.with_mismatches(sq.split_at_gaps(blocks(spark, *pairs)))
    a, b = "1".join(p[0] for p in pairs), "0".join(p[1] for p in pairs)
    for window in (500, 120, 33):
        got = sq.sliding_window_divergence(sq.place_parts(parts), sq.pair_divergence(parts), window).collect()
        for r in got:
            lo, hi = r["start"], r["start"] + r["length"]
            assert r["mismatches"] == sum(x != y for x, y in zip(a[lo:hi], b[lo:hi]))


def test_outlier_filter_drops_the_odd_stretch(spark):
    a = "A" * 30000
    b = list(a)
    for i in range(0, 30000, 500):
        b[i] = "C"
    for i in range(12000, 12400, 2):
        b[i] = "G"
    parts = sq.with_mismatches(sq.split_at_gaps(blocks(spark, (a, "".join(b)))))
    kept = rc.divergence_outlier_filter(parts)
    before, after = sq.pair_divergence(parts).first(), sq.pair_divergence(kept).first()
    assert after["divergence"] < before["divergence"] and after["aligned_length"] > 25000
    assert not any(r["start"] <= 12200 < r["start"] + r["length"] for r in kept.collect())


def test_pipeline_keeps_a_pair_without_aligned_parts(spark):
    from cladeframe.plans.alignments import PairAnalysis

    b = blocks(spark, ("----", "ACGT")).unionByName(
        spark.createDataFrame([("A", "C", 0, "ACGT" * 500, "ACGA" + "ACGT" * 499)], "strain1 string, strain2 string, block_no long, seq1 string, seq2 string")
    )
    sizes = spark.createDataFrame([("A", 2000), ("B", 2000), ("C", 2000)], "genome string, size long")
    out = {(r["strain1"], r["strain2"]): r for r in PairAnalysis(b, sizes).edges().collect()}
    assert len(out) == 2 and len(out["A", "B"]) == 18
    assert out["A", "B"]["aligned_raw"] is None and out["A", "C"]["aligned_raw"] == 2000


def test_fdr_and_skips(spark):
    df = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "feature string, pvalue double")
    q = {r["feature"]: r["qvalue"] for r in st.bh_fdr(df).collect()}
    assert q == pytest.approx({"x": 0.03, "y": 0.04, "z": 0.04})
    cells = spark.createDataFrame([(s, "all") for s in range(6)] + [(s, "some") for s in range(3)], "sample int, feature string")
    pheno = spark.createDataFrame([(s, int(s < 3)) for s in range(6)], "sample int, phenotype int")
    out = st.fisher_exact_by_feature(cells, pheno).collect()
    assert [r["feature"] for r in out] == ["some"] and out[0]["pvalue"] == pytest.approx(0.1) and out[0]["odds_ratio"] == float("inf")


def test_token_match_counts_occurrences(spark):
    ids = spark.createDataFrame([("12",), ("7",), ("a_1",)], "id string")
    names = spark.createDataFrame([("x_12",), ("12_y_12",), ("q-7",), ("a_1",)], "name string")
    got = {r["id"]: (r["sample"], r["matched_by"]) for r in mb.match_ids_exact_then_token(ids, names, "id", "name").collect()}
    assert got == {"12": (None, "missing"), "7": ("q-7", "token"), "a_1": ("a_1", "exact")}


def test_pattern_against_exact(spark):
    df = spark.createDataFrame([("3",), ("13",), ("30",)], "cluster string")
    assert mb.pattern_membership_filter(df, "cluster", ["3"]).count() == 3
    assert mb.exact_membership_filter(df, df.filter("cluster = '3'"), "cluster").count() == 1


def test_overlapping_lists_raise(spark):
    one = spark.createDataFrame([("a",)], "sample string")
    groups = spark.createDataFrame([], "sample string, grp string, priority int")
    with pytest.raises(Exception, match="full and the partial"):
        mb.sample_metadata_table(one, one, one, groups).collect()


def test_status_cuts(spark):
    df = spark.createDataFrame([(0.80,), (0.50,), (0.49,)], "c double")
    assert [r[0] for r in df.select(iv.status_from_coverage(F.col("c"), 0.8, 0.5)).collect()] == ["pos", "partial", "neg"]


def test_classify_division_by_zero(spark):
    cols = "strain1 string, strain2 string, divergence_raw double, aligned_raw double, mu_div double, mnb_div double, sim_fr double, hmm_fr double, hmm_mu double, hmm_mnb double"
    df = spark.createDataFrame([("a", "b", 0.1, 1e6, 0.0, 0.5, 10.0, 0.0, 0.2, 0.3), ("a", "c", 0.1, 1e6, 0.0, 0.0, 10.0, 5.0, 0.2, 0.3), ("a", "d", 0.1, 1e6, 0.1, 0.5, 10.0, 5.0, 0.2, 0.3)], cols)
    strict = {r["strain2"]: r for r in rc.classify_pairs(df).collect()}
    assert set(strict) == {"b", "d"} and strict["b"]["type"] == "C" and strict["b"]["total_r"] == 0.0
    assert strict["d"]["type"] == "NC" and strict["d"]["div"] == 0.1
    every = {r["strain2"]: r for r in rc.classify_pairs(df, keep_all=True).collect()}
    assert every["d"]["total_r"] == 5.0 and every["d"]["div"] == 0.1 and every["c"]["div"] == 0.1


def average_linkage(names, dist, cut):
    groups = [[n] for n in names]
    d = lambda a, b: np.mean([dist.get((min(x, y), max(x, y)), 1.0) for x in a for y in b])
    while len(groups) > 1:
        v, i, j = min((d(groups[i], groups[j]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        if v > cut:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_average_linkage_against_direct(spark):
    rng = np.random.default_rng(11)
    names = [f"s{i:02d}" for i in range(24)]
    dist = {p: float(rng.random()) for p in itertools.combinations(names, 2) if rng.random() < 0.7}
    pairs = spark.createDataFrame([(*p, v) for p, v in dist.items()], "strain1 string, strain2 string, distance double")
    strains = spark.createDataFrame([(n,) for n in names], "strain string")
    for cut in (0.35, 0.5):
        got = {}
        for r in cl.average_linkage_clusters(pairs, strains, cut).collect():
            got.setdefault(r["cluster"], []).append(r["strain"])
        assert sorted(sorted(g) for g in got.values()) == average_linkage(names, dist, cut)


EDGES = "tree_id string, node string, parent string, length double, name string"


def small_tree(spark):
    return spark.createDataFrame(
        [("t", "r", None, 0.0, None), ("t", "x", "r", 1.0, None), ("t", "y", "r", 2.0, None), ("t", "a", "x", 1.0, "a"), ("t", "b", "x", 2.0, "b"), ("t", "c", "y", 9.0, "c"), ("t", "d", "y", 1.0, "d")], EDGES)


def test_midpoint_root_keeps_distances(spark):
    edges = small_tree(spark)
    closure, tips = tr.tree_closure(edges), tr.tree_tips(edges)
    moved = tr.midpoint_root(edges, closure, tips)
    closure2, tips2 = tr.tree_closure(moved), tr.tree_tips(moved)
    d1 = {(r["tip_a"], r["tip_b"]): r["patristic"] for r in tr.tree_distances(edges, tips).collect()}
    d2 = {(r["tip_a"], r["tip_b"]): r["patristic"] for r in tr.tree_distances(moved, tips2).collect()}
    assert d2 == pytest.approx(d1)
    depth = {r["node"]: r["depth"] for r in tr.node_depths(moved).collect()}
    assert depth["c"] == pytest.approx(7.0) and depth["b"] == pytest.approx(7.0)


def test_deep_tree_closure(spark):
    n = 37
    chain = [("t", f"n{i}", f"n{i-1}" if i else None, 1.0, None) for i in range(n)] + [("t", "tip", f"n{n-1}", 1.0, "tip")]
    closure = tr.tree_closure(spark.createDataFrame(chain, EDGES))
    assert closure.count() == (n + 1) * (n + 2) // 2
    assert closure.filter("anc = 'n0' and desc = 'tip'").first()["hops"] == n


def test_ratio_without_sister_pairs_is_null(spark):
    edges = small_tree(spark)
    closure, tips = tr.tree_closure(edges), tr.tree_tips(edges)
    pairs = spark.createDataFrame([("t", "a", "b", 0.1)], "tree_id string, tip_a string, tip_b string, div double")
    out = {r["node"]: r for r in tr.clade_vs_sister_ratio(edges, closure, tips, pairs).collect()}
    assert out["x"]["div_ratio"] is None and out["x"]["inside_dist"] == 3.0 and out["x"]["sister_dist"] == pytest.approx(9.5)


def test_whole_tree_called_when_far_from_the_rest(spark):
    edges = small_tree(spark)
    closure, tips = tr.tree_closure(edges), tr.tree_tips(edges)
    pairs = spark.createDataFrame([("a", "b", 0.1), ("c", "d", 0.1), ("a", "z", 0.5)], "strain1 string, strain2 string, div double")
    ratios = tr.clade_vs_sister_ratio(edges, closure, tips, pairs.select(F.lit("t").alias("tree_id"), F.col("strain1").alias("tip_a"), F.col("strain2").alias("tip_b"), "div"))
    assert {r["tip"] for r in tr.sweep_calls(ratios, closure, tips, pairs).filter("sweep_id = 'cf'").collect()} == set("abcd")


def test_crossings(spark):
    o = lambda *p: spark.createDataFrame(list(zip("abc", p)), "tip string, position long")
    assert tr.tangle_crossings(o(1, 2, 3), o(3, 2, 1)).first()[0] == 3
    assert tr.tangle_crossings(o(1, 2, 3), o(1, 2, 3)).first()[0] == 0


def test_cooccurrence_blocks_agree(spark):
    rng = np.random.default_rng(2)
    data = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 30, 400), rng.integers(0, 50, 400))})
    cells = spark.createDataFrame(data, "item int, unit int")
    want = {}
    for (a, u), (b, v) in itertools.combinations(data, 2):
        if u == v and a != b:
            want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
    for block, chunk in ((1024, 4096), (7, 11)):
        got = {(r["item_a"], r["item_b"]): r["n_both"] for r in cooccurrence_counts(cells, "item", "unit", 30, 50, block, chunk).collect()}
        assert got == want


def test_pcoa_rebuilds_euclidean_distances(spark):
    pts = np.random.default_rng(4).normal(size=(12, 3))
    data = [(i, j, float(np.linalg.norm(pts[i] - pts[j]))) for i, j in itertools.combinations(range(12), 2)]
    out = st.pcoa(spark.createDataFrame(data, "sample_a int, sample_b int, distance double")).toPandas()
    assert sorted(out["axis"].unique()) == [1, 2, 3]
    assert out.drop_duplicates("axis")["explained"].sum() == pytest.approx(1.0)
    wide = out.pivot(index="sample", columns="axis", values="coordinate").sort_index().to_numpy()
    for i, j, d in data:
        assert np.linalg.norm(wide[i] - wide[j]) == pytest.approx(d, abs=1e-6)


def principal_axes(d: np.ndarray, axes: int):
    """Eigenvalues, explained shares and coordinates by a dense decomposition."""
    j = np.eye(len(d)) - 1 / len(d)
    values, vectors = np.linalg.eigh(-0.5 * j @ d ** 2 @ j)
    values, vectors = values[::-1], vectors[:, ::-1]
    return values[:axes], values[:axes] / values[values > 1e-10].sum(), vectors[:, :axes] * np.sqrt(values[:axes])


@pytest.mark.parametrize("basis, slack", [(1024, 1e-9), (64, 0.05)])
def test_pcoa_agrees_with_dense_decomposition(spark, basis, slack):
    """600 samples in two blocks, distances that are far from Euclidean.

    A basis of 64 is restarted, and its shares rest on the estimate of the negative eigenvalues from 16 columns.
    """
    n, rng = 600, np.random.default_rng(8)
    x = rng.normal(size=(n, 6)) * [9, 7, 5, 3, 1, 1]
    d = np.abs(x[:, None, :] - x[None, :, :]).sum(axis=2)
    i, j = np.triu_indices(n, 1)
    pairs = spark.createDataFrame(pd.DataFrame({"sample_a": i, "sample_b": j, "distance": d[i, j]}))
    out = st.pcoa(pairs, 3, basis=basis).toPandas()
    values, explained, coordinates = principal_axes(d, 3)
    per = out.drop_duplicates("axis").sort_values("axis")
    assert per["eigenvalue"].to_numpy() == pytest.approx(values, rel=1e-8)
    assert per["explained"].to_numpy() == pytest.approx(explained, rel=slack)
    wide = out.pivot(index="sample", columns="axis", values="coordinate").sort_index().to_numpy()
    assert np.abs(np.abs(wide) - np.abs(coordinates)).max() < 1e-4


def test_pcoa_small_cases(spark):
    schema = "sample_a string, sample_b string, distance double"
    assert st.pcoa(spark.createDataFrame([], schema)).count() == 0
    assert st.pcoa(spark.createDataFrame([("a", "b", 0.0)], schema)).count() == 0
    two = rows(st.pcoa(spark.createDataFrame([("a", "b", 3.0)], schema)).select("axis", "eigenvalue", "explained").distinct())
    assert two == [(1, pytest.approx(4.5), pytest.approx(1.0))]
    odd = [("a", "b", 2.0), ("a", "c", None), ("b", "c", 2.0), ("a", "a", 7.0)]
    values, explained, _ = principal_axes(np.array([[0, 2, 0], [2, 0, 2], [0, 2, 0.0]]), 1)
    got = rows(st.pcoa(spark.createDataFrame(odd, schema)).select("axis", "eigenvalue", "explained").distinct())
    assert got == [(1, pytest.approx(values[0]), pytest.approx(explained[0]))]


def test_permanova_separated_groups(spark):
    x = [0.0, 0.1, 0.2, 0.3, 5.0, 5.1, 5.2, 5.3]
    data = [(i, j, abs(x[i] - x[j])) for i, j in itertools.combinations(range(8), 2)]
    groups = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(8)], "sample int, grp string")
    r = st.permanova(spark.createDataFrame(data, "sample_a int, sample_b int, distance double"), groups, 199).first()
    assert r["r2"] > 0.99 and r["pvalue"] < 0.08


def test_permanova_against_brute_force(spark):
    rng = np.random.default_rng(6)
    points = rng.random((23, 3))
    pairs = [(f"s{i}", f"s{j}", float(np.linalg.norm(points[i] - points[j]))) for i, j in itertools.combinations(range(20), 2)]
    grps = {f"s{i}": ("g%d" % (i % 4)) for i in range(23)} | {"s3": None, "s7": "NA"}
    grouped = [*grps.items(), ("s0", "g3")]
    distances = spark.createDataFrame([*pairs, ("s1", "s1", 9.0), ("s1", "x", 5.0)], "sample_a string, sample_b string, distance double")
    groups = spark.createDataFrame(grouped, "sample string, grp string")
    names = [f"s{i}" for i in range(20) if grps[f"s{i}"] not in (None, "NA")]
    handed = sorted(names, key=lambda s: (grps[s], s))
    apart = {(x, y): v for a, b, v in pairs for x, y in ((a, b), (b, a))}

    def pseudo(label):
        n, total = len(names), sum(apart[p] ** 2 for p in itertools.combinations(names, 2)) / len(names)
        sizes = {g: sum(v == g for v in label.values()) for g in label.values()}
        within = sum(apart[x, y] ** 2 / sizes[label[x]] for x, y in itertools.combinations(names, 2) if label[x] == label[y])
        return (total - within) / (len(sizes) - 1) / (within / (n - len(sizes))), (total - within) / total

    seen, r2 = pseudo({s: grps[s] for s in names})
    reached = 0
    for r in range(1, 60):
        order = sorted(names, key=lambda s: (hashlib.md5(f"5:{r}:{s}".encode()).hexdigest(), s))
        reached += pseudo({s: grps[handed[i]] for i, s in enumerate(order)})[0] >= seen * (1 - 1e-9)
    want = (pytest.approx(seen), pytest.approx(r2), pytest.approx((reached + 1) / 60))
    for block in (4, 512):
        assert rows(st.permanova(distances, groups, 59, 5, block=block)) == [want]


def test_permanova_many_groups_and_none(spark):
    schema, group = "sample_a int, sample_b int, distance double", "sample int, grp int"
    data = [(i, j, 1.0 + (i * j) % 7) for i, j in itertools.combinations(range(160), 2)]
    label = {i: i // 2 for i in range(160)}
    total = sum(v * v for *_, v in data) / 160
    within = sum(v * v / 2 for i, j, v in data if label[i] == label[j])
    got = st.permanova(spark.createDataFrame(data, schema), spark.createDataFrame(list(label.items()), group), 3).first()
    assert got["pseudo_f"] == pytest.approx((total - within) / 79 / (within / 80)) and got["r2"] == pytest.approx((total - within) / total)
    for few in ([(0, 1), (1, 1), (2, 1)], [(0, 1), (1, 2)], []):
        assert rows(st.permanova(spark.createDataFrame(data[:500], schema), spark.createDataFrame(few, group), 3)) == [(None, None, None)]
    assert rows(st.permanova(spark.createDataFrame([], schema), spark.createDataFrame([(0, 1)], group), 3)) == [(None, None, None)]


def test_prevalence_of_any_number_of_groups(spark):
    cells = spark.createDataFrame([(i, f"f{i % 3}") for i in range(50)], "sample int, feature string")
    groups = spark.createDataFrame([(i, i % 25 if i < 48 else None) for i in range(60)], "sample int, grp int")
    got = {(r["feature"], r["grp"]): (r["n"], r["pct"], r["max_diff_pct"]) for r in ft.prevalence_by_group(cells, groups).collect()}
    sizes = collections.Counter(i % 25 for i in range(48))
    n = collections.Counter((f"f{i % 3}", i % 25) for i in range(48))
    pct = {(f"f{k}", g): 100 * n[f"f{k}", g] / sizes[g] for k in range(3) for g in range(25)}
    span = {f"f{k}": max(pct[f"f{k}", g] for g in range(25)) - min(pct[f"f{k}", g] for g in range(25)) for k in range(3)}
    assert got == {key: (n[key], pytest.approx(pct[key]), pytest.approx(span[key[0]])) for key in pct}


def test_intervals_cut_from_long_and_plain_texts(spark):
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("ACGTé"), n))
    one, two = text(5000), text(5000)
    placed = spark.createDataFrame([("a", "b", 1, 0, 5000, one, two), ("a", "b", 2, 5001, 0, "", ""), ("a", "b", 2, 5001, 700, one[:700], two[:700])],
                                   "strain1 string, strain2 string, block_no int, offset long, length long, seq1 string, seq2 string")
    spans = [(10, 11), (900, 4100), (4990, 5300), (5690, 9000), (7, 7)]
    got = rc.extract_intervals(placed, spark.createDataFrame([("a", "b", *s) for s in spans], "strain1 string, strain2 string, start long, end long"), 64)
    whole = [(0, 1, one, two), (5001, 2, one[:700], two[:700])]
    want = {(lo, hi, no, max(lo, at), x[max(lo, at) - at: hi - at], y[max(lo, at) - at: hi - at])
            for lo, hi in spans for at, no, x, y in whole if max(lo, at) < min(hi, at + len(x))}
    assert {tuple(r)[2:] for r in got.collect()} == want and got.count() == len(want)
    merged = rc.clonal_frame_consensus(got, 3).collect()
    for r in merged:
        x, y = next((q[4], q[5]) for q in want if q[0] == r["interval_start"] and q[3] == r["start"])
        pick = lambda i: ((r["start"] + i) * 1103515245 + 12345) % 2**31 // 65536 % 2
        assert r["consensus"] == "".join(b if p != b and pick(i) else p for i, (p, b) in enumerate(zip(x, y))) + "NNN"
    assert len(merged) == len(want)


def test_core_columns(spark):
    data = [("L", "a", "AC-GTN"), ("L", "b", "ACGGAN"), ("M", "a", "A"), ("M", "b", "-")]
    df = spark.createDataFrame(data, "label string, isolate string, seq string")
    table, core = bl.core_columns_and_snps(df.filter("label = 'L'"), "a")
    assert rows(table) == [("L", 6, 5, pytest.approx(5 / 6), 1)]
    assert rows(core) == [("L", "a", "ACGTN"), ("L", "b", "ACGAN")]
    assert rows(bl.drop_uninformative_columns(df).filter("label = 'L'")) == [("L", "a", "ACGT"), ("L", "b", "ACGA")]


def test_blank_levels(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 3 + ["", None, "NA"] + [f"l{i}" for i in range(9)]], "v string")
    got = [r["level"] for r in mb.collapse_levels(df, "v").collect()]
    assert got.count("a") == 3 and got.count("NA") == 3 and "Other" in got


def test_accession(spark):
    df = spark.createDataFrame([("/d/GCA_009397805.1_x.fna",), ("GCF_000123.2",)], "a string")
    assert [r[0] for r in df.select(lb.accession_short_id(F.col("a"))).collect()] == ["9397805", "123"]


def test_unknown_headers_raise_with_the_file(spark, tmp_path):
    for name, text in {"good.amrfinder.tsv": "\ufeffGene symbol\tElement type\r\nblaA\tAMR\r\n", "none.amrfinder.tsv": ""}.items():
        (tmp_path / name).write_text(text)
    assert [(r["sample"], r["feature"], r["type"]) for r in rd.scan_feature_hits(spark, str(tmp_path)).collect()] == [("good", "blaA", "AMR")]
    (tmp_path / "bad.amrfinder.tsv").write_text("Symbol\tType\nblaA\tAMR\n")
    with pytest.raises(Exception, match="unknown header.*bad.amrfinder"):
        rd.scan_feature_hits(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="unknown header"):
        rd.scan_presence_matrix(spark, str(tmp_path / "good.amrfinder.tsv")).collect()


def test_two_files_of_one_sample_raise(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.amrfinder.tsv").write_text("Gene symbol\tElement type\nblaA\tAMR\n")
    with pytest.raises(Exception, match="two files of one sample"):
        rd.scan_feature_hits(spark, str(tmp_path)).collect()


def test_sampling_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffSeq_number;facility;date\n1;"A;""b""";01.02.19\n')
    (tmp_path / "b.csv").write_text("date;Seq_number;facility\n03.04.2020;2;Gefl\u00fcgel\n;3;\n")
    got = {tuple(r) for r in rd.scan_sampling_metadata(spark, str(tmp_path)).collect()}
    assert got == {("1", 'A;"b"', 2019), ("2", "Gefl\u00fcgel", 2020), ("3", None, None)}


def test_pair_files_by_name(spark, tmp_path):
    (tmp_path / "A_@_B.maf").write_text("a score=1 mult=2\ns A.1 0 2 + 9 AC\ns B.1 0 2 + 9 AG\n\n")
    assert [tuple(r) for r in rd.scan_pair_alignments(spark, str(tmp_path)).collect()] == [("A", "B", 0, "AC", "AG")]


def test_ratio_of_one_tip_nodes_and_identical_clades(spark):
    rows = [("t", "r", None, None, None), ("t", "x", "r", 1.0, None), ("t", "a", "x", 0.0, "a"), ("t", "b", "x", 0.0, "b"), ("t", "y", "r", 1.0, None), ("t", "c", "y", 1.0, "c")]
    edges = spark.createDataFrame(rows, EDGES)
    closure, tips = tr.tree_closure(edges), tr.tree_tips(edges)
    pairs = spark.createDataFrame([("t", "a", "b", 0.0), ("t", "a", "c", 0.2)], "tree_id string, tip_a string, tip_b string, div double")
    out = {r["node"]: r for r in tr.clade_vs_sister_ratio(edges, closure, tips, pairs).collect()}
    assert out["y"]["inside_dist"] is None and out["x"]["div_ratio"] == float("inf")


def _batch_rows(spark):
    """Rows of the largest Arrow batch that a text function now gets."""
    @F.pandas_udf("int")
    def rows(seq1: pd.Series) -> pd.Series:
        return pd.Series([len(seq1)] * len(seq1))

    texts = spark.range(5000, numPartitions=1).select(F.repeat(F.lit("a"), 3000).alias("seq1"))
    return texts.select(rows("seq1").alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("use", [sq.split_at_gaps, sq.gap_runs, sq.with_mismatches])
def test_long_texts_come_in_small_batches(spark, use):
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
        use(spark.createDataFrame([("a", "b", 0, 0, 2, "AC", "AC")], "strain1 string, strain2 string, block_no long, start long, length long, seq1 string, seq2 string"))
        assert _batch_rows(spark) <= 1400
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_removed_intervals_shuffle_each_text_once(spark):
    b = spark.createDataFrame([("a", "b", 0, "ACGTACGT", "ACGTACGA"), ("a", "b", 1, "ACGT", "ACGT"), ("a", "c", 0, "AC", "AC")], "strain1 string, strain2 string, block_no long, seq1 string, seq2 string")
    cuts = spark.createDataFrame([("a", "b", 0, 1, 3), ("a", "b", 0, 2, 4), ("a", "b", 0, 4, 5), ("a", "b", 0, 7, 99), ("a", "c", 0, 0, 2), ("x", "y", 0, 0, 1)], "strain1 string, strain2 string, block_no long, start long, end long")
    out = sq.split_by_removed_intervals(b, cuts)
    assert sorted(map(tuple, out.collect())) == [("a", "b", 0, 0, "A", "A", 1), ("a", "b", 0, 5, "CG", "CG", 2), ("a", "b", 1, 0, "ACGT", "ACGT", 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 1


def test_fits_side_by_side_equal_single_ones():
    from cladeframe.operators.recombination import _fit_mixture, _fit_mixtures

    rng = np.random.default_rng(5)
    ks = [np.sort(rng.choice(200, 9, replace=False)).astype(float) for _ in range(20)]
    ns = [rng.integers(1, 30, 9).astype(float) for _ in range(20)]
    starts = [float((k * n).sum() / n.sum()) for k, n in zip(ks, ns)]
    assert _fit_mixtures(ks, ns, 500, starts) == [_fit_mixture(k, n, 500, s) for k, n, s in zip(ks, ns, starts)]


def test_hits_of_many_genomes_in_one_file(spark, tmp_path):
    line = "c1\t9\t3\t503\t+\tref\t900\t10\t510\t480\t500\t60"
    (tmp_path / "all.paf").write_text(f"g1\t{line}\ng2\t{line}\ttp:A:P\ng3\tc1\t9\n")
    out = rd.scan_paf_hits(spark, str(tmp_path), named=True)
    assert sorted(map(tuple, out.collect())) == [(g, "c1", 3, 503, 900, 10, 510) for g in ("g1", "g2")]


def test_pair_steps_take_whole_batches_like_single_rows(spark):
    rng = random.Random(31)
    text = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    rows = [("a", "b", i, text(n, "AC-"), text(n, "AC-é😀" if i % 3 else "AC-")) for i, n in enumerate([0, 1, 2, 3, *[rng.randrange(200) for _ in range(60)], 0])]
    blocks = spark.createDataFrame(rows, "strain1 string, strain2 string, block_no long, seq1 string, seq2 string").coalesce(2)
    parts = sq.split_at_gaps(blocks)
    got = {(r["block_no"], r["start"], r["seq1"], r["seq2"], r["length"]) for r in parts.collect()}
    assert got == {(r[2], p["start"], p["seq1"], p["seq2"], len(p["seq1"])) for r in rows for p in sq._gap_free_row(r[3], r[4])}
    both = parts.withColumn("mism", sq.mismatch_offsets("seq1", "seq2")).collect()
    assert all(r["mism"] == [i for i, (x, y) in enumerate(zip(r["seq1"], r["seq2"])) if x != y] for r in both)
    placed = sq.place_parts(sq.with_mismatches(parts))
    bins = {}
    for r in placed.collect():
        for at in [r["offset"] + m for m in r["mism"]] + [r["offset"] - 1] * (r["offset"] > 0):
            bins[at // 50] = bins.get(at // 50, 0) + 1
    assert {r["bin"]: r["n"] for r in sq._bins(placed, 50).collect()} == bins
    plan = sq._bins(placed, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan, "mismatches are counted on their part's row and not shuffled one by one"


def test_outlier_windows_of_a_batch_like_single_parts(spark):
    rng = random.Random(32)
    rows = []
    for n in [1, 40, 100, 101, 149, 150, 151, *[rng.randrange(1, 900) for _ in range(60)]]:
        dense = rng.randrange(n)
        mism = sorted({i for i in range(n) if rng.random() < (0.3 if dense <= i < dense + 120 else 0.01)})
        rows.append((n, mism, 100, rng.choice([0, 4, 12]), 40, 0.02))
    df = spark.createDataFrame(rows, "length long, mism array<int>, window long, cutoff long, n_windows long, divergence double").coalesce(1)
    got = df.select("length", "mism", "cutoff", rc._keep("length", "mism", "window", "cutoff", "n_windows", "divergence").alias("kept")).collect()
    for (size, m, w, cutoff, n, div), r in zip(rows, got):
        full = max(0, -(-(size - w) // 50)) if m else 0
        out = set()
        for s in range(0, 50 * full, 50):
            if sum(s <= x < s + w for x in m) >= cutoff:
                out |= set(range(s, s + w))
        tail = 50 * full
        if m and tail < size and sum(x >= tail for x in m) >= rc.binomial_quantile(1 - 0.05 / np.array([n]), np.array([size - tail]), np.array([div]))[0]:
            out |= set(range(tail, size))
        left = [i for i in range(size) if i not in out]
        assert [i for k in r["kept"] for i in range(k["start"], k["start"] + k["length"])] == left
        assert [k["start"] + i for k in r["kept"] for i in k["mism"]] == [x for x in m if x not in out]
