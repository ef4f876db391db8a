"""Group tests and distance statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladeframe.functions.cooccur import cooccurrence_counts
from cladeframe.functions.distributions import fisher_p, normal_upper_tail
from cladeframe.functions.eigen import BLOCK, centred_spectrum, square_blocks
from cladeframe.functions.lineage import cut
from cladeframe.functions.selection import ranked_differences
from cladeframe.functions.scan import double_bucket, exact_percentiles, prefix_scan, range_bucket, row_index, sorted_index


def fisher_exact_by_feature(cells: DataFrame, phenotype: DataFrame) -> DataFrame:
    """2x2 counts, percentages, odds ratio and two-sided p per variable feature.

    ``cells`` (sample, feature) distinct; ``phenotype`` (sample, phenotype), where any
    value but 1 is negative. Samples without a phenotype are left out.
    """
    positive = F.col("phenotype") == 1
    totals = phenotype.agg(F.struct(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")))
    t = totals.scalar()
    counts = cells.join(phenotype, "sample").groupBy("feature").agg(
        F.count_if(positive).alias("a"), F.count_if(~positive).alias("b")
    )
    table = counts.withColumn("t", t).select(
        "feature", "a", "b", (F.col("t.pos") - F.col("a")).alias("c"), (F.col("t.neg") - F.col("b")).alias("d")
    ).filter("c + d > 0")
    # Many features share a table, so the test runs once per distinct one.
    tests = table.select("a", "b", "c", "d").distinct().withColumn("pvalue", fisher_p("a", "b", "c", "d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    odds = F.when((b == 0) | (c == 0), F.when((a == 0) | (d == 0), F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    return table.join(tests, ["a", "b", "c", "d"]).select(
        "feature", "a", "b", "c", "d",
        F.try_divide(100 * a, a + c).alias("pct_pos"), F.try_divide(100 * b, b + d).alias("pct_neg"),
        odds.otherwise(F.try_divide(a * d, b * c)).alias("odds_ratio"), "pvalue",
    )


def bh_fdr(df: DataFrame, p: str = "pvalue", q: str = "qvalue") -> DataFrame:
    """Benjamini–Hochberg q-values.

    Tied p-values share a q, so ranks run over distinct values with counts; both
    passes use bucketed scans, not one global sort. The tests are written out once, since
    they are read for the values, the number and the result.
    """
    df = cut(df)
    distinct = df.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = distinct.withColumn("slot", double_bucket("p"))
    ranked = prefix_scan(placed, [], ["p"], "slot", {"rank": ("sum", "n")}, inclusive=True)
    raw = ranked.withColumn("raw", F.col("p") * total / F.col("rank"))
    low = prefix_scan(raw, [], ["p"], "slot", {"low": ("min", "raw")}, inclusive=True, descending=True)
    lookup = low.select(F.col("p").alias(p), F.least("low", F.lit(1.0)).alias(q))
    return df.join(lookup, p)


def significance_counts(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many features pass before and after correction."""
    return df.agg(
        F.count(F.lit(1)).alias("n_tested"),
        F.count_if(F.col("pvalue") < alpha).alias("n_raw"),
        F.count_if(F.col("qvalue") < alpha).alias("n_fdr"),
    )


def chi_square_cramers_v(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square and Cramér's V of a two-way table, from its non-empty cells."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = n.groupBy(row).agg(F.sum("n").alias("r"))
    c = n.groupBy(column).agg(F.sum("n").alias("c"))
    full = n.join(r, row).join(c, column)
    out = full.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"),
        F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("cols"),
    )
    chi = F.col("n") * (F.col("s") - 1)
    return out.select(
        F.col("n").cast("long").alias("n"), chi.alias("chi_square"),
        F.sqrt(F.try_divide(chi, F.col("n") * (F.least("rows", "cols") - 1))).alias("cramers_v"),
    )


def _two_group_histogram(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    return df.filter(F.col(group).isin(first, second)).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2")
    )


def _value_bucket(hist: DataFrame) -> Column:
    return range_bucket(hist, F.col("v"))


def rank_sum_test(
    df: DataFrame, value: str, group: str, first: str, second: str, z: float = 1.959963984540054,
    pair_limit: int = 1_000_000,
) -> DataFrame:
    """Wilcoxon W of ``first``, two-sided normal p (tie and continuity corrected), shift and CI.

    Everything comes from the histogram of values. The Hodges–Lehmann shift and its bounds
    are differences of given rank, found by bisection over both histograms, so measures
    may be continuous; ``pair_limit`` only says when the rest is listed. A missing group
    gives nulls.
    """
    hist = cut(_two_group_histogram(df, value, group, first, second).filter("v IS NOT NULL"))
    scan = prefix_scan(hist, [], ["v"], _value_bucket(hist), {"below": ("sum", F.col("n1") + F.col("n2"))})
    t = (F.col("n1") + F.col("n2")).cast("double")
    mid = F.col("below") + (t + 1) / 2
    core = scan.agg(
        F.sum("n1").cast("double").alias("n1"), F.sum("n2").cast("double").alias("n2"),
        F.sum(F.col("n1") * mid).alias("r1"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    w = F.col("r1") - n1 * (n1 + 1) / 2
    dev = w - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    stat = core.select(
        n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), w.alias("w"),
        F.try_divide(dev - F.signum(dev) * 0.5, sigma).alias("z"),
    ).withColumn("pvalue", F.least(F.lit(1.0), 2 * normal_upper_tail(F.abs("z"))))

    stat = cut(stat)
    sizes = stat.first()
    a, b = sizes["n1"] or 0, sizes["n2"] or 0
    found = [None] * 4
    if a and b:
        rank = max(1, math.floor(a * b / 2 - z * math.sqrt(a * b * (a + b + 1) / 12)))
        found = ranked_differences(hist, [(a * b + 1) // 2, (a * b + 2) // 2, rank, a * b + 1 - rank], pair_limit)
    middle = None if found[0] is None else (found[0] + found[1]) / 2
    at = lambda x, name: F.lit(x).cast("double").alias(name)
    return stat.select("n1", "n2", "w", "z", "pvalue", at(middle, "shift"), at(found[2], "ci_low"), at(found[3], "ci_high"))


def ks_two_sample(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Largest gap of the two empirical distributions and its asymptotic two-sided p."""
    hist = _two_group_histogram(df, value, group, first, second)
    scan = prefix_scan(
        hist, [], ["v"], _value_bucket(hist), {"c1": ("sum", "n1"), "c2": ("sum", "n2")}, inclusive=True
    )
    sizes = hist.agg(F.struct(F.sum("n1").cast("double").alias("n1"), F.sum("n2").cast("double").alias("n2"))).scalar()
    gap = F.abs(F.col("c1") / F.col("t.n1") - F.col("c2") / F.col("t.n2"))
    out = scan.withColumn("t", sizes).agg(
        F.max(gap).alias("d"), F.first("t.n1").alias("n1"), F.first("t.n2").alias("n2")
    )
    lam = F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("lam") * F.col("lam"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + term(k))
    return out.withColumn("lam", lam).select(
        F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "d",
        F.when(F.col("lam") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))).alias("pvalue"),
    )


def group_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """min, quartiles, mean and max per group."""
    v = F.col(value).cast("double")
    plain = df.groupBy(group).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    quartiles = exact_percentiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.join(quartiles, group).select(group, "n", "min", "q1", "median", "mean", "q3", "max")


def phi_cooccurrence(cells: DataFrame, roster: DataFrame, min_genomes: int = 5, max_features: int = 80) -> DataFrame:
    """Phi correlation of the (at most 80) most frequent variable features, for a < b.

    The limit belongs to the report: the most prevalent features are compared.
    """
    n_samples = roster.agg(F.count_distinct("sample")).first()[0]
    counts = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    keep = counts.filter((F.col("n") >= min_genomes) & (F.col("n") <= n_samples - min_genomes)).orderBy(
        F.desc("n"), "feature"
    ).limit(max_features)
    # at most max_features rows, so a broadcast of it is bounded
    chosen = cells.join(F.broadcast(keep.select("feature")), "feature", "left_semi")
    both = cooccurrence_counts(chosen, "feature", "sample", max_features, n_samples)
    left = keep.select(F.col("feature").alias("a"), F.col("n").alias("na"))
    right = keep.select(F.col("feature").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, F.col("a") < F.col("b"))
    total = F.lit(float(n_samples))
    n11 = F.coalesce("n_both", F.lit(0)).cast("double")
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    phi = F.try_divide(total * n11 - na * nb, F.sqrt(na * (total - na) * nb * (total - nb)))
    return pairs.join(both, (F.col("a") == F.col("item_a")) & (F.col("b") == F.col("item_b")), "left").select(
        F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), n11.cast("long").alias("n_both"),
        F.coalesce(phi, F.lit(0.0)).alias("phi"),
    )


def jaccard_distance(cells: DataFrame, roster: DataFrame) -> DataFrame:
    """Jaccard distance of every sample pair a < b on the variable features.

    Two empty profiles are at distance 0. The result is the square table itself, so
    its size is that of the answer; counting it goes through blocked products.
    """
    n_samples = roster.agg(F.count_distinct("sample")).first()[0]
    cells = cut(cells)
    counts = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    variable = counts.filter(F.col("n") < n_samples)
    used = cells.join(variable.select("feature"), "feature", "left_semi")
    n_features = variable.count()
    both = cooccurrence_counts(used, "sample", "feature", n_samples, n_features)
    per = roster.select("sample").distinct().join(
        used.groupBy("sample").agg(F.count(F.lit(1)).alias("n")), "sample", "left"
    ).select("sample", F.coalesce("n", F.lit(0)).alias("n"))
    left = per.select(F.col("sample").alias("sample_a"), F.col("n").alias("na"))
    right = per.select(F.col("sample").alias("sample_b"), F.col("n").alias("nb"))
    pairs = left.join(right, F.col("sample_a") < F.col("sample_b"))
    joined = pairs.join(
        both.select(F.col("item_a").alias("sample_a"), F.col("item_b").alias("sample_b"), "n_both"),
        ["sample_a", "sample_b"], "left",
    )
    shared = F.coalesce("n_both", F.lit(0))
    union = F.col("na") + F.col("nb") - shared
    return joined.select(
        "sample_a", "sample_b", F.when(union == 0, 0.0).otherwise(1 - shared / union).alias("distance")
    )


def pcoa(
    distances: DataFrame, n_axes: int = 5, a: str = "sample_a", b: str = "sample_b", basis: int = 1024
) -> DataFrame:
    """Principal coordinates (sample, axis, coordinate, eigenvalue, explained) of a distance table.

    Every pair stands in the table once; a pair that is missing or null is at distance 0. Axes are those of
    eigenvalues above 1e-10 (and above 1e-9 of the largest, the noise), each sign such that the largest entry is
    positive. The squared distances stay in blocks on the executors and are multiplied with a few columns at a
    time (``functions/eigen.py``), so the roster has no bound but the size of the distance table. ``explained``
    is the share of the sum of positive eigenvalues: exact up to ``basis`` samples and for Euclidean
    distances of any number, elsewhere with the negative eigenvalues' part of that sum estimated.
    """
    pairs = cut(distances.select(F.col(a).alias("i"), F.col(b).alias("j"), (F.col("distance") ** 2).alias("v")))
    ids = pairs.select("i").union(pairs.select("j")).distinct()
    ids = cut(prefix_scan(ids, [], ["i"], F.lit(0), {"k": ("sum", F.lit(1).cast("long"))})).select(
        F.col("i").alias("sample"), "k")
    n = ids.count()
    spark = distances.sparkSession
    out = f"sample {ids.schema['sample'].dataType.simpleString()}, axis int, coordinate double, eigenvalue double, explained double"
    if n < 2:
        return spark.createDataFrame([], out)
    at = lambda c: ids.select(F.col("sample").alias(c), F.col("k").alias(f"k{c}"))
    cells = pairs.filter("i != j").join(at("i"), "i").join(at("j"), "j").select(F.col("ki").alias("i"), F.col("kj").alias("j"), "v")
    trace = (pairs.filter("i != j").agg(F.sum("v")).first()[0] or 0.0) / n
    found = centred_spectrum(square_blocks(cells, n), n, -0.5, trace, n_axes, basis=basis)
    values = found.values
    axes = int((values > max(1e-10, 1e-9 * values.max(initial=0.0))).sum())
    if not axes:
        return spark.createDataFrame([], out)
    width = len(values)

    def unpack(batches):
        for pdf in batches:
            for block, raw in zip(pdf["b"], pdf["y"]):
                y = np.frombuffer(raw).reshape(-1, width)[:, :axes]
                k = np.arange(len(y)) + block * BLOCK
                yield pd.DataFrame({"k": np.repeat(k, axes), "axis": np.tile(np.arange(1, axes + 1), len(y)), "u": y.ravel()})

    entries = cut(found.vectors.mapInPandas(unpack, "k long, axis int, u double"))
    share = [(i + 1, float(v), float(v / found.positive)) for i, v in enumerate(values[:axes])]
    lead = entries.groupBy("axis").agg(F.max_by("u", F.struct(F.round(F.abs("u"), 9), -F.col("k"))).alias("lead")).join(
        spark.createDataFrame(share, "axis int, eigenvalue double, explained double"), "axis")
    # one row an axis
    return entries.join(F.broadcast(lead), "axis").join(ids, "k").select(
        "sample", "axis", (F.signum("lead") * F.col("u") * F.sqrt("eigenvalue")).alias("coordinate"), "eigenvalue", "explained")


def pcoa_markers(coords: DataFrame, groups: DataFrame, digits: int = 6) -> DataFrame:
    """Samples sharing a position on the first two axes and a group, counted once."""
    flat = coords.groupBy("sample").agg(
        F.max(F.when(F.col("axis") == 1, F.round("coordinate", digits))).alias("pco1"),
        F.max(F.when(F.col("axis") == 2, F.round("coordinate", digits))).alias("pco2"),
    )
    return flat.join(groups, "sample").groupBy("pco1", "pco2", "grp").agg(F.count(F.lit(1)).alias("n"))


def permanova(
    distances: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 1,
    a: str = "sample_a", b: str = "sample_b", missing: Sequence[str] = ("NA",), block: int = 512,
) -> DataFrame:
    """Pseudo-F, R² and permutation p of a one-way grouping; one row a pair of samples in ``distances``.

    Only samples with a distance and a group count: null groups and those named in ``missing`` are left out, of several
    groups of a sample the smallest stays. Fewer than three samples or a single group give one row of nulls. Replicate r
    orders the samples by md5 of "seed:r:sample" and hands out the sorted labels in that order, by a bucketed scan;
    replicate 0 is the observed labelling. Samples fall into blocks of about ``block``: the labels of a block go once
    to each of its pairs of blocks, where label and distance matrices are multiplied. The number of groups is free.
    """
    there = distances.select(F.col(a).alias("sample")).union(distances.select(F.col(b).alias("sample"))).distinct()
    known = groups.filter(F.col("grp").isNotNull() & ~F.col("grp").cast("string").isin(*missing))
    g = known.join(there, "sample", "left_semi").groupBy("sample").agg(F.min("grp").alias("grp"))
    slots = sorted_index(g, ["grp", "sample"], "slot")
    # a label is its group's first slot and size in one number
    sizes = slots.groupBy("grp").agg((F.min("slot") * (1 << 32) + F.count(F.lit(1))).alias("label"))
    slots = cut(slots.join(sizes, "grp").select("slot", "sample", "label"))
    n, n_groups = slots.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n < 3 or n_groups < 2:
        none = F.lit(None).cast("double")
        return distances.sparkSession.range(1).select(none.alias("pseudo_f"), none.alias("r2"), none.alias("pvalue"))
    spread = slots.select("sample", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("r")).withColumn(
        "h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("sample").cast("string")).cast("binary")))
    slice_ = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    ranked = row_index(spread, ["r"], ["h", "sample"], slice_, "slot")
    shuffled = ranked.select("sample", "r", "slot").join(slots.select("slot", "label"), "slot").select("sample", "r", "label")
    observed = slots.select("sample", F.lit(0).alias("r"), "label")
    labels = shuffled.unionByName(observed).groupBy("sample").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda s: s["label"]).alias("labels")
    )
    n_blocks = math.ceil(n / block)
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    pairs = distances.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("distance") ** 2).alias("d2")).filter("a <> b").withColumn(
        "at", home("a")).withColumn("other", home("b")).select(
        F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"),
        F.when(F.col("at") <= F.col("other"), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(F.col("at") <= F.col("other"), F.col("b")).otherwise(F.col("a")).alias("b"), "d2")
    sides = labels.withColumn("home", home("sample")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), "home", "sample", "labels")
    reps = permutations + 1

    def products(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        rows, cols = right[right["home"] == lo], right[right["home"] == hi]
        if not (len(left) and len(rows) and len(cols)):
            return pd.DataFrame({"within": [], "total": []})
        i, j = pd.Index(rows["sample"]).get_indexer(left["a"]), pd.Index(cols["sample"]).get_indexer(left["b"])
        # pairs of samples without a group are no part of the test
        used = (i >= 0) & (j >= 0)
        d = np.zeros((len(rows), len(cols)))
        np.add.at(d, (i[used], j[used]), left["d2"].fillna(0.0).to_numpy()[used])
        la, lb = np.stack(rows["labels"].to_numpy()), np.stack(cols["labels"].to_numpy())
        members = (1 << 32) - 1
        shared = np.intersect1d(la, lb)
        within = np.zeros(reps)
        if len(shared) <= 64:
            for v in shared:
                within += ((d @ (lb == v).astype(float)) * (la == v)).sum(axis=0) / (int(v) & members)
        else:
            for r in range(reps):
                within[r] = ((d * (la[:, r, None] == lb[None, :, r])).sum(axis=1) / (la[:, r] & members)).sum()
        return pd.DataFrame({"within": [within.tolist()], "total": [float(d.sum())]})

    sums = cut(pairs.groupBy("lo", "hi").cogroup(sides.groupBy("lo", "hi")).applyInPandas(products, "within array<double>, total double"))
    total = sums.agg(F.sum("total")).scalar()
    per = sums.select(F.posexplode("within").alias("r", "w")).groupBy("r").agg(F.sum("w").alias("w"))
    stat = per.withColumn("t", total / n).withColumn(
        "f", F.try_divide((F.col("t") - F.col("w")) / (n_groups - 1), F.try_divide(F.col("w"), F.lit(n - n_groups)))
    )
    seen = stat.filter("r = 0").agg(F.first("f")).scalar()
    # replicates that hand out the observed groups differ from them by rounding only
    reached = F.count_if((F.col("r") > 0) & (F.col("f") >= F.col("f0") * (1 - 1e-9)))
    return stat.withColumn("f0", seen).agg(
        F.first("f0").alias("pseudo_f"),
        F.max(F.when(F.col("r") == 0, F.try_divide(F.col("t") - F.col("w"), F.col("t")))).alias("r2"),
        F.when(F.first("f0").isNotNull(), (reached + 1) / (permutations + 1)).alias("pvalue"),
    )


def density_histogram(df: DataFrame, value: str, source: str, bins: int = 30) -> DataFrame:
    """Density histogram per source on one shared range; bins are centred on the minimum."""
    span = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    placed = df.withColumn("s", span).withColumn("width", (F.col("s.hi") - F.col("s.lo")) / (bins - 1)).select(
        source, "width", F.col("s.lo").alias("lo"),
        F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("s.lo"), F.col("width")) + 0.5), F.lit(0)).alias("bin"),
    )
    n = placed.groupBy(source, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("width").alias("width"), F.first("lo").alias("lo")
    )
    return n.select(
        source, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("center"), "n",
        F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(source)) * F.col("width")).alias("density"),
    )


def kernel_density(df: DataFrame, value: str, source: str, points: int = 512) -> DataFrame:
    """Gaussian density per source on a shared grid; bandwidth 0.9·min(sd, IQR/1.34)·n^-0.2.

    Values are first shared linearly between their two grid points, so the smoothing
    works on at most ``points`` weights per source whatever the row count.
    """
    v = F.col(value).cast("double")
    span = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    spread = df.groupBy(source).agg(F.stddev_samp(v).alias("sd")).join(
        exact_percentiles(df, [source], value, {"q1": 0.25, "q3": 0.75}), source
    )
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    narrow = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    bw = spread.select(source, "n", (0.9 * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    step = (span["hi"] - span["lo"]) / (points - 1)
    at = df.select(source, span["lo"].alias("lo"), step.alias("step"), ((v - span["lo"]) / step).alias("x"))
    low = F.least(F.floor("x"), F.lit(points - 2))
    shared = at.select(
        source, "lo", "step",
        F.inline(F.array(
            F.struct(low.alias("k"), (1 - (F.col("x") - low)).alias("w")),
            F.struct((low + 1).alias("k"), (F.col("x") - low).alias("w")),
        )),
    ).groupBy(source, "k").agg(F.sum("w").alias("w"), F.first("lo").alias("lo"), F.first("step").alias("step"))
    grid = shared.join(bw, source).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("g") - F.col("k")) * F.col("step") / F.col("bw")
    return grid.groupBy(source, "g").agg(
        F.first(F.col("lo") + F.col("g") * F.col("step")).alias("x"),
        F.sum(F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"),
    ).select(source, F.col("g").alias("point"), "x", "density")
