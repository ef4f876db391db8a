"""Length bias, outlier filtering, mixture fits and recombined intervals per genome pair."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cladeframe.functions.batches import bounded_batches, small_batches
from cladeframe.functions.distributions import binomial_quantile, log_gamma
from cladeframe.functions.lineage import cut
from cladeframe.functions.paths import best_paths
from cladeframe.operators.intervals import complement_intervals, merge_intervals
from cladeframe.operators.sequences import PAIR, as_lists, flat_lists, pair_divergence

_KEPT = T.ArrayType(
    T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("mism", T.ArrayType(T.IntegerType()))
)


def _null_sums(ends: np.ndarray, div: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the null curve exp(-div·w)·(div·w + 1) and of its square over the widths below each end.

    Both are sums of w^j·q^w for j up to 2, which have closed forms, so a pair costs its distinct runs whatever
    its length.
    """
    n = ends.astype(float)

    def series(rate):
        q, rest = np.exp(-rate), -np.expm1(-rate)
        last, gone = np.exp(-rate * n), -np.expm1(-rate * n)
        flat = gone / rest
        return flat, (q * flat - n * last) / rest, (q * (1 + q) * flat / rest - 2 * n * q * last / rest - n * n * last) / rest

    s0, s1, _ = series(div)
    t0, t1, t2 = series(2 * div)
    return s0 + div * s1, t0 + 2 * div * t1 + div * div * t2


def spectrum_ssd(runs: np.ndarray, counts: np.ndarray, size: int, div: float) -> np.ndarray:
    """Squared gap between observed and null run spectra, one value per row of ``counts``.

    The observed curve is constant between distinct run lengths, so the sum over all
    widths 0 … size-1 splits into one term per distinct length.
    """
    order = np.argsort(runs)
    runs, counts = runs[order].astype(np.int64), np.atleast_2d(counts)[:, order].astype(float)
    first, second = _null_sums(np.append(runs, size), div)
    lengths = np.diff(np.concatenate([[0], runs, [size]])).astype(float)
    d1, d2 = np.diff(np.concatenate([[0.0], first])), np.diff(np.concatenate([[0.0], second]))
    mass = counts * runs
    norm = mass.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        left = 1.0 - np.cumsum(mass, axis=1) / norm
    level = np.concatenate([np.ones((len(counts), 1)), left], axis=1)
    return (level**2 * lengths - 2 * level * d1 + d2).sum(axis=1)


@F.pandas_udf(T.DoubleType())
def _ssd(runs: pd.Series, counts: pd.Series, size: pd.Series, div: pd.Series) -> pd.Series:
    return pd.Series(
        [float(spectrum_ssd(np.asarray(r), np.asarray(c), int(s), d)[0]) if d > 0 else None
         for r, c, s, d in zip(runs, counts, size, div)], dtype=float,
    )


def _histograms(runs: DataFrame, totals: DataFrame) -> DataFrame:
    # distinct run lengths of a pair add up to at most its length: at most sqrt(2·length) entries
    small_batches(runs.sparkSession)
    packed = runs.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("run", "n"))).alias("h"))
    return totals.join(packed, PAIR).select(
        *PAIR, "aligned_length", "divergence", F.col("h.run").alias("runs"), F.col("h.n").alias("counts")
    )


def run_spectrum_ssd(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Observed length bias per pair; null where the pair has no mismatch."""
    value = _ssd("runs", "counts", "aligned_length", "divergence")
    return _histograms(runs, totals).select(*PAIR, F.nanvl(value, F.lit(None).cast("double")).alias("ssd"))


def ssd_bootstrap_ci(
    runs: DataFrame, totals: DataFrame, replicates: int = 200, low: float = 0.5, high: float = 99.5, seed: int = 1
) -> DataFrame:
    """Percentiles of the length bias over resamples of the runs.

    Drawing n runs with replacement is one multinomial draw on the histogram. The seed
    comes from the pair's names, so a retried task repeats its draws.
    """

    @F.pandas_udf("struct<ssd_low:double,ssd_high:double>")
    def boot(s1: pd.Series, s2: pd.Series, runs: pd.Series, counts: pd.Series, size: pd.Series, div: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, r, c, s, d in zip(s1, s2, runs, counts, size, div):
            if not d > 0:
                out.append((None, None))
                continue
            rng = np.random.default_rng([seed, zlib.crc32(f"{a}\0{b}".encode())])
            c = np.asarray(c)
            draws = rng.multinomial(int(c.sum()), c / c.sum(), size=replicates)
            ssd = spectrum_ssd(np.asarray(r), draws, int(s), d)
            out.append(tuple(np.nanpercentile(ssd, [low, high])) if not np.isnan(ssd).all() else (None, None))
        return pd.DataFrame(out, columns=["ssd_low", "ssd_high"]).astype(float)

    args = (*PAIR, "runs", "counts", "aligned_length", "divergence")
    return _histograms(runs, totals).withColumn("ci", boot(*args)).select(
        *PAIR,
        F.nanvl("ci.ssd_low", F.lit(None).cast("double")).alias("ssd_low"),
        F.nanvl("ci.ssd_high", F.lit(None).cast("double")).alias("ssd_high"),
    )


@F.pandas_udf(T.LongType())
def _cutoff(n_windows: pd.Series, window: pd.Series, div: pd.Series) -> pd.Series:
    return pd.Series(binomial_quantile(1 - 0.05 / n_windows, window, div))


@F.arrow_udf(_KEPT)
def _keep(length: pa.Array, mism: pa.Array, window: pa.Array, cutoff: pa.Array, n_windows: pa.Array, div: pa.Array) -> pa.Array:
    """Stretches of every part outside its windows with too many mismatches; all parts of a batch at once.

    Parts lie one after the other with a place between them, so a window's mismatches are found by two searches.
    """
    size, w, c, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, window, cutoff, n_windows))
    at, counts = flat_lists(mism)
    has = counts > 0
    base = np.cumsum(size + 1) - size - 1
    at += np.repeat(base, counts)
    n_full = np.where(has, np.maximum(0, -(-(size - w) // 50)), 0)
    # the last stretch of every part, shorter than a window, has a cut of its own
    tail = 50 * n_full
    tested = np.flatnonzero(has & (tail < size))
    rest_cut = binomial_quantile(1 - 0.05 / n[tested], (size - tail)[tested], div.to_numpy(zero_copy_only=False)[tested])
    tested = tested[np.cumsum(counts)[tested] - np.searchsorted(at, (base + tail)[tested]) >= rest_cut]
    row = np.repeat(np.arange(len(size)), n_full)
    low = base[row] + 50 * (np.arange(len(row)) - np.repeat(np.cumsum(n_full) - n_full, n_full))
    seen = np.searchsorted(at, low + w[row]) - np.searchsorted(at, low) >= c[row]
    # ends of windows grow with their starts, so a stretch runs from the window before it, or its part's start
    end = base + size
    row = np.r_[row[seen], tested, np.arange(len(size))]
    high = np.r_[low[seen] + w[row[:seen.sum()]], end[tested], end]
    low = np.r_[low[seen], (base + tail)[tested], end]
    order = np.argsort(low, kind="stable")
    row, low, high = row[order], low[order], high[order]
    since = np.where(np.r_[True, row[1:] != row[:-1]][:len(row)], base[row], np.r_[0, high[:-1]][:len(row)])
    kept = low > since
    row, low, since = row[kept], low[kept], since[kept]
    first = np.searchsorted(at, since)
    many = np.searchsorted(at, low) - first
    ends = np.cumsum(many)
    inside = at[np.repeat(first - ends + many, many) + np.arange(many.sum())] - np.repeat(since, many)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(inside.astype(np.int32)))
    return as_lists(np.bincount(row, minlength=len(size)), start=since - base[row], length=low - since, mism=lists)


def divergence_outlier_filter(parts: DataFrame, filtering_snp: float = 1.0, min_block: int = 0, epsilon: float = 1e-6) -> DataFrame:
    """Take windows with too many mismatches out of the parts, until a pass removes next to nothing.

    Window length is 1/divergence within 100 … 10,000, the cut is the binomial
    1 − 0.05/windows quantile. Only pairs that still shrink go into the next pass; the
    loop asks the driver for one yes/no per pass. A part is treated on its own row.
    """
    small_batches(parts.sparkSession)
    state = cut(parts.select(*PAIR, "block_no", "start", "length", "mism"))
    previous = pair_divergence(state).select(*PAIR, (F.col("aligned_length") * 2).alias("old"))
    finished = []
    while True:
        stats = pair_divergence(state).join(
            state.groupBy(*PAIR).agg(F.sum(F.floor(F.col("length") / 50) + 1).alias("n_windows")), PAIR
        ).join(previous, PAIR)
        open_ = (F.col("old") - F.col("aligned_length") > F.col("old") * epsilon) & (F.col("divergence") > 0)
        stats = cut(stats.withColumn("active", open_))
        active = stats.filter("active")
        if active.isEmpty():
            finished.append(state)
            break
        finished.append(state.join(stats.filter("not active"), PAIR, "left_semi"))
        window = F.least(F.greatest(F.floor(filtering_snp / F.col("divergence")), F.lit(100)), F.lit(10000))
        tests = active.withColumn("window", window).withColumn("cutoff", _cutoff("n_windows", "window", "divergence"))
        kept = state.join(tests.select(*PAIR, "n_windows", "divergence", "window", "cutoff"), PAIR).select(
            *PAIR, "block_no", F.col("start").alias("base"),
            F.inline(_keep("length", "mism", "window", "cutoff", "n_windows", "divergence")),
        )
        state = cut(
            kept.select(*PAIR, "block_no", (F.col("base") + F.col("start")).alias("start"), "length", "mism")
            .filter(F.col("length") > min_block)
        )
        previous = active.select(*PAIR, F.col("aligned_length").alias("old"))
    return reduce(DataFrame.unionByName, finished)


#: Entries of the histograms that are fitted side by side.
SIDE_BY_SIDE = 1 << 13


@lru_cache(maxsize=4)
def _rising(window: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid of sizes, and by count and size the gamma term of the second component."""
    grid = np.linspace(2.0, 10.0, 129)
    counts = np.arange(max(window, top) + 1.0)
    return grid, log_gamma(counts[:, None] + grid[None, :]) - log_gamma(grid)[None, :]


def _fit_mixtures(
    ks: Sequence[np.ndarray], ns: Sequence[np.ndarray], window: int, starts: Sequence[float], rounds: int = 2000
) -> list[tuple[float, float, float, float, bool]]:
    """Poisson + negative-binomial mixtures of counts within box bounds: (mu, mnb, size, fc, converged) of each pair.

    EM with squared extrapolation: two plain steps give a direction and its change, a long step along them is kept
    where the likelihood ends above the plain one's; how long it may be grows by steps of four, so that the first ones do
    not leave the start's optimum. The means of an M-step are weighted means; the size is the top of a parabola over
    a grid whose gamma terms are computed once. Bounds and start are those of the method. Converged means that a round
    raised the likelihood by next to nothing and its plain steps moved no parameter by 1e-4 of its interval. Pairs take
    their rounds together and leave when they are done. Their histograms are equally long, so sums run in the order that
    they have for one pair, and a pair's fit does not depend on the others.
    """
    # Parameter bounds for Poisson mean, other mean, size and Poisson share (%).
    low, high = np.array([1e-5, 1e-5, 2.0, 0.1]), np.array([window / 10, window / 3, 10.0, 99.9])
    box = lambda theta: np.clip(theta, low, high)
    if not len(ks):
        return []
    k_all, n_all = np.array(ks, float), np.array(ns, float)
    grid, table = _rising(window, int(k_all.max()))
    rising_all = np.ascontiguousarray(table.T[:, k_all.astype(np.int64)].transpose(1, 0, 2))
    factorial_all = log_gamma(k_all + 1)

    def step(theta, rows):
        """The likelihoods of ``theta`` and the parameters after one round of EM."""
        k, n, factorial = k_all[rows], n_all[rows], factorial_all[rows]
        mu, mnb, size, fc = (theta[:, [i]] for i in range(4))
        p = size / (size + mnb)
        other = log_gamma(k + size) - log_gamma(size) - factorial + size * np.log(p) + k * np.log1p(-p)
        a, b = np.exp(k * np.log(mu) - mu - factorial) * fc, np.exp(other) * (100 - fc)
        r = a / (a + b + 1e-300) * n
        s = n - r
        r_sum, s_sum, s_k = r.sum(1), s.sum(1), (s * k).sum(1)
        fc = 100 * r_sum / n.sum(1)
        mu, mnb = (r * k).sum(1) / np.maximum(r_sum, 1e-300), s_k / np.maximum(s_sum, 1e-300)
        mnb = np.clip(mnb, low[1], high[1])
        q = grid / (grid + mnb[:, None])
        weighted = np.stack([rising_all[row] @ weight for row, weight in zip(rows, s)])
        score = weighted + s_sum[:, None] * grid * np.log(q) + s_k[:, None] * np.log1p(-q)
        top = np.clip(np.argmax(score, axis=1), 1, len(grid) - 2)
        left, middle, right = (np.take_along_axis(score, top[:, None] + d, 1)[:, 0] for d in (-1, 0, 1))
        curve = left - 2 * middle + right
        bent = curve < 0
        shift = np.where(bent, 0.5 * (left - right) / np.where(bent, curve, 1.0), np.sign(right - left))
        size = grid[top] + np.clip(shift, -1.0, 1.0) * (grid[1] - grid[0])
        return (n * np.log(a + b + 1e-32)).sum(1), box(np.stack([mu, mnb, size, fc], 1))

    begin = np.asarray(starts, float)
    theta = box(np.stack([begin, 2 * begin, np.full(len(ks), 2.0), np.full(len(ks), 50.0)], 1))
    out: list = [None] * len(ks)
    rows, reach = np.arange(len(ks)), np.ones(len(ks))
    like, one = step(theta, rows)
    for _ in range(rounds):
        _, two = step(one, rows)
        plain, after = step(two, rows)
        best, gained, following = two.copy(), plain.copy(), after.copy()
        first, change = (one - theta) / (high - low), (two - 2 * one + theta) / (high - low)
        bend = np.sqrt((change**2).sum(1))
        far = np.where(bend > 0, np.minimum(np.sqrt((first**2).sum(1)) / np.where(bend > 0, bend, 1.0), reach), 0.0)
        long = np.flatnonzero(far > 1)
        if len(long):
            f = far[long, None]
            _, jump = step(box(theta[long] + (high - low) * (2 * f * first[long] + f * f * change[long])), rows[long])
            there, beyond = step(jump, rows[long])
            better = there > plain[long]
            kept, lost = long[better], long[~better]
            best[kept], gained[kept], following[kept] = jump[better], there[better], beyond[better]
            lost = lost[far[lost] == reach[lost]]
            reach[lost] = np.maximum(1.0, reach[lost] / 4)
        reach = np.where(far == reach, reach * 4, reach)
        moved = (np.maximum(np.abs(one - theta), np.abs(after - two)) / (high - low)).max(1)
        done = (moved < 1e-4) & (gained - like <= 1e-9 * np.maximum(1.0, np.abs(like)))
        for i in np.flatnonzero(done):
            out[rows[i]] = (*map(float, best[i]), bool(np.isfinite(gained[i])))
        on = ~done
        rows, reach, theta, like, one = rows[on], reach[on], best[on], gained[on], following[on]
        if not len(rows):
            return out
    for i, row in enumerate(rows):
        out[row] = (*map(float, theta[i]), False)
    return out


def _alike(sizes: Sequence[int], items: Sequence[int]) -> Iterator[list[int]]:
    """The items in groups of one size, each of a bounded number of entries."""
    by_size: dict[int, list[int]] = {}
    for size, item in zip(sizes, items):
        by_size.setdefault(size, []).append(item)
    for size, group in by_size.items():
        most = max(1, SIDE_BY_SIDE // max(1, size))
        yield from (group[at:at + most] for at in range(0, len(group), most))


def _fit_mixture(k: np.ndarray, n: np.ndarray, window: int, start: float, rounds: int = 2000) -> tuple[float, float, float, float, bool]:
    """The mixture of one pair."""
    return _fit_mixtures([k], [n], window, [start], rounds)[0]


#: What a pair without a fit gets for the two means, the size and the Poisson share.
UNFITTED = (0.0, 0.0, 1.0, 100.0)


def mixture_fit(windows: DataFrame, starts: DataFrame, fractions: DataFrame, window: int = 500, min_fraction: float = 0.3) -> DataFrame:
    """Fit the two-component count model per pair: (mu, mnb, nb_size, fc, converged).

    ``windows`` are those before outlier filtering, ``starts`` (pair, mean_div) the mean
    window divergence after it, ``fractions`` (pair, aligned_fraction). Window counts are
    reduced to a histogram of at most ``window`` + step entries per pair first. Pairs
    aligned over less than ``min_fraction`` are not fitted and get (0, 0, 1, 100) and a null flag; a fit that does
    not converge is dropped for the same values and a false flag.
    """
    bounded_batches(windows.sparkSession, 8192, "4m")  # short histograms: more pairs of one size in a batch
    scaled = F.col("divergence") * window
    whole = F.round(scaled)
    hist = windows.filter(F.abs(scaled - whole) < 1e-6).groupBy(*PAIR, whole.cast("long").alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    packed = hist.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("h"))

    @F.pandas_udf("struct<mu:double,mnb:double,nb_size:double,fc:double,converged:boolean>")
    def fit(ks: pd.Series, ns: pd.Series, mean_div: pd.Series, fraction: pd.Series) -> pd.DataFrame:
        rows = [(*UNFITTED, None)] * len(ks)
        wanted = [i for i, (k, f) in enumerate(zip(ks, fraction)) if k is not None and f >= min_fraction]
        for some in _alike([len(ks.iloc[i]) for i in wanted], wanted):
            found = _fit_mixtures([np.asarray(ks.iloc[i], float) for i in some], [np.asarray(ns.iloc[i], float) for i in some],
                                  window, [float(mean_div.iloc[i]) * window for i in some])
            for i, got in zip(some, found):
                rows[i] = got if got[-1] else (*UNFITTED, False)
        return pd.DataFrame(rows, columns=["mu", "mnb", "nb_size", "fc", "converged"])

    joined = fractions.join(starts, PAIR).join(packed, PAIR, "left")
    fitted = joined.withColumn("f", fit(F.col("h.k"), F.col("h.n"), "mean_div", "aligned_fraction"))
    return fitted.select(*PAIR, "f.mu", "f.mnb", "f.nb_size", "f.fc", "f.converged")


@F.pandas_udf(T.StructType().add("c", T.DoubleType()).add("r", T.DoubleType()))
def _emissions(count: pd.Series, mu: pd.Series, mnb: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Log weight of a window's count under either component."""
    k = count.to_numpy(float)
    m, b, s = mu.to_numpy(float), mnb.to_numpy(float), size.to_numpy(float)
    p = s / (s + b)
    clonal = k * np.log(m) - m - log_gamma(k + 1)
    recombined = log_gamma(k + s) - log_gamma(s) - log_gamma(k + 1) + s * np.log(p) + k * np.log1p(-p)
    return pd.DataFrame({"c": clonal, "r": recombined})


def _log(share) -> Column:
    """Logarithm of a share; of none it is minus infinity."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.when(share > 0, F.log(share)).otherwise(F.lit(float("-inf")))


#: Transition shares of the method: from clonal and from recombined windows, either to clonal and recombined ones.
EVEN = ((0.5, 0.5), (0.5, 0.5))


def segment_states(windows: DataFrame, fit: DataFrame, window: int = 500, transitions: Sequence[Sequence[float]] = EVEN) -> DataFrame:
    """Label every window clonal (C) or recombined (R) on the most likely path under the fitted emissions.

    ``transitions`` are the shares from C and from R to C and R; a column ``move`` of ``fit`` (log shares, row by row)
    gives each pair its own. Where all are equal the path is the more likely state of each window, only the first
    one also weighing the start shares, and windows are labelled alone. Ties are clonal; pairs without a fit are left
    out.
    """
    small_batches(windows.sparkSession)
    counts = windows.withColumn("k", F.round(F.col("divergence") * window))
    means = counts.groupBy(*PAIR).agg(F.avg("k").alias("mean_k"))
    used = fit.filter("mu <> 0").join(means, PAIR).withColumn(
        "mu", F.when(F.col("mu") <= 1.1e-5, F.greatest(F.col("mean_k"), F.lit(1e-12))).otherwise(F.col("mu"))
    )
    scored = counts.join(used, PAIR).withColumn("e", _emissions("k", "mu", "mnb", "nb_size"))
    named = lambda c: F.when(c, "C").otherwise("R").alias("state")
    flat = [float(x) for row in transitions for x in row]
    if len(set(flat)) == 1 and "move" not in fit.columns:
        first = lambda share: F.when(F.col("window_no") == 0, _log(share)).otherwise(0.0)
        clonal = F.col("e.c") + first(F.col("fc") / 100) >= F.col("e.r") + first(1 - F.col("fc") / 100)
        return scored.select(*PAIR, "window_no", "start", "length", "divergence", named(clonal))
    move = F.col("move") if "move" in fit.columns else F.array(*[_log(x) for x in flat])
    chains = scored.select(
        *PAIR, "window_no", F.array("e.c", "e.r").alias("emit"), F.array(_log(F.col("fc") / 100), _log(1 - F.col("fc") / 100)).alias("start"), move.alias("move"))
    paths = best_paths(chains, PAIR, "window_no")
    return windows.join(paths, [*PAIR, "window_no"]).select(*PAIR, "window_no", "start", "length", "divergence", named(F.col("state") == 0))


def transition_shares(states: DataFrame, prior: float = 1.0) -> DataFrame:
    """(pair, move): log shares from C and R to C and R, counted on labelled windows with ``prior`` added to each."""
    after = states.select(*PAIR, (F.col("window_no") - 1).alias("window_no"), F.col("state").alias("next"))
    seen = states.join(after, [*PAIR, "window_no"], "left").groupBy(*PAIR).agg(*[
        (F.count_if((F.col("state") == a) & (F.col("next") == b)) + prior).alias(a + b) for a in "CR" for b in "CR"])
    return seen.select(*PAIR, F.array(*[_log(F.try_divide(F.col(a + b), F.col(a + "C") + F.col(a + "R"))) for a in "CR" for b in "CR"]).alias("move"))


def train_segment_states(windows: DataFrame, fit: DataFrame, window: int = 500, rounds: int = 20, prior: float = 1.0) -> DataFrame:
    """States by Viterbi training of the transitions: label, count transitions per pair, label again.

    Starts from equal transitions and ends when no pair changes, after ``rounds`` rounds at the latest; the likelihood
    never falls, so the labels settle after few. Pairs that are settled leave the loop.
    """
    states = cut(segment_states(windows, fit, window))
    done, open_ = [], states
    for _ in range(rounds):
        moves = cut(transition_shares(open_, prior))
        again = cut(segment_states(windows.join(moves.select(*PAIR), PAIR, "left_semi"), fit.join(moves, PAIR), window))
        other = again.select(*PAIR, "window_no", F.col("state").alias("now"))
        moved = cut(open_.join(other, [*PAIR, "window_no"]).filter("state <> now").select(*PAIR).distinct())
        done.append(again.join(moved, PAIR, "left_anti"))
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_ = cut(again.join(moved, PAIR, "left_semi"))
    return reduce(DataFrame.unionByName, [*done, open_])


def state_summary(states: DataFrame) -> DataFrame:
    """Recombined share (%) and mean divergence of each state, per pair."""
    r = F.col("state") == "R"
    return states.groupBy(*PAIR).agg(
        (100 * F.avg(r.cast("double"))).alias("hmm_fr"),
        F.avg(F.when(~r, F.col("divergence"))).alias("hmm_mu"), F.avg(F.when(r, F.col("divergence"))).alias("hmm_mnb"),
    )


def state_intervals(states: DataFrame, state: str = "R") -> DataFrame:
    """Windows of one state merged to intervals of the concatenated alignment, by their true starts."""
    rows = states.filter(F.col("state") == state).select(*PAIR, "start", (F.col("start") + F.col("length")).alias("end"))
    return merge_intervals(rows, PAIR, bucket_width=1 << 17)


def extract_intervals(placed: DataFrame, intervals: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Aligned text inside the intervals, one row per (interval, part); join markers fall out.

    ``placed`` needs seq1, seq2, offset, length, one row a part. Coordinates of both sides are cut into position bins,
    so the overlap join is an equi-join and every overlap is met once, in its first bin. The texts stay out of it: a
    part's overlaps come to its one row as an array, and each text is shuffled once.
    """
    def bins(lo, hi):
        return F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))

    iv = intervals.filter("start < end").select(
        *PAIR, F.col("start").alias("i0"), F.col("end").alias("i1"), bins(F.col("start"), F.col("end")).alias("bin")
    )
    stop = F.col("offset") + F.col("length")
    pt = placed.filter("length > 0").select(
        *PAIR, "block_no", F.col("offset").alias("p0"), stop.alias("p1"), bins(F.col("offset"), stop).alias("bin")
    )
    lo, hi = F.greatest("i0", "p0"), F.least("i1", "p1")
    hit = iv.join(pt, [*PAIR, "bin"]).filter((lo < hi) & (F.col("bin") == F.floor(lo / width)))
    at = [*PAIR, "block_no", "p0"]
    cuts = hit.groupBy(*at).agg(F.collect_list(F.struct("i0", "i1", lo.alias("lo"), hi.alias("hi"))).alias("cuts"))
    texts = placed.filter("length > 0").select(*PAIR, "block_no", F.col("offset").alias("p0"), "seq1", "seq2").join(cuts, at)
    each = texts.select(*at, "seq1", "seq2", F.inline("cuts"))
    first, size = (F.col("lo") - F.col("p0") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")
    return each.select(
        *PAIR, F.col("i0").alias("interval_start"), F.col("i1").alias("interval_end"), "block_no", F.col("lo").alias("start"),
        F.substring(F.col("seq1"), first, size).alias("seq1"), F.substring(F.col("seq2"), first, size).alias("seq2"),
    )


def clonal_frame(placed: DataFrame, totals: DataFrame, intervals: DataFrame, margin: int = 500) -> DataFrame:
    """Aligned text outside the recombined intervals widened by one window on both sides.

    Pairs without any interval have no clonal frame.
    """
    wide = intervals.select(*PAIR, F.greatest(F.col("start") - margin, F.lit(0)).alias("start"), (F.col("end") + margin).alias("end"))
    spans = totals.join(intervals.select(*PAIR).distinct(), PAIR, "left_semi").select(
        *PAIR, F.lit(0).cast("long").alias("start"), F.col("aligned_length").alias("end")
    )
    return extract_intervals(placed, complement_intervals(spans, wide, PAIR, bucket_width=1 << 17))


@F.pandas_udf(T.StringType())
def _either(seq1: pd.Series, seq2: pd.Series, start: pd.Series) -> pd.Series:
    """The two texts with one of the two letters where they differ, picked by an arithmetic hash of the position."""
    out = []
    for one, two, at in zip(seq1, seq2, start):
        a, b = (np.frombuffer(text.encode("utf-32-le"), dtype="<u4") for text in (one, two))
        # Multiplier, increment and modulus of the hash.
        h = ((int(at) % (1 << 31) + np.arange(len(a))) * 1103515245 + 12345) % (1 << 31)
        out.append(np.where((a == b) | (h // 65536 % 2 == 0), a, b).astype("<u4").tobytes().decode("utf-32-le"))
    return pd.Series(out, dtype=object)


def clonal_frame_consensus(frame: DataFrame, spacer: int = 500) -> DataFrame:
    """One consensus text per clonal piece, followed by an N spacer.

    Where the two bases differ, a fixed arithmetic hash of the position picks one of them,
    so that a re-run gives the same text. Pieces follow each other by ``start``.
    """
    small_batches(frame.sparkSession)
    text = _either("seq1", "seq2", "start")
    return frame.select(*PAIR, "interval_start", "start", F.concat(text, F.lit("N" * spacer)).alias("consensus"))


def classify_pairs(stats: DataFrame, keep_all: bool = False) -> DataFrame:
    """Recombined share, divergence and type of every pair.

    Strict (default) keeps pairs with a clear mixture or near-identical ones;
    ``keep_all`` keeps every pair with raw divergence as the fallback. Division by zero
    follows IEEE rules: x/0 is infinite, 0/0 matches no test.
    """
    def ratio_over(num, den, cut_, inclusive=False):
        q = F.try_divide(num, den)
        finite = q >= cut_ if inclusive else q > cut_
        return F.coalesce(F.when(den == 0, num > 0).otherwise(finite), F.lit(False))

    def ratio_under(num, den, cut_):
        return F.coalesce(F.when(den == 0, num < 0).otherwise(F.try_divide(num, den) < cut_), F.lit(False))

    sim, hmm = F.col("sim_fr"), F.col("hmm_fr")
    raw = F.col("divergence_raw")
    near = F.coalesce(F.when(F.col("aligned_raw") == 0, F.lit(True)).otherwise(raw < F.try_divide(F.lit(1500.0), F.col("aligned_raw"))), F.lit(False))
    clear = ratio_over(F.col("mnb_div"), F.col("mu_div"), 2.5) | near
    capped = ratio_over(sim, hmm, 2)
    kind = F.when(capped, "C").otherwise("NC")
    if keep_all:
        total = F.when(ratio_over(sim, hmm, 2, True) & clear, hmm).otherwise(sim)
        div = F.when(capped & clear, F.col("hmm_mu")).when(ratio_under(sim, hmm, 2) & clear, F.col("mu_div")).otherwise(raw)
        rows = stats
    else:
        total = F.when(capped, hmm).otherwise(sim)
        div = F.when(capped, F.col("hmm_mu")).otherwise(F.col("mu_div"))
        rows = stats.filter(clear)
    return rows.select(
        *stats.columns, F.when(near, 0.0).otherwise(total).alias("total_r"), F.when(near, 1e-5).otherwise(div).alias("div"),
        kind.alias("type"),
    )
