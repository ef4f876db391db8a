"""Values of given rank among all differences of two histograms, without making the differences.

The differences form an implicitly sorted matrix, so the number up to a threshold is a merged scan of both histograms.
Each pass tests many thresholds for all wanted ranks at once and keeps the interval that holds the rank; thresholds
halve the interval in the order of doubles, so 13 passes end at one value whatever the range. As soon as an interval
holds few differences they are listed by an equi-join on bins of its width.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.scan import prefix_scan, range_bucket

_WIDE = "decimal(38,0)"


def _ordinal(x: float) -> int:
    """Integer that grows with the double."""
    bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _double(ordinal: int) -> float:
    bits = ordinal if ordinal >= 0 else -ordinal | (1 << 63)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


@dataclass
class _Bracket:
    """Half-open interval (low, high] of differences, as ordinals, with what lies up to either end."""

    low: int
    high: int
    below: int
    pairs_below: int
    pairs_upto: int

    @property
    def pairs(self) -> int:
        return self.pairs_upto - self.pairs_below


def _counts(hist: DataFrame, n2: int, distinct2: int, thresholds: list[float]) -> list[tuple[int, int]]:
    """For every threshold: differences up to it, by weight and as distinct pairs of values."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "t int, threshold double")
    ids = F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))).alias("t")
    first = hist.filter("n1 > 0").select("v", "n1", ids).join(F.broadcast(asked), "t").select(
        "t", (F.col("v") - F.col("threshold")).alias("x"), F.lit(0).alias("side"), F.col("n1").alias("n"))
    second = hist.filter("n2 > 0").select(ids, F.col("v").alias("x"), F.lit(1).alias("side"), F.col("n2").alias("n"))
    points = first.unionByName(second)
    met = F.when(F.col("side") == 1, F.col("n"))
    scan = prefix_scan(points, ["t"], ["x", "side"], range_bucket(points, F.col("x")), {"less": ("sum", met), "fewer": ("sum", F.col("side").cast("long"))})
    got = scan.filter("side = 0").groupBy("t").agg(
        F.sum(F.col("n").cast(_WIDE) * (n2 - F.coalesce("less", F.lit(0)))).alias("n"), F.sum((distinct2 - F.col("fewer")).cast(_WIDE)).alias("pairs"))
    found = {r["t"]: (int(r["n"]), int(r["pairs"])) for r in got.collect()}
    return [found[i] for i in range(len(thresholds))]


def _listed(hist: DataFrame, bracket: _Bracket, rank: int, scale: float) -> float:
    """The difference of overall rank ``rank``, from the differences inside the bracket."""
    low, high = _double(bracket.low), _double(bracket.high)
    width = max(high - low, scale * 2.0**-40)  # wider bins do no harm and keep their numbers exact
    slot = F.floor((F.col("v") - high) / width).cast("double")
    near = F.explode(F.array_distinct(F.array(*[slot + s for s in (-1.0, 0.0, 1.0, 2.0)]))).alias("bin")
    first = hist.filter("n1 > 0").select("v", "n1", near)
    second = hist.filter("n2 > 0").select(F.col("v").alias("u"), "n2", F.floor(F.col("v") / width).cast("double").alias("bin"))
    inside = (F.col("u") >= F.col("v") - high) & (F.col("u") < F.col("v") - low)
    diffs = first.join(second, "bin").filter(inside).groupBy((F.col("v") - F.col("u")).alias("d")).agg(F.sum(F.col("n1").cast(_WIDE) * F.col("n2")).alias("n"))
    upto = prefix_scan(diffs, [], ["d"], range_bucket(diffs, F.col("d")), {"upto": ("sum", "n")}, inclusive=True)
    return upto.filter(F.col("upto") >= F.lit(rank - bracket.below).cast(_WIDE)).agg(F.min("d")).first()[0]


def ranked_differences(hist: DataFrame, ranks: list[int], pair_limit: int = 1_000_000, fan: int = 31) -> list[float]:
    """The differences v - u of the given 1-based ranks; ``hist`` (v, n1, n2) holds v by n1 and u by n2.

    Both sides must be present. ``pair_limit`` only decides when to list what is left. Differences are compared by the
    double v - t: where they are no exact doubles, one may be taken for another that is off by the rounding of the
    largest value, and no more.
    The histogram is read several times and should be written out.
    """
    side = lambda n: [F.min(F.when(F.col(n) > 0, F.col("v"))), F.max(F.when(F.col(n) > 0, F.col("v"))), F.count_if(F.col(n) > 0), F.sum(n)]
    lo1, hi1, m1, n1, lo2, hi2, m2, n2 = hist.agg(*[c.alias(f"c{i}") for i, c in enumerate(side("n1") + side("n2"))]).first()
    # A difference counts as up to t where u >= v - t as doubles; the ends leave room for that rounding.
    scale = max(abs(x) for x in (lo1, hi1, lo2, hi2))
    room = max(scale * 2.0**-50, 5e-324)
    whole = _Bracket(_ordinal(lo1 - hi2 - room), _ordinal(hi1 - lo2 + room), 0, 0, m1 * m2)
    brackets = {rank: whole for rank in set(ranks)}
    few = max(pair_limit, 2 * (m1 + m2))
    while True:
        wide = {(b.low, b.high) for b in brackets.values() if b.pairs > few and b.high - b.low > 1}
        if not wide:
            break
        cuts = sorted({low + (high - low) * i // (fan + 1) for low, high in wide for i in range(1, fan + 1)} - {low for low, _ in wide})
        seen = dict(zip(cuts, _counts(hist, n2, m2, [_double(c) for c in cuts])))
        for rank, b in brackets.items():
            inner = [c for c in cuts if b.low < c < b.high]
            above = next((c for c in inner if seen[c][0] >= rank), None)
            under = max((c for c in inner if seen[c][0] < rank), default=None)
            brackets[rank] = _Bracket(
                b.low if under is None else under, b.high if above is None else above, b.below if under is None else seen[under][0],
                b.pairs_below if under is None else seen[under][1], b.pairs_upto if above is None else seen[above][1])
    return [_double(b.high) if b.high - b.low == 1 else _listed(hist, b, rank, scale) for rank, b in ((r, brackets[r]) for r in ranks)]
