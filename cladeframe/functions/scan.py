"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(x)`` sends a whole key to one task.
Here the key is cut into order-preserving buckets: each bucket is scanned on its
own, and only one summary row per bucket goes through the key-wide window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | str,
    specs: dict[str, tuple[str, str | Column]],
    inclusive: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add running sum / max / min columns in ``order`` within ``keys``.

    ``bucket`` must be non-null and grow with ``order``; ``specs`` maps a new
    column to (kind, input). Exclusive sums start at 0, exclusive max / min at null. A
    bucket given by column name keeps its placement, so a second scan by it needs no
    further exchange.
    """
    keys = list(keys)
    slot = bucket if isinstance(bucket, str) else "__b"
    src = df if isinstance(bucket, str) else df.withColumn(slot, bucket)
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    stop = W.currentRow if inclusive else -1
    inner = (
        W.partitionBy(*keys, slot)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(W.unboundedPreceding, stop)
    )
    cols = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in specs.items()}
    part = src.select("*", *[_AGG[k](c).over(inner).alias(f"__in_{n}") for n, (k, c) in cols.items()])
    totals = src.groupBy(*keys, slot).agg(*[_AGG[k](c).alias(f"__t_{n}") for n, (k, c) in cols.items()])
    outer = (
        W.partitionBy(*keys).orderBy(direction(slot)).rowsBetween(W.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys, slot, *[_AGG[k](F.col(f"__t_{n}")).over(outer).alias(f"__c_{n}") for n, (k, _) in cols.items()]
    )
    joined = part.join(carry, [*keys, slot], "left")
    return joined.select(
        *df.columns,
        *[_COMBINE[k](F.col(f"__in_{n}"), F.col(f"__c_{n}")).alias(n) for n, (k, _) in cols.items()],
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """1-based position in ``order`` within ``keys`` without a key-wide sort."""
    return prefix_scan(df, keys, order, bucket, {name: ("sum", F.lit(1).cast("long"))}, inclusive=True)


def double_bucket(col: str) -> Column:
    """Order-preserving bucket of a non-negative double: its binary exponent, cut in 64.

    Suits p-values, where a linear cut would leave all the small ones together.
    """
    x = F.col(col)
    exponent = F.when(x > 0, F.floor(F.log2(x))).otherwise(F.lit(-1100)).cast("long")
    mantissa = F.when(x > 0, x / F.pow(F.lit(2.0), exponent.cast("double")) - 1.0).otherwise(F.lit(0.0))
    inside = F.least(F.greatest(F.floor(mantissa * 64).cast("long"), F.lit(0)), F.lit(63))
    return exponent * 64 + inside


def range_bucket(df: DataFrame, value: Column, slices: int = 256) -> Column:
    """Order-preserving bucket of a numeric column: equal slices of its overall range."""
    span = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    share = F.try_divide(value.cast("double") - span["lo"], span["hi"] - span["lo"])
    return F.coalesce(F.floor(share * (slices - 1)), F.lit(0)).cast("long")


def sorted_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based overall position of rows with distinct ``order``, whatever the column types.

    Rows are range-partitioned; the partition number, frozen by a checkpoint, is the
    order-preserving bucket.
    """
    from cladeframe.functions.lineage import cut

    placed = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    return row_index(placed, [], order, F.col("__part"), name).drop("__part")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per key from a scan over the histogram of values.

    Unlike the built-in exact aggregate no task holds all distinct values of a key.
    """
    keys = list(keys)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cum = prefix_scan(hist, keys, ["v"], range_bucket(hist, F.col("v")), {"upto": ("sum", "n")}, inclusive=True)
    total = hist.groupBy(*keys).agg(F.sum("n").alias("total"))
    rows = cum.join(total, keys) if keys else cum.withColumn("total", hist.agg(F.sum("n")).scalar())

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") >= position, F.col("v")))

    aggs = []
    for name, q in shares.items():
        h = (F.col("total") - 1) * F.lit(q)
        low, frac = at(F.floor(h) + 1), F.max(h - F.floor(h))
        aggs.append((low + frac * (at(F.ceil(h) + 1) - low)).alias(name))
    return rows.groupBy(*keys).agg(F.max("total").alias("n"), *aggs)
