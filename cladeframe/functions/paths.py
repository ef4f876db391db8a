"""Most likely state paths of ordered chains that stay parallel within one chain.

One step of the search is a small matrix (log transition plus log emission), and steps compose by the max-plus
product, which is associative. So a chain is cut into buckets: each bucket is reduced to one matrix, a chain's
buckets are carried in a row, and every bucket then finds its own back-pointers. These are maps of states, which
compose too, so the way back takes one more carry. No chain is ever sorted or held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cladeframe.functions.batches import small_batches
from cladeframe.functions.lineage import cut


_DOUBLES, _INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices, scaled so that the largest entry is 0."""
    out = (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)
    top = out.max(axis=(1, 2), keepdims=True)
    return out - np.where(np.isfinite(top), top, 0.0)


def product(steps: np.ndarray) -> np.ndarray:
    """Max-plus product of a stack of matrices, halving it round by round."""
    while len(steps) > 1:
        odd = steps[len(steps) // 2 * 2:]
        steps = np.concatenate([_join(steps[0:len(steps) - len(odd):2], steps[1::2]), odd])
    return steps[0]


def prefixes(steps: np.ndarray) -> np.ndarray:
    """Products of all leading parts of the stack."""
    out, reach = steps.copy(), 1
    while reach < len(out):
        out = np.concatenate([out[:reach], _join(out[:-reach], out[reach:])])
        reach *= 2
    return out


def _steps(emit, start, move, first: bool) -> np.ndarray:
    states = len(start)
    e = np.asarray(emit, float).reshape(-1, states)
    out = np.asarray(move, float).reshape(1, states, states) + e[:, None, :]
    if first:
        out[0] = np.asarray(start, float) + e[0]  # no state before: all rows alike
    return out


@F.pandas_udf(_DOUBLES)
def _reduced(emit: pd.Series, start: pd.Series, move: pd.Series, bucket: pd.Series) -> pd.Series:
    return pd.Series([product(_steps(e, s, m, b == 0)).ravel() for e, s, m, b in zip(emit, start, move, bucket)])


@F.pandas_udf(T.ArrayType(_DOUBLES))
def _entering(products: pd.Series) -> pd.Series:
    """Best log weight of each state before every bucket of a chain."""
    out = []
    for chain in products:
        chain = [np.asarray(p, float) for p in chain]
        states = int(round(len(chain[0]) ** 0.5))
        at, rows = np.zeros(states), []
        for p in chain:
            rows.append(at)
            at = (at[:, None] + p.reshape(states, states)).max(axis=0)
            at = at - (at.max() if np.isfinite(at.max()) else 0.0)
        out.append(rows)
    return pd.Series(out)


@F.pandas_udf(T.StructType().add("weights", _DOUBLES).add("back", _INTS))
def _traced(emit: pd.Series, start: pd.Series, move: pd.Series, bucket: pd.Series, entering: pd.Series) -> pd.DataFrame:
    """Weights after a bucket, and for every place (one before the first included) the state there by the state at the end."""
    rows = []
    for e, s, m, b, before in zip(emit, start, move, bucket, entering):
        steps, states = _steps(e, s, m, b == 0), len(s)
        before = np.asarray(before, float)
        weight = (before[None, :, None] + prefixes(steps)).max(axis=1)
        weight = weight - weight.max(axis=1, keepdims=True)
        earlier = np.concatenate([before[None], weight[:-1]])
        back = (earlier[:, :, None] + np.asarray(m, float).reshape(1, states, states)).argmax(axis=1)
        back, reach = np.concatenate([back, np.arange(states)[None]]), 1
        while reach < len(back):
            back = np.concatenate([np.take_along_axis(back[:-reach], back[reach:], axis=1), back[-reach:]])
            reach *= 2
        rows.append((weight[-1], back.ravel().astype(np.int32)))
    return pd.DataFrame(rows, columns=["weights", "back"])


@F.pandas_udf(_INTS)
def _endings(weights: pd.Series, maps: pd.Series) -> pd.Series:
    """State at the end of every bucket of a chain."""
    out = []
    for w, chain in zip(weights, maps):
        ends = [int(np.argmax(np.asarray(w[-1], float)))]
        for m in reversed(chain[1:]):
            ends.append(int(m[ends[-1]]))
        out.append(ends[::-1])
    return pd.Series(out)


def best_paths(chains: DataFrame, keys: Sequence[str], order: str, bucket: int = 4096) -> DataFrame:
    """(keys, ``order``, state) on the most likely path of every chain; states are numbered from 0.

    ``chains`` has ``order`` (0, 1, … without gaps), ``emit`` (log emission by state), ``start`` and ``move`` (log start
    and, row by row, log transition weights, the same in all rows of a chain). Of equally likely states the lower
    number is taken, at the end and at every step back. A bucket is an array of at most ``bucket`` places.
    """
    keys = list(keys)
    small_batches(chains.sparkSession)
    slot = F.expr(f"`{order}` div {bucket}").alias("bucket")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "emit")))
    packed = cut(
        chains.groupBy(*keys, slot).agg(ordered.alias("p"), F.first("start").alias("start"), F.first("move").alias("move"))
        .select(*keys, "bucket", F.col("p.at").alias("at"), F.flatten("p.emit").alias("emit"), "start", "move")
    )
    reduced = packed.select(*keys, "bucket", _reduced("emit", "start", "move", "bucket").alias("m"))
    line = reduced.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "m"))).alias("l"))
    entering = line.select(*keys, F.inline(F.arrays_zip(F.col("l.bucket").alias("bucket"), _entering(F.col("l.m")).alias("entering"))))
    traced = cut(packed.join(entering, [*keys, "bucket"]).select(
        *keys, "bucket", "at", F.size("start").alias("states"), _traced("emit", "start", "move", "bucket", "entering").alias("t")))
    line = traced.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "bucket", F.col("t.weights").alias("w"), F.slice("t.back", F.lit(1), F.col("states")).alias("m")))).alias("l"))
    endings = line.select(*keys, F.inline(F.arrays_zip(F.col("l.bucket").alias("bucket"), _endings(F.col("l.w"), F.col("l.m")).alias("ending"))))
    found = traced.join(endings, [*keys, "bucket"])
    state = F.transform("at", lambda _, i: F.get("t.back", (i + 1) * F.col("states") + F.col("ending")))
    return found.select(*keys, F.inline(F.arrays_zip(F.col("at").alias(order), state.alias("state"))))
