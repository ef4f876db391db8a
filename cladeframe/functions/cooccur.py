"""Co-occurrence counts by blocked matrix products.

Counting, for every pair of items, the units that hold both is a Gram matrix.
Joining the cells to themselves would emit every pair of a unit as a row; here
items fall into blocks and units into chunks, and each task multiplies two small
0/1 matrices, so a unit holding very many items costs no extra rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _block_product(key, pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi = int(key[0]), int(key[1])
    unit, units = pd.factorize(pdf["unit"])
    left_rows = (pdf["block"] == lo).to_numpy()
    right_rows = (pdf["block"] == hi).to_numpy()

    def matrix(mask):
        code, names = pd.factorize(pdf["item"][mask], sort=True)
        dense = np.zeros((len(units), len(names)), dtype=np.float32)
        dense[unit[mask], code] = 1.0
        return dense, names

    a, a_names = matrix(left_rows)
    b, b_names = (a, a_names) if lo == hi else matrix(right_rows)
    gram = a.T @ b
    i, j = np.nonzero(gram)
    if lo == hi:
        keep = i < j
        i, j = i[keep], j[keep]
    first, second = np.asarray(a_names)[i], np.asarray(b_names)[j]
    swap = first > second
    return pd.DataFrame(
        {
            "item_a": np.where(swap, second, first),
            "item_b": np.where(swap, first, second),
            "n_both": gram[i, j].astype(np.int64),
        }
    )


def cooccurrence_counts(
    cells: DataFrame, item: str, unit: str, n_items: int, n_units: int,
    block: int = 1024, chunk: int = 4096,
) -> DataFrame:
    """(item_a < item_b, n_both) over distinct ``cells``; pairs never seen together are absent.

    ``n_items`` and ``n_units`` only size the grid. One task holds at most about
    ``chunk`` x ``2·block`` cells.
    """
    n_blocks = max(1, math.ceil(n_items / block))
    n_chunks = max(1, math.ceil(n_units / chunk))
    item_type = cells.schema[item].dataType.simpleString()
    placed = cells.select(
        F.col(item).alias("item"),
        F.col(unit).alias("unit"),
        F.pmod(F.xxhash64(item), F.lit(n_blocks)).cast("int").alias("block"),
        F.pmod(F.xxhash64(unit), F.lit(n_chunks)).cast("int").alias("chunk"),
    )
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "chunk", "item", "unit", "block",
    )
    part = spread.groupBy("lo", "hi", "chunk").applyInPandas(
        lambda key, pdf: _block_product(key, pdf),
        schema=f"item_a {item_type}, item_b {item_type}, n_both long",
    )
    return part.groupBy("item_a", "item_b").agg(F.sum("n_both").alias("n_both"))
