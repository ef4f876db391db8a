"""Approximate nearest neighbours by a hash-prefix forest.

Every tree sorts all vectors by a string of random hyperplane bits. A query goes down each tree to its own
place and up again, in all trees at once, to the longest common prefix length at which the rows that share
the prefix make up enough candidates; these are contiguous in every sorted array. The arrays are cut into
ordered buckets. A first visit counts the rows of every prefix length exactly, from the keys alone; then
queries visit the buckets that their prefix range touches, and each visit scores its rows exactly in one
matrix product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from cladeframe.functions.lineage import cut
from cladeframe.llm.common import mix64, table

BITS, TIE = 31, 32


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and all finite numbers, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(F.col("embedding").isNotNull() & fine, F.lit(False)))


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, extra: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """One integer of BITS bits per row and tree."""
    bits = (np.c_[x, extra].astype(np.float32) @ normals > 0).reshape(len(x), -1, BITS)
    return bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def prefix_range(code: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest sort key whose hash string shares ``depth`` leading bits with ``code``."""
    low = (code >> (BITS - depth)) << (BITS - depth) << TIE
    return low, low + (np.int64(1) << (BITS - depth + TIE)) - 1


def nearest(
    rows: DataFrame, query_every: int = 20, k: int = 20, trees: int = 32, effort: float = 4.5, bucket_rows: int = 2048, seed: int = 29
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows (vec_id, embedding), the ``k`` found of largest inner product.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates all rows but the query's
    own, ties going to the smaller vec_id. Vectors that are null, zero or not finite take no part; shorter
    vectors count as padded with zeros; rows without vec_id are left out; an empty table gives no rows.

    Equal vectors are indexed once with their k + 1 smallest ids, which is all that any answer can need, so a
    hot vector costs no more than another (``row_number`` limits it before the shuffle). Inner products
    become angles by one more component that brings all candidates to the largest norm. A query takes the
    longest prefix that gives at least ``effort`` times n^0.8 rows over all trees and, in one tree, 4 k + 4
    different vectors or all there are; so it finds ``k`` rows wherever there are as many. The driver gets
    n / ``bucket_rows`` cut keys and bucket sizes per tree.
    """
    spark = rows.sparkSession
    good = usable(rows.filter("vec_id is not null")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    good = good.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64("v", F.lit(1))})
    order = W.partitionBy("h", "g").orderBy("vec_id")
    held = good.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    asked = good.filter(F.col("vec_id") % query_every == 0).select("h", "g").distinct().withColumn("asked", F.lit(True))
    reps = cut(
        held.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v"))
        .join(asked, ["h", "g"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    n, dim, top = facts["n"], facts["dim"] or 1, facts["top"] or 1.0
    normals, wanted, least = planes(dim, trees, seed), min(effort * n**0.8, n * trees), min(n, 4 * (k + 1))

    def matrix(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            out[i, :len(v)] = v
        return out

    def sort_keys(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (codes << TIE) | (mix64(ids.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)[:, None]

    def index(batches):
        for pdf in batches:
            x = matrix(pdf["v"])
            extra = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
            keys = sort_keys(hash_strings(x, extra, normals), pdf["rep"].to_numpy())
            for t in range(trees):
                yield pd.DataFrame({"tree": t, "key": keys[:, t], "rep": pdf["rep"], "x": [r.tobytes() for r in x]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    slices = max(1, -(-n // bucket_rows))
    keyed = cut(reps.select("rep", "v").mapInPandas(index, "tree int, key long, rep long, x binary"))
    cuts = np.zeros((trees, slices - 1), np.int64)
    if slices > 1:
        shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
        for r in keyed.groupBy("tree").agg(F.percentile_approx("key", shares, F.lit(max(10_000, 20 * slices))).alias("q")).collect():
            cuts[r["tree"]] = r["q"]

    def place(batches):
        for pdf in batches:
            bucket = np.empty(len(pdf), np.int64)
            for t in pdf["tree"].unique():
                own = (pdf["tree"] == t).to_numpy()
                bucket[own] = np.searchsorted(cuts[t], pdf["key"].to_numpy()[own], side="right")
            yield pdf.assign(bucket=bucket)

    below = np.zeros((trees, slices), np.int64)
    placed = keyed.select("tree", "key").mapInPandas(place, "tree int, key long, bucket long")
    for r in placed.groupBy("tree", "bucket").count().collect():
        below[r["tree"], r["bucket"] + 1:] += r["count"]
    levels = np.arange(1, BITS + 1)
    sizes = [f"s{d}" for d in levels]

    def edges(tree: int, code: np.ndarray):
        """Both ends of the range of every prefix length, and the buckets that hold them."""
        low, high = prefix_range(code[:, None], levels)
        return low, high, np.searchsorted(cuts[tree], low, side="right"), np.searchsorted(cuts[tree], high, side="right")

    def questions(batches):
        for pdf in batches:
            x = matrix(pdf["v"])
            codes = hash_strings(x, np.zeros(len(x)), normals)
            for t in range(trees):
                _, _, first, last = edges(t, codes[:, t])
                touched = np.sort(np.c_[first, last], axis=1)
                at, c = np.nonzero(np.c_[np.ones(len(x), bool), np.diff(touched, axis=1) > 0])
                yield pd.DataFrame({"tree": t, "bucket": touched[at, c], "query": pdf["rep"].to_numpy()[at], "code": codes[at, t]})

    def count(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(ask):
            return pd.DataFrame({c: [] for c in ("query", "tree", *sizes)}).astype("int64").astype({"tree": "int32"})
        tree, bucket, key = int(ask["tree"].iloc[0]), int(ask["bucket"].iloc[0]), np.sort(data["key"].to_numpy(np.int64))
        low, high, first, last = edges(tree, ask["code"].to_numpy())
        size = np.where(last == bucket, below[tree, bucket] + np.searchsorted(key, high, side="right"), 0)
        size -= np.where(first == bucket, below[tree, bucket] + np.searchsorted(key, low), 0)
        return pd.concat([ask[["query", "tree"]].reset_index(drop=True), pd.DataFrame(size, columns=sizes)], axis=1)

    def visits(batches):
        for pdf in batches:
            x = matrix(pdf["v"])
            codes = hash_strings(x, np.zeros(len(x)), normals)
            depth = pdf["depth"].to_numpy(np.int64)
            for t in range(trees):
                low, high = prefix_range(codes[:, t], depth)
                first, last = np.searchsorted(cuts[t], low, side="right"), np.searchsorted(cuts[t], high, side="right")
                times = last - first + 1
                at = np.repeat(np.arange(len(x)), times)
                bucket = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[at]
                yield pd.DataFrame({"tree": t, "bucket": bucket, "query": pdf["rep"].to_numpy()[at], "low": low[at], "high": high[at], "q": [x[i].tobytes() for i in at]})

    def score(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"query": [], "rep": [], "score": []}).astype({"query": "int64", "rep": "int64", "score": "float64"})
        data = data.sort_values(["key", "rep"], ignore_index=True)
        x = np.frombuffer(b"".join(data["x"]), np.float64).reshape(len(data), dim)
        key, rep, parts = data["key"].to_numpy(), data["rep"].to_numpy(), []
        for i in range(0, len(ask), 256):
            some = ask.iloc[i:i + 256]
            q = np.frombuffer(b"".join(some["q"]), np.float64).reshape(len(some), dim)
            s = q @ x.T
            begin, end = np.searchsorted(key, some["low"].to_numpy()), np.searchsorted(key, some["high"].to_numpy(), side="right")
            spot = np.arange(len(data))
            s[(spot < begin[:, None]) | (spot >= end[:, None])] = -np.inf
            m = min(k + 1, len(data))
            limit = np.partition(s, len(data) - m, axis=1)[:, len(data) - m]
            r, c = np.nonzero((s >= limit[:, None]) & (s > -np.inf))
            parts.append(pd.DataFrame({"query": some["query"].to_numpy()[r], "rep": rep[c], "score": s[r, c]}))
        out = pd.concat(parts).sort_values(["query", "score", "rep"], ascending=[True, False, True])
        return out[out.groupby("query").cumcount() <= k]

    buckets = keyed.mapInPandas(place, "tree int, key long, rep long, x binary, bucket long")
    asking = reps.filter("asked").select("rep", "v")
    parts = placed.groupBy("tree", "bucket").cogroup(asking.mapInPandas(questions, "tree int, bucket long, query long, code long").groupBy("tree", "bucket")).applyInPandas(
        count, ", ".join(["query long, tree int", *(f"{c} long" for c in sizes)]))
    ranges = parts.groupBy("query", "tree").agg(*[F.sum(c).alias(c) for c in sizes])
    enough = [F.when((F.sum(c) >= float(wanted)) & (F.max(c) >= least), F.lit(d)) for d, c in zip(levels.tolist(), sizes)]
    depths = cut(ranges.groupBy("query").agg(F.coalesce(*reversed(enough), F.lit(0)).alias("depth")).withColumnRenamed("query", "rep"))
    asks = asking.join(depths, "rep").mapInPandas(visits, "tree int, bucket long, query long, low long, high long, q binary")
    hits = buckets.groupBy("tree", "bucket").cogroup(asks.groupBy("tree", "bucket")).applyInPandas(score, "query long, rep long, score double")
    once = hits.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = once.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1)
    spread = best.join(reps.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    answer = spread.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    askers = good.filter(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "h", "g").join(
        reps.select("h", "g", F.col("rep").alias("query")), ["h", "g"])
    pairs = askers.join(answer.select("query", "vec_id", "score"), "query").filter("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all."""
    return nearest(table(spark, folder, "embeddings"))
