"""Quality by histogram gradient-boosted trees over statistics of the whole text.

Trees grow level by level on binned features; each is flattened into arrays of one complete binary tree, so
scoring a batch is a few vectorised numpy look-ups per tree.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cladeframe.llm.common import bounded_batches, table
from cladeframe.llm.toxicity import SAMPLE, fold, label_rows

STATISTICS = (
    "chars", "words", "word_length", "word_length_sd", "distinct", "top_word", "repeat_next", "upper", "lower", "digit", "space", "symbol",
    "ends_symbol", "all_upper", "title", "no_letter", "lines", "line_length", "repeated_lines", "short_lines", "sentence_end", "comma",
    "pipe", "bang", "compress", "non_ascii", "long_words", "distinct_letters",
)
_ENDS = tuple("#$%&*|!<>{}[]~^=+_\\@")


def statistics_of(text: str) -> list[float]:
    """The numbers named in STATISTICS for one whole text; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    marks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_counts = np.bincount(np.minimum(marks, 128), minlength=129)
    upper, lower = ascii_counts[65:91].sum(), ascii_counts[97:123].sum()
    digit, space, other = ascii_counts[48:58].sum(), ascii_counts[9:14].sum() + ascii_counts[32], ascii_counts[128]
    symbol = n - upper - lower - digit - space - other
    line_counts = Counter(lines)
    head = memoryview(text.encode())
    packed = sum(len(zlib.compress(head[i:i + 65_536], 1)) for i in range(0, len(head), 65_536))
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0, len(counts) / w,
        max(counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w, upper / n, lower / n, digit / n, space / n,
        symbol / n, sum(x.endswith(_ENDS) for x in words) / w, sum(map(str.isupper, words)) / w, sum(x[0].isupper() for x in words) / w,
        sum(not x.isalpha() for x in words) / w, np.log1p(len(lines)), n / len(lines), 1 - len(line_counts) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), (ascii_counts[46] + ascii_counts[63]) / w, ascii_counts[44] / w, ascii_counts[124] / w,
        ascii_counts[33] / w, packed / len(head), other / n, sum(lengths > 15) / w, len(set(text)) / np.sqrt(n),
    ]


class BoostedTrees:
    """Logistic boosting on quantile bins; tree t, node k has its children at 2k+1 and 2k+2."""

    def __init__(self, edges, feature, threshold, leaf, base):
        self.edges, self.feature, self.threshold, self.leaf, self.base = edges, feature, threshold, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 3.0) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        inner = 2**depth - 1
        empty = cls(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
        if len(y) < 2 or y.min() == y.max():
            return empty
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        raw, made = np.full(len(y), base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, feature, cut_bin = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                at = node - first
                best = np.full(width, 1e-6)
                for f, column in enumerate(binned):
                    key = at * bins + column
                    gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                    hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    gain[(hs < 1) | (ht - hs < 1)] = -1
                    b = gain.argmax(1)
                    top = gain[np.arange(width), b]
                    better = top > best
                    best[better] = top[better]
                    feature[first:first + width][better] = f
                    cut_bin[first:first + width][better] = b[better]
                node = 2 * node + 1 + (binned[feature[node], np.arange(len(y))] > cut_bin[node])
            at = node - inner
            leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
            raw += leaf[at]
            limits = np.array([edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(feature, cut_bin)])
            made.append((feature, limits, leaf))
        return cls(edges, *map(np.stack, zip(*made)), base)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))


def with_statistics(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(t) for t in texts])

    return docs.withColumn("s", F.pandas_udf(run, "array<double>")(F.coalesce("text", F.lit(""))))


def fit_quality(train: DataFrame) -> BoostedTrees:
    """Fit on the bounded rows of ``label_rows``; the driver gets their statistics, not their texts."""
    rows = with_statistics(train).select("doc_id", "s", "y").toPandas().sort_values("doc_id", ignore_index=True)
    return BoostedTrees.fit(np.array(rows["s"].tolist(), float).reshape(len(rows), len(STATISTICS)), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; a null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array([statistics_of(t) for t in texts], float).reshape(len(texts), len(STATISTICS))))

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.coalesce("text", F.lit(""))))


def op6(spark, folder: str) -> DataFrame:
    """Quality of every whole document, learned outside the held-out fold.

    A null doc_id is in no fold and has no label; repeated rows score alike; without labels every text gets
    the same score; an empty table gives no rows.
    """
    docs, held = table(spark, folder, "documents"), fold(4, 2)
    train = label_rows(docs, table(spark, folder, "labels"), "quality", held, SAMPLE)
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(train))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
