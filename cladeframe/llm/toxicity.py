"""Toxicity by a fuzzy lexicon and the context of its hits.

The lexicon is learned: words whose document counts, over the labelled training rows, lean strongly to the
toxic label. It is held as a trie; a Levenshtein automaton of each word of a text runs down the trie, so all
misspellings within the distance are found in one walk. Windows around a hit tell quotation (quote marks,
verbs of reporting, denial) from abuse (other hits, address), and a logistic model on these scores, fitted on
a bounded sample of training rows, gives the probability.
"""

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.llm.common import bounded_batches, table

WORD = re.compile(r"[^\W\d_]+(?:['’*@$0-9]+[^\W\d_]+)*")
SPARK_WORD = r"[\p{L}\p{M}]+"
QUOTES = re.compile("[\"“”„«»‹›]")
#: Words that report or deny what others said; they lower the weight of a hit in their window.
REPORTING = frozenset("said says wrote quote quoted called term word slur never not sagte schrieb wort nicht dit mot pas dijo palabra no".split())
#: Words of address near a hit; they raise it.
ADDRESS = frozenset("you your youre du dich dein tu te ton vous tú eres tus".split())


class LexiconTrie:
    """Trie of lexicon words with an id at each end."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for i, word in enumerate(words):
            at = self.root
            for letter in word:
                at = at.setdefault(letter, {})
            at[""] = i

    def within(self, word: str, most: int) -> list[tuple[int, int]]:
        """(lexicon id, distance) of all entries within ``most`` edits of ``word``.

        The automaton's state is the sparse row of edit distances up to ``most``; a branch ends as soon as the
        state is empty, so the walk visits only prefixes that some spelling can still complete.
        """
        found, n = [], len(word)
        start = {i: i for i in range(min(n, most) + 1)}
        stack = [(self.root, start)]
        while stack:
            node, state = stack.pop()
            if "" in node and state.get(n, most + 1) <= most:
                found.append((node[""], state[n]))
            for letter, child in node.items():
                if letter == "":
                    continue
                step: dict[int, int] = {}
                for i, d in state.items():
                    if i < n and word[i] == letter:
                        if d < step.get(i + 1, most + 1):
                            step[i + 1] = d
                    elif i < n and d < most and d + 1 < step.get(i + 1, most + 1):
                        step[i + 1] = d + 1
                    if d < most and d + 1 < step.get(i, most + 1):
                        step[i] = d + 1
                for i in sorted(step):
                    if i < n and step[i] < most and step[i] + 1 < step.get(i + 1, most + 1):
                        step[i + 1] = step[i] + 1
                        j = i + 1
                        while j < n and step[j] < most and step[j] + 1 < step.get(j + 1, most + 1):
                            step[j + 1] = step[j] + 1
                            j += 1
                if step:
                    stack.append((child, step))
        return found


def allowed_edits(size: int) -> int:
    """Edits forgiven to a term of ``size`` letters: none below five, one below twelve, two beyond."""
    return 0 if size < 5 else 1 if size < 12 else 2


def shortened(word: str, most: int) -> set[str]:
    """``word`` and what is left of it after up to ``most`` deletions."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


class HitFinder(dict):
    """Best lexicon match per word, remembered: (weight, distance) or None.

    The walk is spared for words that cannot match: one edit leaves the first two or the last two letters of a
    term whole and keeps a common deletion; two edits leave its first, last or middle four letters.
    """

    def __init__(self, lexicon: dict[str, float], remembered: int = 300_000):
        self.trie, self.weights, self.remembered = LexiconTrie(lexicon), list(lexicon.values()), remembered
        self.edits = [allowed_edits(len(w)) for w in lexicon]
        self.exact = {w for w in lexicon if allowed_edits(len(w)) == 0}
        one, two = ([w for w in lexicon if allowed_edits(len(w)) == e] for e in (1, 2))
        self.first, self.final = {w[:2] for w in one}, {w[-2:] for w in one}
        self.one = frozenset().union(*(shortened(w, 1) for w in one))
        self.parts = {part for w in two for part in (w[:4], w[-4:])}
        self.middle = {w[4:8] for w in two}
        self.long = max(map(len, lexicon), default=0) + 2

    def possible(self, word: str) -> bool:
        n = len(word)
        if word in self.exact:
            return True
        if n > self.long or n < 4:
            return False
        if word[:2] in self.first or word[-2:] in self.final:
            one = self.one
            if word in one or any(word[:i] + word[i + 1:] in one for i in range(n)):
                return True
        return n >= 10 and bool(self.parts) and (
            word[:4] in self.parts or word[-4:] in self.parts or not self.middle.isdisjoint(word[i:i + 4] for i in range(2, 7)))

    def __missing__(self, word: str):
        best = None
        if self.possible(word):
            hits = [(d, -self.weights[i]) for i, d in self.trie.within(word, allowed_edits(len(word) + 2)) if d <= self.edits[i]]
            best = min(hits, default=None)
            best = best and (-best[1], best[0])
        if len(self) < self.remembered:
            self[word] = best
        return best


#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000
FEATURES = ("exact", "near", "best", "dense", "abuse", "quoted", "reported", "spread", "any_exact", "any_near")


def lowered(text: str) -> str:
    """``text`` in lower case and of the same length: U+0130 alone would become two characters, and is taken as i."""
    return text.replace("\u0130", "i").lower()


def spans_of(text: str, finder: HitFinder, window: int = 8) -> list[tuple[int, int, float, int, float, bool]]:
    """(start, end, weight, distance, context score, quoted) of every hit in ``text``."""
    low_text = lowered(text)
    words = WORD.findall(low_text)
    hits = [(i, hit) for i, hit in enumerate(map(finder.__getitem__, words)) if hit]
    if not hits:
        return []
    at = [m.span() for m in WORD.finditer(low_text)]
    quotes = [m.start() for m in QUOTES.finditer(text)]
    reports = [0, *accumulate(w in REPORTING for w in words)]
    addresses = [0, *accumulate(w in ADDRESS for w in words)]
    places, out = [i for i, _ in hits], []
    for i, (weight, distance) in hits:
        low, high = max(0, i - window), min(len(words), i + 1 + window)
        start, end = at[i]
        before = bisect_left(quotes, start) - bisect_left(quotes, at[low][0])
        after = bisect_left(quotes, at[high - 1][1] + 1) - bisect_left(quotes, end)
        quoted = before % 2 == 1 and after > 0
        others = bisect_left(places, high) - bisect_left(places, low) - 1
        context = 1.0 + 0.5 * min(others, 4) + 0.25 * min(addresses[high] - addresses[low], 2) - 0.75 * quoted - 0.25 * min(reports[high] - reports[low], 2)
        out.append((start, end, weight, distance, max(context, 0.0), quoted))
    return out


def features_of(text: str, finder: HitFinder) -> list[float]:
    """The scores of FEATURES for one whole text."""
    low_text = lowered(text)
    if not any(map(finder.__getitem__, set(WORD.findall(low_text)))):
        return [0.0] * len(FEATURES)
    spans = spans_of(text, finder)
    n = 1 + text.count(" ")
    exact = [s for s in spans if s[3] == 0]
    mass = sum(s[2] / (1 + s[3]) for s in spans)
    distinct = len({low_text[s[0]:s[1]] for s in spans})
    return [
        np.log1p(len(exact)), np.log1p(len(spans) - len(exact)), max(s[2] / (1 + s[3]) for s in spans), np.log1p(1000 * mass / (n + 50)),
        np.log1p(sum(s[2] * s[4] / (1 + s[3]) for s in spans)), sum(s[5] for s in spans) / len(spans),
        sum(s[4] < 1 for s in spans) / len(spans), np.log1p(distinct), float(bool(exact)), float(len(exact) < len(spans)),
    ]


def learn_lexicon(train: DataFrame, entries: int = 400, least_g: float = 24.0, least_ratio: float = 5.0) -> dict[str, float]:
    """Words that lean to the toxic label, with their log ratio, from counts over all training rows (text, y).

    What counts is the number of different words a word follows, not of its documents: copies and near copies
    of one toxic text repeat its contexts and so do not make terms of all its words. A word needs a likelihood
    ratio of ``least_g``; only the ``entries`` strongest words reach the driver.
    """
    words = train.select("y", F.regexp_extract_all(F.lower(F.translate("text", "\u0130", "i")), F.lit(f"({SPARK_WORD})"), F.lit(1)).alias("b"))
    after = words.select("y", F.explode(F.arrays_zip("b", F.concat(F.array(F.lit("")), "b").alias("p"))).alias("e"))
    pairs = after.select("y", F.col("e.b").alias("w"), F.xxhash64("e.p").alias("p")).filter("w is not null").distinct()
    n = pairs.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    share = (n["p"] or 0) / max(n["n"], 1)
    if not 0 < share < 1:
        return {}
    counts = pairs.groupBy("w").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("a") > share * F.col("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    g = 2 * (a * F.log(a / (share * F.col("n"))) + F.when(b > 0, b * F.log(b / ((1 - share) * F.col("n")))).otherwise(0.0))
    ratio = F.log((a + 0.1) * (1 - share) / ((b + 0.1) * share))
    top = counts.select("w", g.alias("g"), ratio.alias("r")).filter((F.col("g") >= least_g) & (F.col("r") >= float(np.log(least_ratio))))
    return {r["w"]: float(r["r"]) for r in top.orderBy(F.desc("g"), "w").limit(entries).collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; with one class only the intercept is fitted."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    if not len(x):
        return w[:-1], -5.0
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w[:-1], float(w[-1])
    damp = np.r_[np.full(x.shape[1], ridge), 1e-6] * len(x) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(damp), a.T @ (y - p) - damp * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def label_rows(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, sample: int) -> DataFrame:
    """(doc_id, text, y): ``sample`` labelled documents outside the fold at most, those of smallest key hash.

    Null labels and null ids are no training rows; several labels of one document count as their rounded
    mean. Equal texts count once, with their mean label, so that no group of copies outweighs the rest. The
    sampled ids are broadcast, being bounded by ``sample``; no other text moves.
    """
    one = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(
        F.round(F.avg(column)).cast("int").alias("y"))
    ids = one.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    rows = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").withColumn("h", F.sha2("text", 256)))
    kept = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.round(F.avg("y")).cast("int").alias("y"))
    return cut(rows.drop("y").join(F.broadcast(kept), ["h", "doc_id"]).dropDuplicates(["h"]).select("doc_id", "text", "y"))


class ToxicityModel:
    """Lexicon and weights, small enough to travel with the task."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    @classmethod
    def fit(cls, train: DataFrame, entries: int = 400) -> "ToxicityModel":
        """Fit on the bounded rows of ``label_rows``; the driver gets ten numbers of each."""
        lexicon = learn_lexicon(train, entries)
        rows = with_features(train, lexicon).select("doc_id", "f", "y").toPandas().sort_values("doc_id", ignore_index=True)
        x = np.array(rows["f"].tolist(), float).reshape(len(rows), len(FEATURES))
        return cls(lexicon, *fit_logistic(x, rows["y"].to_numpy(float)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a score from 0 to 1 of each whole text; a null text counts as empty."""
        raw = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            raw = raw + F.get("f", F.lit(i)) * F.lit(float(w))
        score = 1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0))))
        return with_features(docs, self.lexicon).withColumn("score", score).drop("f")


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = HitFinder(lexicon)
        for texts in batches:
            yield pd.Series([features_of(t, finder) for t in texts])

    return docs.withColumn("f", scored(F.coalesce("text", F.lit(""))))


def fold(modulus: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))


def op4(spark, folder: str) -> DataFrame:
    """Toxicity of every whole document, learned outside the held-out fold.

    A null doc_id is in no fold and has no label; repeated rows score alike; no labels at all give the
    low score of the intercept; an empty table gives no rows.
    """
    docs, held = table(spark, folder, "documents"), fold(5, 0)
    train = label_rows(docs, table(spark, folder, "labels"), "toxic", held, SAMPLE)
    scored = ToxicityModel.fit(train).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
