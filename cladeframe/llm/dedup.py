"""Near-duplicate classes by DartMinHash signatures.

A document is a weighted set: its shingles of five words with their counts. Darts, placed by hashes alone,
fall on the plane of every element (weight across, rank upwards); a document owns those under its weights and
keeps the earliest per coordinate, so two signatures agree in a coordinate with a chance of the weighted
Jaccard similarity. About k·ln k + 2k darts are thrown per document however long it is. Bands of coordinates
nominate pairs, an exact comparison of the shingles decides, and classes are the components of the links.

Members of a bucket are not paired with each other. Each is compared with a leader of its buckets, the member
with the most company in all of its own. Texts of buckets whose members are still in several classes meet in
finer buckets, by the few shingles that a pair as similar as asked must have in common: once more with leaders,
then completely, class against class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.functions.scan import sorted_index
from cladeframe.llm.common import bounded_batches, components, mix64, table

WORDS, BANDS, ROWS = 5, 32, 7
COORDINATES = BANDS * ROWS
_STEP, _BASE = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of all texts; shorter texts are one shingle, texts without words none."""
    split = [t.split() for t in texts]
    split = [w + [""] * (WORDS - len(w)) if 0 < len(w) < WORDS else w for w in split]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.array([x for w in split for x in w], object)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, doc = pd.util.hash_array(flat, categorize=True), np.repeat(np.arange(len(texts)), sizes)
    n = len(flat) - WORDS + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(WORDS):
            h = h * _BASE + code[i:n + i]
    own = doc[:n] == doc[WORDS - 1:]
    doc, h = doc[:n][own], mix64(h[own])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[first], h[first], np.diff(np.r_[first, len(doc)])


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, n_docs: int) -> np.ndarray:
    """Earliest dart per document and coordinate, rank in the upper and name in the lower half; all ones if none.

    Weight regions of an element double in width: [0, 1), [1, 2), [2, 4) and so on. Darts fall on each as a
    Poisson process over the ranks, the same for every document; ranks up to ``reach`` of the document count.
    """
    best = np.full(n_docs * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    layers = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(doc)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    width = np.where(layer == 0, 1.0, low)
    with np.errstate(over="ignore"):
        state = mix64(element[at] + layer.astype(np.uint64) * _STEP)
    d, w, limit, rank = doc[at], weight[at], reach[doc[at]], np.zeros(len(at))
    number = 0
    while len(d):
        many = int(np.clip(8192 // len(d), 1, 64))
        with np.errstate(over="ignore"):
            h = mix64(state[:, None] + (np.arange(number, number + many, dtype=np.uint64) + np.uint64(1)) * _BASE)
        ranks = rank[:, None] + np.cumsum(-np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width[:, None], axis=1)
        spot = mix64(h)
        across = low[:, None] + (spot >> np.uint64(40)).astype(np.float64) * 2.0**-24 * width[:, None]
        r, c = np.nonzero((ranks <= limit[:, None]) & (across < w[:, None]))
        name = mix64(spot[r, c])
        slot = d[r] * COORDINATES + ((name >> np.uint64(32)) % np.uint64(COORDINATES)).astype(np.int64)
        packed = (ranks[r, c].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, slot, packed)
        rank, number = ranks[:, -1], number + many
        alive = rank <= limit
        d, w, limit, rank, state, low, width = (v[alive] for v in (d, w, limit, rank, state, low, width))
    return best.reshape(n_docs, COORDINATES)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """32-bit dart names, COORDINATES per document; documents with an empty coordinate reach twice as high."""
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, COORDINATES), np.uint32)
    todo = np.flatnonzero(total > 0)
    factor = COORDINATES * (np.log(COORDINATES) + 2)
    while len(todo):
        spot = np.full(n_docs, -1)
        spot[todo] = np.arange(len(todo))
        own = spot[doc] >= 0
        best = throw(spot[doc[own]], element[own], weight[own].astype(float), factor / total[todo], len(todo))
        full = (best != np.iinfo(np.uint64).max).all(1)
        out[todo[full]] = (best[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        todo, factor = todo[~full], 2 * factor
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band of ROWS coordinates."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for i in range(ROWS):
        keys = mix64(keys ^ signature[:, i::ROWS][:, :BANDS].astype(np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)))
    return keys.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, keys, signature, shingles) of rows with an id.

    Of each coordinate the lowest byte is kept, enough to tell clear misses from the rest.
    ``shingles`` are sorted 32-bit hashes of (shingle, occurrence), so the overlap of two such sets is the
    weighted one. Texts without words have neither shingles nor keys.
    """
    bounded_batches(docs.sparkSession, 1024)

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            doc, element, weight = shingle_sets(pdf["text"].tolist())
            signed = signatures(doc, element, weight, n)
            keys = band_keys(signed)
            each = np.repeat(np.arange(len(doc)), weight)
            occurrence = (np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
            with np.errstate(over="ignore"):
                named = (mix64(element[each] + occurrence * _STEP) >> np.uint64(32)).astype(np.uint32)
            owner = doc[each]
            named = named[np.lexsort((named, owner))]
            ends = np.cumsum(np.bincount(owner, minlength=n))
            starts = np.r_[0, ends[:-1]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "sha": pdf["sha"], "keys": [k if b > a else [] for k, a, b in zip(keys, starts, ends)],
                "signature": [s.tobytes() for s in signed.astype(np.uint8)], "shingles": [named[a:b].tobytes() for a, b in zip(starts, ends)],
            })

    text = F.coalesce("text", F.lit(""))
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha")).mapInPandas(
        run, "doc_id long, sha binary, keys array<long>, signature binary, shingles binary"
    )


def verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets are similar enough; signatures spare the clear misses."""
    margin = similarity - 0.2

    @F.pandas_udf("boolean")
    def close(sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() >= margin for x, y in zip(sa, sb)], dtype=bool)

    @F.pandas_udf("boolean")
    def similar(xa: pd.Series, xb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xa, xb):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(both / max(len(x) + len(y) - both, 1) >= similarity - 1e-9)
        return pd.Series(out, dtype=bool)

    def beside(df: DataFrame, column: str, kind: str) -> DataFrame:
        return df.join(nodes.select(F.col("rep").alias(column), F.col(column_of[kind]).alias(f"{kind}{column}")), column)

    column_of = {"s": "signature", "x": "shingles"}
    near = cut(beside(beside(pairs, "a", "s"), "b", "s").filter(close("sa", "sb")).select("a", "b"))
    return beside(beside(near, "a", "x"), "b", "x").filter(similar("xa", "xb")).select("a", "b")


def prefix_buckets(mixed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, rep, size, rest, narrow): the shingles by which ``mixed`` (rep, label) texts of two labels can still be linked.

    Texts are ordered by their shingles, those seen under one label first, then rare before frequent; ``rest`` counts
    those after this one. Two texts as similar as asked have a shingle in common among the first of each: the larger
    one's first (1 - t)·size + 1, the smaller one's even in its first (1 - 2t/(1+t))·size + 1, its ``narrow`` ones.
    Texts that only share a passage have enough shingles of their own before it and leave no row. No link is lost.
    """

    @F.pandas_udf("array<int>")
    def unpacked(shingles: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int32) for x in shingles], dtype=object)

    chosen = cut(mixed.join(nodes.select("rep", "shingles"), "rep").select("rep", "label", "shingles"))
    items = chosen.select("rep", "label", (F.octet_length("shingles") / 4).cast("int").alias("size"), F.explode(unpacked("shingles")).alias("key"))
    shared = items.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "df")
    text = Window.partitionBy("rep")
    ranked = items.join(shared, "key").select(
        "key", "rep", "size", F.row_number().over(text.orderBy("df", "key")).alias("at"), F.count(F.lit(1)).over(text).alias("own"))
    place = F.col("size") - F.col("own") + F.col("at")
    first = lambda share: place <= F.floor(F.col("size") * share + 1e-6) + 1
    return cut(ranked.filter(first(1 - similarity)).select(
        "key", "rep", "size", (F.col("own") - F.col("at")).alias("rest"), first(1 - 2 * similarity / (1 + similarity)).alias("narrow")))


def complete_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different labels in one bucket of ``prefix_buckets`` that may be similar enough.

    A pair that is has a first shingle in common, and from there on enough of them to go.
    """
    small = placed.filter("narrow").select("key", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("size").alias("nx"), F.col("rest").alias("rx"))
    large = placed.select("key", F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("size").alias("ny"), F.col("rest").alias("ry"))
    enough = 1 + F.least("rx", "ry") >= (F.col("nx") + F.col("ny")) * similarity / (1 + similarity) - 1e-6
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = small.join(large, "key").filter(ordered & enough & (F.col("lx") != F.col("ly")))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of every row: the smallest doc_id among the documents it is linked with, itself included.

    Links join documents whose weighted sets of five-word shingles have a Jaccard similarity of
    ``similarity`` or more, and equal texts, empty ones among them. Rows that share a doc_id share a class;
    rows without doc_id are classes of their own with a null class_id; an empty table gives no rows, and
    other columns are ignored. Equal texts are one node from the start, found by digest, so copies cost no
    comparison.
    """
    whole = linked(cut(sketch(docs)), similarity)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(whole, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def linked(sketched: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of every doc_id of ``sketch`` rows that is linked to a smaller one, with the smallest it reaches."""
    texts = cut(sketched.groupBy("sha").agg(F.min("doc_id").alias("rep")))
    member = sketched.select("doc_id", "sha").join(texts.select("sha", "rep"), "sha").select("doc_id", "rep")
    ties = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = texts.select("sha", F.col("rep").alias("doc_id"))
    keyed = sketched.select("sha", "doc_id", "keys").join(first, ["sha", "doc_id"]).dropDuplicates(["sha", "doc_id"]).select(
        F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = cut(keyed.join(shared, "key"))
    central = cut(buckets.groupBy("rep").agg(F.sum("n").alias("company")))
    involved = buckets.select("rep").distinct()
    wanted = first.join(involved, first["doc_id"] == involved["rep"], "left_semi")
    nodes = cut(sketched.join(wanted, ["sha", "doc_id"]).select(F.col("doc_id").alias("rep"), "signature", "shingles").dropDuplicates(["rep"]))
    labels, tried = cut(nodes.select("rep", F.col("rep").alias("label"))), None

    for turn in ("bands", "prefixes", "complete"):
        if turn == "prefixes":
            several = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
            buckets = prefix_buckets(placed.join(several, "key").select("rep", "label").distinct(), nodes, similarity)
        placed = buckets.join(labels.join(central, "rep"), "rep")
        if turn == "complete":
            pairs = complete_pairs(placed, similarity)
        else:
            leaders = placed.groupBy("key").agg(
                F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("company", "rep", "label")).alias("lead")
            ).filter("low < high").select("key", F.col("lead.rep").alias("leader"), F.col("lead.label").alias("leader_label"))
            met = placed.join(leaders, "key").filter("label <> leader_label").groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("n"))
            pairs = met.select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b"), "rep", "n")
            pairs = pairs.groupBy("rep").agg(F.slice(F.sort_array(F.collect_set(F.struct("n", "a", "b")), False), 1, 4).alias("p"))
            pairs = pairs.select(F.explode("p").alias("p")).select("p.a", "p.b").distinct()  # of the leaders of its own buckets at most
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = verified(pairs, nodes, similarity)
        on = links.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a").join(
            labels.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        roots = components(on)
        labels = cut(labels.join(roots, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("root", "label").alias("label")))
        placed = buckets.join(labels, "rep")

    return components(ties.unionByName(labels.filter("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b"))))


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each class of texts, that of the smallest doc_id, once.

    Here texts are the nodes, numbered by their smallest doc_id and digest, so an id with several texts keeps those
    that nothing else resembles, and rows without an id are compared like the others and come last. Null texts
    count as empty; other columns may have any names; an empty table gives no rows.
    """
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), sha)
    first = rows.groupBy("sha").agg(F.min("id").alias("first"))
    order = [F.col("first").isNull().alias("late"), "first", "sha"]
    numbers = cut(sorted_index(first.select(*order), ["late", "first", "sha"], "doc_id"))
    sketched = sketch(docs.select(F.lit(0).alias("doc_id"), "text")).drop("doc_id").dropDuplicates(["sha"])
    whole = linked(cut(sketched.join(numbers.select("sha", "doc_id"), "sha")), similarity)
    kept = numbers.join(whole.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select("first", F.col("sha").alias("own"))
    chosen = rows.join(kept, F.col("id").eqNullSafe(F.col("first")) & (F.col("sha") == F.col("own")), "left_semi")
    return chosen.dropDuplicates(["id", "sha"]).select("row.*")


def op8(spark, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_classes(table(spark, folder, "documents"))
