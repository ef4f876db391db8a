"""Ranked lexical search turned round: the items are indexed, the documents stream past.

An inverted index over the items' terms is broadcast, in blocks of a fixed size. Each task counts the terms of its
documents, keeps the counts of indexed terms only, and, once the statistics of all documents are known, adds every
document's gains to the items that hold its terms and keeps a bounded heap for each item. Heaps are merged in two
steps. No document meets an item without a common term, and what a task holds depends on the block alone.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.functions.scan import prefix_scan, sorted_index
from cladeframe.llm.common import table

#: Digits, letters and every byte above ASCII belong to terms; only A-Z are lower-cased; all else separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Most items and most (item, term) pairs of one block of the index, the last item's own terms besides.
ITEMS, POSTINGS = 4096, 1 << 20
STEP = 1 << 20
COUNTS = "doc_id long, words long, terms array<int>, times array<long>"
HEAPS = "item long, doc_id long, score long"


def words_of(data: bytes, step: int = STEP) -> Counter:
    """How often each term occurs in a UTF-8 text, read piece by piece."""
    found, rest = Counter(), b""
    for at in range(0, len(data), step):
        piece = rest + data[at:at + step].translate(LETTERS)
        end = len(piece) if at + step >= len(data) else piece.rfind(b" ") + 1
        found.update(piece[:end].split())
        rest = piece[end:]
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """(item, block, term, times): the terms of numbered items (item, text), in blocks of bounded size."""

    def run(batches):
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text or b"")
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item", "term", "times"])

    terms = cut(items.select("item", F.col("text").cast("binary").alias("text")).mapInArrow(run, "item long, term binary, times long"))
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    begun = prefix_scan(sizes, [], ["item"], F.expr(f"item div {ITEMS}"), {"upto": ("sum", "n")})
    block = F.struct(F.expr(f"item div {ITEMS}").alias("a"), F.expr(f"upto div {POSTINGS}").alias("b"))
    return cut(terms.join(begun.select("item", block.alias("block")), "item"))


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """COUNTS of every document: all its terms' number, and the counts of the terms in the broadcast ``vocabulary``."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            words, terms, times, ends = [], [], [], [0]
            for text in batch.column(1):
                found = words_of(text.as_py() or b"")
                words.append(found.total())
                for word in known.keys() & found.keys():
                    terms.append(known[word])
                    times.append(found[word])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(words, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
            ], ["doc_id", "words", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, COUNTS)


def stream_heaps(counts: DataFrame, index, n_docs: int, n_words: int, k: int, slice_docs: int = 256) -> DataFrame:
    """HEAPS: the ``k`` best documents of every item that each task saw, scores above 0."""

    def run(batches):
        start, post_item, post_weight, items = index.value
        length = np.diff(start)
        heaps, least = [[] for _ in items], np.ones(len(items), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_docs):
                part = batch.slice(at, slice_docs)
                ids, words = part.column(0).to_pylist(), part.column(1).to_pylist()
                ends = part.column(2).offsets.to_numpy()
                terms, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(len(ids)), np.diff(ends))
                damp = np.array([75 + 25 * n * n_docs // n_words if n_words else 75 for n in words], np.int64)
                gain = 1_000_000_000 * times // (1000 * times + 12 * damp[doc])
                many = length[terms]
                row = np.repeat(np.arange(len(terms)), many)
                post = start[terms][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                scores = np.zeros(len(ids) * len(items), np.int64)
                np.add.at(scores, doc[row] * len(items) + post_item[post], gain[row] * post_weight[post])
                scores = scores.reshape(len(ids), len(items))
                for d, q in zip(*np.nonzero(scores >= least)):
                    entry = (int(scores[d, q]), -ids[d] if ids[d] is not None else -(1 << 64))
                    heap = heaps[q]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[q] = heap[0][0]
        best = [(items[q], -order if order > -(1 << 64) else None, score) for q, heap in enumerate(heaps) for score, order in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*best) if best else ([], [], []))], ["item", "doc_id", "score"])

    return counts.mapInArrow(run, HEAPS)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of every item (item_id, text).

    Equal scores go by ascending doc_id, rows without an id last. Rows of ``items`` are items of their own, also where
    ids or texts repeat or are null; repeated documents are ranked as often as they come. Null and empty texts have no
    terms; they count for no statistic and are never found. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    numbered = sorted_index(items.select("item_id", "text"), ["item_id", "text"], "item").withColumn("item", F.col("item") - 1)
    numbered = cut(numbered)
    terms = item_terms(numbered)
    found = []
    for block in [r["block"] for r in terms.select("block").distinct().collect()]:
        rows = terms.filter((F.col("block.a") == block["a"]) & (F.col("block.b") == block["b"])).select("item", "term", "times").toArrow()
        names, places = rows["term"].combine_chunks().dictionary_encode(), rows["item"].combine_chunks().dictionary_encode()
        vocabulary = {bytes(t): i for i, t in enumerate(names.dictionary.to_pylist())}
        counts = cut(count_terms(docs, spark.sparkContext.broadcast(vocabulary)))
        total = counts.agg(F.count_if(F.col("words") > 0).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("l")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        term, times = names.indices.to_numpy(), rows["times"].to_numpy()
        order = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
        index = (start, places.indices.to_numpy()[order].astype(np.int64), (weight[term] * times)[order], places.dictionary.to_pylist())
        found.append(stream_heaps(counts, spark.sparkContext.broadcast(index), total["n"], total["l"], k))
    if not found:
        return numbered.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    heaps = found[0]
    for more in found[1:]:
        heaps = heaps.unionByName(more)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = heaps.withColumn("slot", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(W.partitionBy("item", "slot").orderBy(*best))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13(spark, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same rows from the tables themselves.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM sizes, total),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
