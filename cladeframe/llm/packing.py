"""Best-fit packing of token pieces into sequences, after a Martello-Toth dominance reduction.

There are only ``capacity`` different lengths, so the instance that the packer solves is a histogram. The
reduction fixes sets that provably dominate every other set with the same largest piece, whole classes at a
time; best-fit decreasing packs the rest, also by classes. The outcome is a short list of runs, "ranks r0 …
of length w go to sequences s0 …", and every piece finds its place from its rank inside its length class.
Ranks come from counts per (task, length): no piece and no class is gathered anywhere.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.llm.common import bounded_batches, table


class UnitEncoder(dict):
    """Ids of the byte-level vocabulary as little-endian bytes, remembered per unit (a word with its space).

    No merge of this vocabulary crosses a space that follows a non-space, so a text is the chain of its units.
    Texts in which white space precedes a space are encoded whole. The rank file is the same vocabulary as the
    ``tokenizers`` file and its encoder several times faster; tests hold their ids against each other. Texts
    with the string of the special token go to ``tokenizers`` itself, which alone knows it.
    """

    def __init__(self, vocabulary: str, remembered: int = 300_000):
        import public_tokenizers as names
        import tiktoken

        with open(os.path.splitext(vocabulary)[0] + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=names.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.vocabulary, self.remembered, self.exact = vocabulary, remembered, None
        self.bound = re.compile(r"\s |\x00|<\|endoftext\|>")

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.ordinary(unit), "<u4").tobytes()
        if len(self) < self.remembered:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if found := self.bound.search(text):
            if "<|endoftext|>" not in text:
                return np.array(self.ordinary(text), "<u4").tobytes()
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.vocabulary)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").split("\x00")))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): pieces with their rank ``nth`` among equals of a task."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder, seen, part = UnitEncoder(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        closing = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows, ids_of = [], []
            for doc, text in zip(pdf["k"], pdf["text"]):
                doc = None if doc is None else int(doc)
                ids = encoder.encode(text) + closing
                n = len(ids) // 4
                begin = 0
                for piece, end in enumerate(range(n % capacity or min(n, capacity), n + 1, capacity)):
                    length = end - begin
                    ids_of.append(doc)
                    rows.append((piece, begin, length, zlib.crc32(memoryview(ids)[4 * begin:4 * end]), part, seen[length]))
                    seen[length] += 1
                    begin = end
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "part", "nth"])
            out.insert(0, "doc_id", pd.array(ids_of, dtype="Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("k"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )


def dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Fixed sets as (how many, lengths) and what is left of the histogram.

    Pieces j are tried from the largest down, their partners being all pieces not yet fixed. With room r beside
    j, the largest piece k that fits dominates every set with j when it fills r, when no two pieces fit into r,
    or when no three fit and k is no shorter than any two that fit: each such set can give its other pieces
    for k. j alone is fixed when nothing fits. Equal pieces are fixed together.
    """
    left, fixed, sizes = dict(counts), [], sorted(counts)

    def partner(j: int) -> int | None:
        """The dominating partner of j, 0 where j stays alone, None where nothing is proven."""
        room = capacity - j
        fits = [w for w in sizes[:bisect_left(sizes, room + 1)] if left[w] > (w == j)]
        if not fits:
            return 0
        k, low = fits[-1], fits[0]
        spare = lambda w: left[w] - (w == j)
        second = low if spare(low) > 1 else fits[1] if len(fits) > 1 else capacity
        if k == room or low + second > room:
            return k
        third = low if spare(low) > 2 else second if low != second and spare(second) > 1 else next((w for w in fits if w > second), capacity)
        if low + second + third <= room:
            return None
        best, high = 0, len(fits) - 1
        for i, a in enumerate(fits):
            while high > i and fits[high] + a > room:
                high -= 1
            if high > i or high == i and spare(a) > 1 and 2 * a <= room:
                best = max(best, a + fits[high])
            if high <= i:
                break
        return k if best <= k else None

    for j in sorted(counts, reverse=True):
        while left.get(j) and (k := partner(j)) is not None:
            lengths = [j, k] if k else [j]
            n = left[j] // 2 if k == j else min(left[w] for w in lengths)
            fixed.append((n, lengths))
            for w in lengths:
                left[w] -= n
            for w in set(lengths):
                if not left[w]:
                    del left[w], sizes[bisect_left(sizes, w)]
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int, first: int = 0) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing by length class: runs (length, pieces, per sequence, first sequence, sequences, offset).

    Open sequences of equal room are kept as ranges, so the work depends on the number of lengths only.
    """
    runs, open_ranges, rooms, n_seq = [], defaultdict(list), [], first

    def put_back(room: int, begin: int, n: int) -> None:
        if n and room:
            if not open_ranges[room]:
                insort(rooms, room)
            open_ranges[room].append((begin, n))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                begin, m = open_ranges[room].pop()
                if not open_ranges[room]:
                    rooms.pop(at)
            else:
                room, begin, m = capacity, n_seq, -(-n // (capacity // w))
                n_seq += m
            per = room // w
            full = min(m, n // per)
            if full:
                runs.append((w, full * per, per, begin, full, capacity - room))
                put_back(room - per * w, begin, full)
                n -= full * per
            if full < m and n:
                runs.append((w, n, n, begin + full, 1, capacity - room))
                put_back(room - n * w, begin + full, 1)
                full, n = full + 1, 0
            put_back(room, begin + full, m - full)
    return runs, n_seq


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """All runs with the first rank each takes of its length class, and the number of sequences."""
    fixed, rest = dominated(counts, capacity)
    runs, n_seq = [], 0
    for n, lengths in fixed:
        offset = 0
        for w in lengths:
            runs.append((w, n, 1, n_seq, n, offset))
            offset += w
        n_seq += n
    more, n_seq = best_fit(rest, capacity, n_seq)
    out = pd.DataFrame(runs + more, columns=["length", "pieces", "per", "sequence", "sequences", "offset"]).astype("int64")
    out["rank"] = out.groupby("length")["pieces"].cumsum() - out["pieces"]
    return out.sort_values(["length", "rank"], ignore_index=True), n_seq


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A null text is an empty one and makes a piece of the end id alone; texts longer than ``capacity`` ids are
    cut into full pieces after a first one that may be shorter. Repeated rows are packed one by one, a null
    doc_id stays null, an empty table gives no rows, and other columns are ignored. The driver sees one count
    per length, ``capacity`` numbers at most.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, vocabulary, capacity, end_id))
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = cut(per_task.withColumn("before", F.coalesce(
        F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    columns = {c: runs[c].to_numpy() for c in runs}
    first = (columns["length"] << 44) + columns["rank"]  # lengths and ranks in one sorted key: 2^19 lengths, 2^44 pieces of each
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(first, (length << np.int64(44)) + rank, side="right") - 1
            inside = rank - columns["rank"][at]
            sequence = columns["sequence"][at] + inside // columns["per"][at]
            offset = columns["offset"][at] + inside % columns["per"][at] * columns["length"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    # by merging: the counts grow with the number of tasks, so they are not sent to every executor
    return pieces.join(before.drop("n").hint("merge"), ["part", "length"]).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5(spark, folder: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 1024 ids."""
    return pack(table(spark, folder, "documents"))
