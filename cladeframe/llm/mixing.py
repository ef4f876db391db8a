"""Mixing sources to target weights.

The words of a source, its documents laid end to end, are packed into blocks of fixed length. The slots a
source is owed are dealt to the output shards by multinomial draws (given its total, so targets are met),
and slot k takes the block at the k-th place of a keyed permutation of the source's block indices. Slots
meet blocks by an equi-join on (source, block); no text is moved to find out what the mix takes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.functions.scan import prefix_scan
from cladeframe.llm.common import bucket_of, permuted, quantile_cuts, seed_of, tasks

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Share ``budget`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    target, free, rest = [0.0] * len(sizes), list(range(len(sizes))), budget
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if not total or rest * weights[i] / total > most * sizes[i]]
        for i in over or free:
            target[i] = most * sizes[i] if over else rest * weights[i] / total
        if not over:
            break
        rest -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def deal(total: int, shard: int, shards: int, seed: int) -> tuple[int, int]:
    """(first slot, slots) of one shard when ``total`` slots fall on the shards at random.

    Halving binomial draws, each seeded by its range, give every shard its own part of one multinomial draw.
    """
    low, high, first = 0, shards, 0
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=seed_of(seed, low, high)))
        left = int(rng.binomial(total, (mid - low) / (high - low))) if total else 0
        if shard < mid:
            high, total = mid, left
        else:
            low, first, total = mid, first + left, total - left
    return first, total


@dataclass
class Mix:
    """sources: (src, source, source_size, target); pieces: one row per document and block; slots: one per block drawn."""

    sources: DataFrame
    placed: DataFrame
    pieces: DataFrame
    slots: DataFrame
    block_words: int

    def taken(self) -> DataFrame:
        """doc columns with ``taken``: the words that the drawn slots take of each row, repeats counted."""
        used = self.slots.groupBy("src", "block").agg(
            F.sum(F.when(F.col("whole"), 1).otherwise(0)).alias("full"),
            F.coalesce(F.max(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("trim"),
        )
        part = F.greatest(F.least(F.col("at") + F.col("len"), F.col("trim")) - F.col("at"), F.lit(0))
        # The slots start from a range, whose planned size is far too small for a broadcast to be decided by it.
        hits = self.pieces.join(used.hint("merge"), ["src", "block"]).withColumn("got", F.col("len") * F.col("full") + part)
        by_row = hits.groupBy("src", "start").agg(F.sum("got").alias("taken"))
        filled, empty = self.placed.filter("size > 0"), self.placed.filter("size = 0")
        rows = filled.join(by_row, ["src", "start"], "left").unionByName(empty.withColumn("taken", F.lit(0).cast("long")))
        return rows.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def blocks(self, docs: DataFrame) -> DataFrame:
        """(shard, position, source, text): the mixed blocks themselves, words joined by one space."""
        words = F.split(F.regexp_replace(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " +", " "), " ")
        texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words.alias("w")).dropDuplicates(["doc_id", "h"])
        cutouts = self.pieces.join(self.placed.select("src", "start", "doc_id", "h").filter("size > 0"), ["src", "start"]).join(
            texts.withColumnsRenamed({"doc_id": "d2", "h": "h2"}), F.expr("doc_id <=> d2 and h <=> h2")
        ).select("src", "block", "at", F.slice("w", (F.col("from") + 1).cast("int"), F.col("len").cast("int")).alias("w"))
        whole = cutouts.groupBy("src", "block").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])).alias("w")
        )
        return self.slots.hint("merge").join(whole, ["src", "block"]).join(self.sources, "src").select(
            "shard", "position", "source", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text")
        )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
    block_words: int = 64, shard_slots: int = 65_536, seed: int = 17,
) -> Mix:
    """Mix ``docs`` (doc_id, text, source) to ``share`` times their words, split by the repeating ``weights``.

    Sources go by code point, null last. Words are runs of anything but ASCII white space. Inside an epoch a
    source's full blocks come in permuted order and its short last block at the end; the last slot is trimmed
    so that a source gives its target to the word. As no target passes ``most`` (a whole number) times the
    size, no block is drawn more often than that.

    Null or empty texts have no words and are never taken; repeated rows count one by one; an empty table
    gives empty results; other columns of ``docs`` are ignored. One row per source reaches the driver: the
    sources are the settings of the mix, not its data.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sized = cut(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("h")))
    totals = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    sources = spark.createDataFrame(
        [(i, s, n, t) for i, ((s, n), t) in enumerate(zip(totals, target))], "src int, source string, source_size long, target double"
    )
    plan = []
    for i, (n, t) in enumerate(zip(sizes, target)):
        epochs, rest = divmod(round(t), n) if n else (0, 0)
        blocks = -(-n // block_words)
        plan.append((i, n, blocks, epochs * blocks + -(-rest // block_words), rest % block_words))
    slots_all = sum(p[3] for p in plan)
    shards = max(1, -(-slots_all // shard_slots))

    cuts, _ = quantile_cuts(sized, F.col("doc_id").cast("long"), 4 * tasks(spark))
    named = sized.alias("d").join(
        sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
    ).select("src", "doc_id", "d.source", "source_size", "target", "size", "h", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("o"))
    placed = cut(prefix_scan(
        named, ["src"], ["o", "h", "size"], bucket_of(F.col("o"), cuts).cast("long"), {"start": ("sum", "size")}
    ).withColumn("start", F.col("start").cast("long")).drop("o"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.filter("size > 0").select("src", "start", "size", F.explode(F.sequence(first, last)).alias("block")).select(
        "src", "start", "block",
        (F.greatest(F.col("start"), F.col("block") * block_words) - F.col("block") * block_words).alias("at"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)).alias("len"),
        (F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start")).alias("from"),
    )

    def draw(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                parts, at = [(p, *deal(p[3], int(shard), shards, seed_of(seed, p[0]))) for p in plan], 0
                total = sum(n for *_, n in parts)
                for (src, words, blocks, owed, trim), first_slot, n in parts:
                    if not n:
                        continue
                    slot = np.arange(first_slot, first_slot + n, dtype=np.int64)
                    epoch, i = slot // blocks, slot % blocks
                    block, full = i.copy(), words // block_words
                    for e in np.unique(epoch):
                        own = (epoch == e) & (i < full)
                        block[own] = permuted(i[own], full, seed_of(seed, src, int(e), 1))
                    length = np.where(block < full, block_words, words - full * block_words)
                    whole = ~((slot == owed - 1) & (trim > 0))
                    yield pd.DataFrame({
                        "shard": int(shard), "position": permuted(np.arange(at, at + n), total, seed_of(seed, int(shard), 2)),
                        "src": src, "block": block, "words": np.where(whole, length, trim), "whole": whole,
                    })
                    at += n

    slots = spark.range(shards).repartition(min(shards, 16 * tasks(spark))).mapInPandas(
        draw, "shard long, position long, src int, block long, words long, whole boolean"
    )
    return Mix(sources, placed, pieces, slots, block_words)


def op3(spark, folder: str) -> DataFrame:
    """Words the 150 % mix takes of every document; its order and seed are fixed, so reruns agree."""
    from cladeframe.llm.common import table

    return mix(table(spark, folder, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")
