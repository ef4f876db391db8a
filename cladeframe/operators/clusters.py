"""Strain clusters from pair distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.functions.scan import sorted_index
from cladeframe.operators.membership import inside_outside_pairs


def genome_pairs(genomes: DataFrame, name: str = "genome") -> DataFrame:
    """All unordered pairs (strain1 < strain2); the roster is the bounded side of the analysis."""
    a = genomes.select(F.col(name).alias("strain1")).distinct()
    b = genomes.select(F.col(name).alias("strain2")).distinct()
    return a.join(b, F.col("strain1") < F.col("strain2"))


def average_linkage_clusters(pairs: DataFrame, strains: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(strain, cluster) of average linkage cut at ``threshold``; the smallest member names a cluster.

    ``pairs`` (strain1, strain2, distance); a missing pair counts as distance 1. Average
    linkage is reducible, so all pairs of clusters that are each other's nearest can merge
    in one round and the tree stays the same. Only known pairs are stored (sum and number
    per cluster pair), and no component is ever gathered in one task.
    """
    members = cut(strains.select("strain").distinct().withColumn("cluster", F.col("strain")))
    one = F.lit(1).cast("long")
    edges = cut(pairs.filter(F.col("strain1") != F.col("strain2")).groupBy(
        F.least("strain1", "strain2").alias("c1"), F.greatest("strain1", "strain2").alias("c2")
    ).agg(F.avg("distance").alias("s")).withColumn("k", one).withColumn("n1", one).withColumn("n2", one))
    while True:
        cells = F.col("n1") * F.col("n2")
        mean = F.round((F.col("s") + (cells - F.col("k"))) / cells, 12)
        close = edges.withColumn("d", mean).filter(F.col("d") <= threshold)
        ends = close.select(
            F.explode(F.array("c1", "c2")).alias("c"),
            # equal distances are ordered by a hash, so that a tie does not serialise the merges
            F.struct("d", F.xxhash64("c1", "c2").alias("h"), "c1", "c2", (F.col("n1") + F.col("n2")).alias("n")).alias("e")
        )
        best = ends.groupBy("c").agg(F.min("e").alias("e"))
        merges = cut(best.groupBy("e.c1", "e.c2", "e.n").agg(F.count(F.lit(1)).alias("votes")).filter("votes = 2").select(
            F.col("c1").alias("into"), F.col("c2").alias("gone"), "n"
        ))
        if merges.isEmpty():
            return members
        renamed = merges.select(F.col("gone").alias("old"), "into", "n").unionByName(
            merges.select(F.col("into").alias("old"), "into", "n")
        )
        members = cut(members.join(merges.select(F.col("gone").alias("cluster"), "into"), "cluster", "left").select(
            "strain", F.coalesce("into", "cluster").alias("cluster")
        ))
        r1 = renamed.select(F.col("old").alias("c1"), F.col("into").alias("i1"), F.col("n").alias("m1"))
        r2 = renamed.select(F.col("old").alias("c2"), F.col("into").alias("i2"), F.col("n").alias("m2"))
        moved = edges.join(r1, "c1", "left").join(r2, "c2", "left").select(
            F.coalesce("i1", "c1").alias("a"), F.coalesce("i2", "c2").alias("b"),
            F.coalesce("m1", "n1").alias("na"), F.coalesce("m2", "n2").alias("nb"), "s", "k",
        ).filter(F.col("a") != F.col("b"))
        swap = F.col("a") > F.col("b")
        edges = cut(moved.select(
            F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"),
            F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("n1"),
            F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("n2"), "s", "k",
        ).groupBy("c1", "c2", "n1", "n2").agg(F.sum("s").alias("s"), F.sum("k").alias("k")))


def prune_divergent_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members still in a within-cluster pair closer than the mean divergence leaving the cluster.

    ``pairs`` (strain1, strain2, div). Clusters of one strain are dropped, and a cluster
    without outside pairs keeps all its pairs.
    """
    sized = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    used = members.join(sized, "cluster", "left_semi")
    sides = inside_outside_pairs(pairs, used, ["div"])
    outside = sides.filter(F.col("side") == "outside").groupBy("cluster").agg(F.avg("div").alias("mean_out"))
    kept = sides.filter(F.col("side") == "inside").join(outside, "cluster", "left").filter(
        F.col("mean_out").isNull() | (F.col("div") < F.col("mean_out"))
    )
    strains = kept.select("cluster", F.explode(F.array("strain1", "strain2")).alias("strain")).distinct()
    return used.join(strains, ["cluster", "strain"], "left_semi").select("cluster", "strain")


def renumber_with_singletons(members: DataFrame, strains: DataFrame, min_size: int = 3) -> DataFrame:
    """(strain, cluster, size, reported) with dense numbers: clusters by name first, then left-over strains."""
    left = strains.select("strain").distinct().join(members.select("strain"), "strain", "left_anti")
    named = members.select("strain", F.lit(0).alias("rank"), F.col("cluster").cast("string").alias("label")).unionByName(
        left.select("strain", F.lit(1).alias("rank"), F.col("strain").cast("string").alias("label"))
    )
    sizes = named.groupBy("rank", "label").agg(F.count(F.lit(1)).alias("size"))
    numbered = sorted_index(sizes, ["rank", "label"], "cluster")
    return named.join(numbered, ["rank", "label"]).select(
        "strain", "cluster", "size", (F.col("size") >= min_size).alias("reported")
    )
