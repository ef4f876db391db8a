"""Presence / absence of features over samples, and what is counted from it.

The matrix is always the long table of present cells plus a sample roster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladeframe.functions.labels import feature_class, is_partial
from cladeframe.functions.scan import sorted_index


def classify_hits(hits: DataFrame, drop_partial: bool = True, drop_classes: Sequence[str] = ()) -> DataFrame:
    """Add ``feature_class``; drop truncated hits and unwanted classes."""
    out = hits.withColumn("feature_class", feature_class(F.col("type"), F.col("subtype"), F.col("method")))
    if drop_partial:
        out = out.filter(~is_partial(F.col("method")))
    if drop_classes:
        out = out.filter(~F.col("feature_class").isin(*drop_classes))
    return out


def presence_absence(hits: DataFrame, roster: DataFrame) -> DataFrame:
    """Present cells (sample, feature, present = 1); a sample without hits keeps one row with 0."""
    cells = hits.select("sample", "feature").distinct()
    return roster.select("sample").distinct().join(cells, "sample", "left").select(
        "sample", "feature", F.when(F.col("feature").isNull(), 0).otherwise(1).alias("present")
    )


def feature_info(hits: DataFrame, n_samples: Column, modal: Sequence[str]) -> DataFrame:
    """Per feature: modal annotations (ties → smallest), genomes, percent, total hits.

    Genomes are counted apart from the modes, whose value maps would otherwise travel with every (feature, sample).
    """
    annotated = hits.groupBy("feature").agg(
        *[F.coalesce(F.mode(c, True), F.lit("")).alias(c) for c in modal], F.count(F.lit(1)).alias("n_hits_total")
    )
    genomes = hits.groupBy("feature").agg(F.count_distinct("sample").alias("n_genomes"))
    return annotated.join(genomes, "feature").select(
        "feature", *modal, "n_genomes", "n_hits_total", F.round(100 * F.col("n_genomes") / n_samples, 2).alias("pct_genomes")
    )


def burden_per_sample(hits: DataFrame, roster: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Acquired genes, point mutations and drug classes per sample; zeros stay.

    ``EFFLUX`` is neither an acquired gene nor a drug class.
    """
    amr = hits.filter(F.col("type") == "AMR")
    if ignore:
        amr = amr.filter(~F.col("feature").isin(*ignore))
    kind = F.col("feature_class")
    drugs = F.filter(F.transform(F.split("class", "/"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "EFFLUX"))
    gene = F.when((kind == "AMR") & (F.coalesce("class", F.lit("")) != "EFFLUX"), F.col("feature"))
    counts = amr.groupBy("sample").agg(
        F.count_distinct(gene).alias("n_amr_genes"),
        F.count_distinct(F.when(kind == "POINT", F.col("feature"))).alias("n_point_mutations"),
    )
    # The class vocabulary is a short fixed list, so a per-sample set stays small.
    classes = (
        amr.select("sample", F.explode(drugs).alias("drug")).distinct()
        .groupBy("sample").agg(F.array_sort(F.collect_set("drug")).alias("drugs"))
    )
    n_classes = F.coalesce(F.size("drugs"), F.lit(0))
    zero = F.lit(0)
    return (
        roster.select("sample").distinct().join(counts, "sample", "left").join(classes, "sample", "left")
        .select(
            "sample",
            F.coalesce("n_amr_genes", zero).alias("n_amr_genes"),
            F.coalesce("n_point_mutations", zero).alias("n_point_mutations"),
            F.when(F.col("drugs").isNull(), 0).otherwise(n_classes).alias("n_drug_classes"),
            F.when(F.col("drugs").isNotNull() & (n_classes >= 3), 1).otherwise(0).alias("mdr"),
            F.coalesce(F.array_join("drugs", ";"), F.lit("")).alias("drug_classes"),
        )
    )


def burden_by_group(burden: DataFrame, groups: DataFrame) -> DataFrame:
    """Quartiles of the three counts and the MDR share, per group."""
    joined = burden.join(groups.select("sample", "grp"), "sample")
    quart = {}
    for c in ("n_amr_genes", "n_drug_classes", "n_point_mutations"):
        quart[c] = F.percentile(c, [0.25, 0.5, 0.75])
    out = joined.groupBy("grp").agg(
        *[q.alias(c) for c, q in quart.items()],
        F.count(F.lit(1)).alias("n"), (100 * F.avg("mdr")).alias("mdr_pct"),
    )
    cols = [
        F.col(c)[i].alias(f"{c}_{name}") for c in quart for i, name in enumerate(("q1", "median", "q3"))
    ]
    return out.select("grp", "n", *cols, "mdr_pct")


def prevalence_by_group(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Long (feature, grp, n, pct, max_diff_pct); absent combinations count as zero.

    ``groups`` (sample, grp); samples without a group are left out. Groups are numbered and every feature meets them
    by number, so any number of groups will do; the table has the size of its answer, features x groups.
    """
    named = groups.filter(F.col("grp").isNotNull())
    sizes = sorted_index(named.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), ["grp"], "no")
    last = sizes.agg(F.max("no")).scalar()
    per = cells.join(named, "sample").groupBy("feature", "grp").agg(F.count(F.lit(1)).alias("n"))
    spread = per.groupBy("feature").agg(F.max(last).alias("last"))
    grid = spread.select("feature", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("no")).join(sizes, "no")
    long = grid.join(per, ["feature", "grp"], "left").select("feature", "grp", F.coalesce("n", F.lit(0)).alias("n"), "size").withColumn(
        "pct", 100 * F.col("n") / F.col("size"))
    w = W.partitionBy("feature")
    return long.withColumn("max_diff_pct", F.max("pct").over(w) - F.min("pct").over(w)).drop("size")


def select_informative_genes(
    cells: DataFrame, groups: DataFrame, min_genomes: int = 2, max_prevalence: float = 0.99, top_n: int = 50,
) -> DataFrame:
    """Top features by prevalence difference with the group they are enriched in.

    Ranked by (block, −difference); ties of the maximum go to the first group.
    """
    keep = _prevalence_window(cells, groups, min_genomes, max_prevalence)
    prev = prevalence_by_group(cells.join(keep, "feature", "left_semi"), groups)
    best = prev.groupBy("feature").agg(
        F.max("max_diff_pct").alias("max_diff_pct"),
        F.min_by("grp", F.struct(-F.col("pct"), F.col("grp"))).alias("enriched_in"),
    )
    return best.orderBy(F.desc(F.round("max_diff_pct", 9)), "feature").limit(top_n).orderBy(
        "enriched_in", F.desc("max_diff_pct"), "feature"
    )


def select_variable_genes(
    cells: DataFrame, roster: DataFrame, min_genomes: int = 2, max_prevalence: float = 0.99, top_n: int = 50
) -> DataFrame:
    """Without a grouping: the features closest to half of the samples."""
    keep = _prevalence_window(cells, roster, min_genomes, max_prevalence)
    total = roster.agg(F.count_distinct("sample")).scalar()
    return (
        keep.withColumn("pct", 100 * F.col("n") / total)
        .orderBy(F.round(F.abs(F.col("pct") - 50), 9), "feature").limit(top_n)
    )


def select_listed_genes(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """An explicit feature list with its genome counts; unknown names are left out."""
    counts = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return wanted.select("feature").distinct().join(counts, "feature")


def _prevalence_window(cells, roster, min_genomes, max_prevalence):
    total = roster.agg(F.count_distinct("sample")).scalar()
    counts = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= min_genomes) & (F.col("n") <= max_prevalence * total))


def heatmap_feature_order(
    info: DataFrame, n_samples: Column, blocks: Sequence[str], min_genomes: int = 1, drop_core: bool = False
) -> DataFrame:
    """Features ordered by class block, drug class and falling prevalence."""
    keep = info.filter((F.col("n_genomes") >= min_genomes) & F.col("feature_class").isin(*blocks))
    if drop_core:
        keep = keep.filter(F.col("n_genomes") < 0.99 * n_samples)
    rank = F.array_position(F.array(*[F.lit(b) for b in blocks]), F.col("feature_class"))
    return keep.withColumn("block_no", rank).orderBy("block_no", "class", F.desc("n_genomes"), "feature")


def unique_patterns_threshold(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Distinct presence patterns and alpha / n.

    A pattern is recognised by its size and two 64-bit set hashes (xor and sum), so
    no sample list is ever gathered for a feature.
    """
    h = F.xxhash64("sample")
    second = F.xxhash64(F.lit(7), F.col("sample"))
    prints = cells.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
        F.sum(second.cast("decimal(20,0)")).alias("s"),
    )
    return prints.select("n", "x", "s").distinct().agg(F.count(F.lit(1)).alias("n_patterns")).withColumn(
        "threshold", F.lit(alpha) / F.nullif("n_patterns", F.lit(0))
    )


def share_within_group(df: DataFrame, group: str, detail: str) -> DataFrame:
    """Counts by two keys and the share of the first; the window runs on the counts only."""
    n = df.groupBy(group, detail).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def carriage_rate(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Percent of each group's samples carrying a feature (each sample counted once)."""
    totals = groups.groupBy("grp").agg(F.count_distinct("sample").alias("total"))
    n = (
        cells.select("sample", "feature").distinct().join(groups.select("sample", "grp").distinct(), "sample")
        .groupBy("grp", "feature").agg(F.count(F.lit(1)).alias("n"))
    )
    return n.join(totals, "grp").withColumn("pct", 100 * F.col("n") / F.col("total"))


def cluster_purity(df: DataFrame, cluster: str, label: str, none: str = "none") -> DataFrame:
    """Members in any labelled group and the share of the dominant one, per cluster."""
    n = df.filter(F.col(label) != none).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(cluster).agg(
        F.sum("n").alias("n_labelled"), (F.max("n") / F.sum("n")).alias("dominant_share")
    )


def contingency_with_totals(df: DataFrame, row: str, column: str, total: str = "total") -> DataFrame:
    """Cross table in long form with marginal totals (a cube)."""
    cube = df.groupBy(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return cube.cube("row", "column").agg(
        F.sum("n").alias("n"), F.grouping("row").alias("gr"), F.grouping("column").alias("gc")
    ).select(
        F.when(F.col("gr") == 1, total).otherwise(F.col("row")).alias("row"),
        F.when(F.col("gc") == 1, total).otherwise(F.col("column")).alias("column"), "n",
    )
