"""Id lists, membership filters, lookups and set comparisons."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F


def pattern_membership_filter(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose field holds any pattern as a regex *substring* (``3`` also hits ``13``)."""
    return df.filter(F.col(column).cast("string").rlike("|".join(patterns)))


def literal_patterns(values: Sequence[str]) -> list[str]:
    """Quote plain texts for ``pattern_membership_filter``."""
    return [re.escape(v) for v in values]


def exact_membership_filter(df: DataFrame, ids: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """Rows with an id in the list, or (``keep=False``) the complement."""
    return df.join(ids.select(on), on, "left_semi" if keep else "left_anti")


def threshold_filter(
    df: DataFrame, column: str, above: float | None = None, below: float | None = None,
    magnitude_at_least: float | None = None,
) -> DataFrame:
    """Strict numeric cuts, and an inclusive cut on the absolute value."""
    value = F.col(column)
    tests = []
    if above is not None:
        tests.append(value > above)
    if below is not None:
        tests.append(value < below)
    if magnitude_at_least is not None:
        tests.append(F.abs(value) >= magnitude_at_least)
    return df.filter(reduce(lambda a, b: a & b, tests))


def roster_reconcile(wanted: DataFrame, available: DataFrame, on: str) -> DataFrame:
    """Every wanted id with status ``linked`` or ``missing``."""
    have = available.select(on).distinct().withColumn("__have", F.lit(True))
    return (
        wanted.select(on).distinct().join(have, on, "left")
        .select(on, F.when(F.col("__have"), "linked").otherwise("missing").alias("status"))
    )


def match_ids_exact_then_token(ids: DataFrame, samples: DataFrame, id_col: str, sample_col: str) -> DataFrame:
    """Match each id to a sample name exactly, else to a token occurring exactly once.

    Tokens are counted by occurrence, so one that is twice in a single name is ambiguous.
    """
    wanted = ids.select(F.col(id_col).alias("id")).distinct()
    names = samples.select(F.col(sample_col).alias("sample")).distinct()
    exact = wanted.join(names, F.col("id") == F.col("sample"), "left")
    found = exact.filter(F.col("sample").isNotNull()).select("id", "sample", F.lit("exact").alias("matched_by"))
    rest = exact.filter(F.col("sample").isNull()).select("id")
    tokens = (
        names.select("sample", F.explode(F.split("sample", "[^A-Za-z0-9]+")).alias("id"))
        .join(rest, "id", "left_semi")
        .groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample"))
        .filter("n = 1").select("id", "sample")
    )
    loose = rest.join(tokens, "id", "left").select(
        "id", "sample", F.when(F.col("sample").isNull(), "missing").otherwise("token").alias("matched_by")
    )
    return found.unionByName(loose)


def tree_year_group_join(tips: DataFrame, years: DataFrame, listed: DataFrame) -> DataFrame:
    """Dated tips with group ``listed`` / ``other``; ``tip`` is the shared key."""
    flag = listed.select("tip").distinct().withColumn("__in", F.lit(True))
    return (
        years.filter(F.col("year").isNotNull()).join(tips.select("tip"), "tip", "left_semi")
        .join(flag, "tip", "left")
        .select("tip", "year", F.when(F.col("__in"), "listed").otherwise("other").alias("grp"))
    )


def annotate_results(results: DataFrame, annotation: DataFrame, on: str, missing: str = "NOT_FOUND") -> DataFrame:
    """Left join gene annotations; ``informative`` marks a non-hypothetical text."""
    ann = annotation.select(on, "annotation", "gene_name", F.lit(True).alias("__hit"))
    text = F.coalesce(F.col("annotation"), F.lit(""))
    return results.join(ann, on, "left").select(
        *results.columns,
        F.when(F.col("__hit"), text).otherwise(missing).alias("annotation"),
        F.coalesce("gene_name", F.lit("")).alias("gene_name"),
        (F.col("__hit").isNotNull() & (text != "") & ~F.lower(text).contains("hypothetical")).alias("informative"),
    )


def merge_test_results(results: DataFrame, other: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Add a second test's columns as text, ``NA`` where the feature is absent there."""
    right = other.select(on, *[F.col(c).cast("string").alias(c) for c in columns])
    return results.join(right, on, "left").select(
        *results.columns, *[F.coalesce(c, F.lit("NA")).alias(c) for c in columns]
    )


def enrich_with_lookup(
    df: DataFrame, lookup: DataFrame, on: str, attribute: str, default: str = ""
) -> DataFrame:
    """Map a key to an attribute; unmatched keys take ``default``."""
    return df.join(lookup.select(on, attribute), on, "left").select(
        *df.columns, F.coalesce(F.col(attribute), F.lit(default)).alias(attribute)
    )


def inside_outside_pairs(pairs: DataFrame, members: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs per cluster with both ends in it (``inside``) or exactly one (``outside``).

    ``pairs`` has strain1, strain2; ``members`` has cluster, strain. A strain may be
    in several clusters.
    """
    cols = ["strain1", "strain2", *keep]
    ends = [
        pairs.select(*cols).join(
            members.select("cluster", F.col("strain").alias(end)), end
        ).select("cluster", *cols)
        for end in ("strain1", "strain2")
    ]
    return (
        ends[0].unionByName(ends[1]).groupBy("cluster", *cols).agg(F.count(F.lit(1)).alias("__n"))
        .select("cluster", *cols, F.when(F.col("__n") == 2, "inside").otherwise("outside").alias("side"))
    )


def snp_cluster_expansion(seeds: DataFrame, categories: DataFrame, dataset: DataFrame) -> DataFrame:
    """Per seed list: members, all dataset samples in the same categories, and the extra ones.

    ``seeds`` (grp, id), ``categories`` (id, category), ``dataset`` (id).
    """
    seed_rows = seeds.join(categories, "id")
    wanted = seed_rows.select("grp", "category").distinct()
    known = categories.join(dataset.select("id"), "id", "left_semi")
    in_seed = seeds.select("grp", "id").distinct().withColumn("__seed", F.lit(1))
    totals = (
        wanted.join(known, "category").join(in_seed, ["grp", "id"], "left")
        .groupBy("grp").agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("__seed").isNull()).alias("extra"),
        )
    )
    sizes = seed_rows.groupBy("grp").agg(F.count(F.lit(1)).alias("in_seed"))
    return sizes.join(totals, "grp", "left").select(
        "grp", "in_seed", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("extra", F.lit(0)).alias("extra")
    )


def expansion_extras(seeds: DataFrame, categories: DataFrame, dataset: DataFrame) -> DataFrame:
    """The extra samples themselves: (grp, id, category)."""
    wanted = seeds.join(categories, "id").select("grp", "category").distinct()
    known = categories.join(dataset.select("id"), "id", "left_semi")
    return wanted.join(known, "category").join(seeds.select("grp", "id"), ["grp", "id"], "left_anti")


def priority_group_assignment(lists: DataFrame, overwrite: bool = False) -> DataFrame:
    """(id, grp) where the first listed group wins, or with ``overwrite`` the last.

    ``lists`` has id, grp, priority (small = first).
    """
    best = F.max_by if overwrite else F.min_by
    return lists.groupBy("id").agg(best("grp", F.struct("priority", "grp")).alias("grp"))


def group_sizes(lists: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per group: ids in the list and ids finally assigned to it."""
    listed = lists.groupBy("grp").agg(F.count(F.lit(1)).alias("n_listed"))
    got = assigned.groupBy("grp").agg(F.count(F.lit(1)).alias("n_assigned"))
    return listed.join(got, "grp", "left").select(
        "grp", "n_listed", F.coalesce("n_assigned", F.lit(0)).alias("n_assigned")
    )


def call_agreement(calls: DataFrame, old_positive: DataFrame, positive: str = "pos") -> DataFrame:
    """Full comparison of new calls with an older positive list.

    ``calls`` (genome, status), ``old_positive`` (genome). Genomes only in the old
    list keep a null status.
    """
    old = old_positive.select("genome").distinct().withColumn("__old", F.lit(True))
    was = F.when(F.col("__old"), "pos").otherwise("neg")
    return calls.join(old, "genome", "full_outer").select(
        "genome", "status", was.alias("old_call"),
        F.when(F.col("status").isNotNull(), (was == "pos") == (F.col("status") == positive)).alias("agree"),
    )


def agreement_counts(agreement: DataFrame, positive: str = "pos") -> DataFrame:
    """One row of counts: agreeing, changed, positive only before, positive only now, unknown genomes."""
    now, before = F.col("status") == positive, F.col("old_call") == "pos"
    return agreement.agg(
        F.count_if(F.col("agree")).alias("n_agree"),
        F.count_if(~F.col("agree")).alias("n_changed"),
        F.count_if(before & ~F.coalesce(now, F.lit(False))).alias("n_only_old"),
        F.count_if(~before & now).alias("n_only_new"),
        F.count_if(F.col("status").isNull()).alias("n_unknown"),
    )


def sample_overlap(first: DataFrame, second: DataFrame, third: DataFrame, on: str = "id") -> DataFrame:
    """Three id sets: shared count and the five one-sided differences, each with a smallest example.

    One pass: every id carries three flags, so no set is scanned per difference.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [d.select(on).distinct().withColumn("src", F.lit(i)) for i, d in enumerate((first, second, third))],
    )
    flags = tagged.groupBy(on).agg(*[F.bool_or(F.col("src") == i).alias(f"s{i}") for i in range(3)])
    s0, s1, s2 = (F.col(f"s{i}") for i in range(3))
    checks = {
        "common": s0 & s1 & s2,
        "first_not_second": s0 & ~s1,
        "first_not_third": s0 & ~s2,
        "second_not_first": s1 & ~s0,
        "second_not_third": s1 & ~s2,
        "third_not_second": s2 & ~s1,
    }
    wide = flags.agg(
        *[
            F.struct(
                F.lit(name).alias("check"), F.count_if(test).alias("n"), F.min(F.when(test, F.col(on))).alias("example")
            ).alias(name)
            for name, test in checks.items()
        ]
    )
    return wide.select(F.inline(F.array(*checks)))


def labelled_union(sources: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Stack frames under a label column."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [d.withColumn(label, F.lit(name)) for name, d in sources.items()],
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Unpivot count columns."""
    return df.unpivot(list(ids), list(values), name, value)


def duplicate_check(df: DataFrame, *keys: str) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def top_k_by_pvalue(df: DataFrame, p: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k smallest p-values; a TakeOrdered, not a full sort."""
    return df.orderBy(p, *tie).limit(k)


def sample_metadata_table(
    samples: DataFrame, full: DataFrame, partial: DataFrame, groups: DataFrame
) -> DataFrame:
    """full / partial / absent, +/-, group by precedence and a 0/1 flag; overlapping lists raise.

    All frames are keyed by ``sample``; ``groups`` has sample, grp, priority and an
    overlap inside it is resolved by ``priority``.
    """
    def flag(d: DataFrame, name: str) -> DataFrame:
        return d.select("sample").distinct().withColumn(name, F.lit(True))

    first = groups.groupBy("sample").agg(F.min_by("grp", F.struct("priority", "grp")).alias("grp"))
    joined = (
        samples.select("sample").distinct().join(flag(full, "__f"), "sample", "left")
        .join(flag(partial, "__p"), "sample", "left").join(first, "sample", "left")
    )
    both = F.coalesce(F.col("__f") & F.col("__p"), F.lit(False))
    detail = (
        F.when(both, F.raise_error(F.concat(F.lit("in the full and the partial list: "), F.col("sample").cast("string"))))
        .when(F.col("__f"), "full").when(F.col("__p"), "partial").otherwise("absent")
    )
    return joined.withColumn("detail", detail).select(
        "sample", F.when(F.col("detail") == "absent", "-").otherwise("+").alias("carrier"), "detail",
        F.coalesce("grp", F.lit("other")).alias("grp"),
        F.when(F.col("detail") == "absent", 0).otherwise(1).alias("carrier_binary"),
    )


def phenotype_from_status(calls: DataFrame, annotated: DataFrame, partial: str = "exclude") -> DataFrame:
    """(genome, phenotype) over annotated genomes: pos→1, neg→0, anything else by ``partial``."""
    other = {"exclude": F.lit(None).cast("int"), "pos": F.lit(1), "neg": F.lit(0)}[partial]
    value = F.when(F.col("status") == "pos", 1).when(F.col("status") == "neg", 0).otherwise(other)
    return (
        calls.join(annotated.select("genome").distinct(), "genome", "left_semi")
        .select("genome", value.alias("phenotype")).filter(F.col("phenotype").isNotNull())
    )


def collapse_levels(df: DataFrame, column: str, max_levels: int = 8, tie: str = "asc") -> DataFrame:
    """Add ``level``: beyond ``max_levels`` values only the ``max_levels - 1`` most frequent keep their name.

    Blank, ``nan`` and ``NA`` become ``NA``. The kept list has at most ``max_levels``
    rows, so the join back is against a bounded table.
    """
    value = F.col(column).cast("string")
    blank = value.isNull() | value.isin("", "nan", "NA")
    counts = df.filter(value.isNotNull()).groupBy(value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.orderBy(F.desc("__n"), F.asc("__v")).limit(max_levels + 1)
    ranked = top.withColumn("__r", F.row_number().over(W.orderBy(F.desc("__n"), F.asc("__v"))))
    seen = ranked.withColumn("__m", F.max("__r").over(W.partitionBy(F.lit(1))))
    kept = seen.filter((F.col("__m") <= max_levels) | (F.col("__r") <= max_levels - 1)).select("__v")
    out = df.withColumn("__v", value).join(F.broadcast(kept.withColumn("__k", F.lit(True))), "__v", "left")
    return out.select(
        *df.columns, F.when(blank, "NA").when(F.col("__k"), value).otherwise("Other").alias("level")
    )
