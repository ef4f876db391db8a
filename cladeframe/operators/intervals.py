"""Half-open intervals (start, end) per key, contig labels and genome summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladeframe.functions.scan import prefix_scan


def merge_intervals(df: DataFrame, keys: Sequence[str], bucket_width: int = 1_000_000) -> DataFrame:
    """Union of overlapping or touching intervals: (keys, start, end).

    Intervals sharing a start are first reduced to the longest, map-side. The running
    maximum of earlier ends then goes bucket by bucket of ``start``, so a key holding
    a third of all intervals is spread over its buckets.
    """
    keys = list(keys)
    longest = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    # one bucket column for both scans: the second finds the rows already placed by it
    longest = longest.withColumn("__slot", F.floor(F.col("start") / bucket_width))
    bucket = "__slot"
    seen = prefix_scan(longest, keys, ["start"], bucket, {"reach": ("max", "end")})
    opened = seen.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
    labelled = prefix_scan(opened, keys, ["start"], bucket, {"island": ("sum", "opens")}, inclusive=True)
    return labelled.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merged_length(df: DataFrame, keys: Sequence[str], bucket_width: int = 1_000_000) -> DataFrame:
    """Covered length and number of islands per key."""
    return merge_intervals(df, keys, bucket_width).groupBy(*keys).agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("n_islands")
    )


def complement_intervals(
    spans: DataFrame, removed: DataFrame, keys: Sequence[str], bucket_width: int = 1_000_000
) -> DataFrame:
    """Parts of each span (keys, start, end) not covered by its removed intervals; empty parts dropped.

    ``spans`` has one row per key.
    """
    keys = list(keys)
    merged = merge_intervals(removed, keys, bucket_width)
    whole = spans.select(*keys, F.col("start").alias("s0"), F.col("end").alias("e0"))
    clipped = merged.join(whole, keys).select(
        *keys, F.greatest("start", "s0").alias("start"), F.least("end", "e0").alias("end")
    ).filter("start < end")
    head = spans.select(*keys, F.col("start"), F.col("start").alias("end"), F.col("end").alias("limit"))
    marks = head.unionByName(clipped.withColumn("limit", F.lit(None).cast("long")))
    # The part after each removal runs to the next start; the head row stands before the first.
    order = marks.withColumn("__o", F.when(F.col("limit").isNull(), 1).otherwise(0))
    nxt = prefix_scan(
        order, keys, ["start", "__o"], F.floor(F.col("start") / bucket_width),
        {"next": ("min", F.when(F.col("__o") == 1, F.col("start")))}, descending=True,
    )
    return nxt.join(whole.select(*keys, "e0"), keys).select(
        *keys, F.col("end").alias("start"), F.coalesce("next", "e0").alias("stop")
    ).filter("start < stop").withColumnRenamed("stop", "end")


def contig_consensus_label(
    contigs: DataFrame, hits: DataFrame, calls: DataFrame, min_coverage: float = 0.5, min_length: int = 10000,
    bucket_width: int = 1_000_000,
) -> DataFrame:
    """One label per contig from its aligned share and the votes of three callers.

    ``contigs`` (genome, contig, length), ``hits`` (genome, contig, start, end) on the
    contig, ``calls`` (genome, contig, tool).
    """
    cover = merged_length(hits, ["genome", "contig"], bucket_width).select("genome", "contig", "covered")
    votes = calls.groupBy("genome", "contig").agg(F.count_distinct("tool").alias("votes"))
    share = F.coalesce(F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), F.col("length")), F.lit(0.0))
    n = F.coalesce("votes", F.lit(0))
    return (
        contigs.join(cover, ["genome", "contig"], "left").join(votes, ["genome", "contig"], "left")
        .select(
            "genome", "contig", "length", share.alias("aligned_share"), n.alias("votes"),
            F.when((share >= min_coverage) & (F.col("length") >= min_length), "pESI")
            .when(share >= min_coverage, "pESI_short").when(n >= 2, "plasmid_other")
            .when(n == 1, "uncertain").otherwise("chromosome").alias("label"),
        )
    )


def status_from_coverage(coverage: Column, pos: float, partial: float) -> Column:
    return F.when(coverage >= pos, "pos").when(coverage >= partial, "partial").otherwise("neg")


def genome_plasmid_summary(
    labels: DataFrame, target_hits: DataFrame, tools: DataFrame, kept_labels: Sequence[str] = ("chromosome",),
    pos: float = 0.8, partial: float = 0.5, n_tools: int = 4, bucket_width: int = 1_000_000,
) -> DataFrame:
    """Per genome: label counts, lengths, reference coverage, status and number of missing tools.

    ``target_hits`` (genome, contig, tstart, tend, tlen[, passed]) are the alignments; where
    ``passed`` is given, weak ones only tell the reference length. Only alignments of
    contigs labelled as the reference plasmid count. ``tools`` (genome, tool)
    lists the tools that gave output.
    """
    def count(label):
        return F.count_if(F.col("label") == label)

    def length(test):
        return F.coalesce(F.sum(F.when(test, F.col("length"))), F.lit(0))

    per = labels.groupBy("genome").agg(
        F.count(F.lit(1)).alias("n_contigs"), F.sum("length").alias("total_len"),
        count("pESI").alias("n_pesi"), count("pESI_short").alias("n_pesi_short"),
        count("plasmid_other").alias("n_plasmid_other"), count("uncertain").alias("n_uncertain"),
        length(F.col("label").isin(*kept_labels)).alias("kept_len"),
        length(F.col("label") == "pESI").alias("pesi_len_all"),
        length(F.col("label") == "plasmid_other").alias("plasmid_other_len"),
    )
    carriers = labels.filter(F.col("label").isin("pESI", "pESI_short")).select("genome", "contig")
    strong = target_hits.filter("passed") if "passed" in target_hits.columns else target_hits
    on_ref = strong.join(carriers, ["genome", "contig"], "left_semi")
    cover = merged_length(
        on_ref.select("genome", F.col("tstart").alias("start"), F.col("tend").alias("end")), ["genome"], bucket_width
    ).select("genome", "covered")
    ref = target_hits.groupBy("genome").agg(F.max("tlen").alias("ref_len"))
    present = tools.groupBy("genome").agg(F.count_distinct("tool").alias("n_tools"))
    coverage = F.coalesce(F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), F.col("ref_len")), F.lit(0.0))
    joined = (
        per.join(cover, "genome", "left").join(ref, "genome", "left").join(present, "genome", "left")
        .withColumn("ref_coverage", coverage).withColumn("status", status_from_coverage(coverage, pos, partial))
    )
    return joined.select(
        "genome", "n_contigs", "total_len", "ref_coverage", "status", "n_pesi", "n_pesi_short", "n_plasmid_other",
        "n_uncertain", "kept_len",
        F.when(F.col("status") == "pos", F.col("pesi_len_all")).otherwise(0).alias("pesi_len"),
        "plasmid_other_len", (F.lit(n_tools) - F.coalesce("n_tools", F.lit(0))).alias("n_missing_tools"),
    )


def genome_sizes(contigs: DataFrame) -> DataFrame:
    """Summed contig length per genome."""
    return contigs.groupBy("genome").agg(F.sum("length").alias("size"), F.count(F.lit(1)).alias("n_contigs"))


def assembly_n50(contigs: DataFrame) -> DataFrame:
    """N50 per genome: the longest length such that contigs at least that long hold half of it.

    Works on the histogram of lengths, in power-of-two buckets, so a genome with very
    many contigs is not sorted in one task.
    """
    hist = contigs.groupBy("genome", "length").agg((F.count(F.lit(1)) * F.col("length")).alias("bases"))
    bucket = F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)).cast("double")) * 8)
    cum = prefix_scan(hist, ["genome"], ["length"], bucket, {"upto": ("sum", "bases")}, inclusive=True, descending=True)
    total = contigs.groupBy("genome").agg(F.sum("length").alias("size"))
    return cum.join(total, "genome").filter(F.col("upto") * 2 >= F.col("size")).groupBy("genome").agg(
        F.max("length").alias("n50")
    )


def reference_isolate(n50: DataFrame) -> DataFrame:
    """The genome with the largest N50 (ties → smallest name)."""
    return n50.orderBy(F.desc("n50"), "genome").limit(1)


def linearise_reference(contigs: DataFrame, spacer: int = 100, bucket: Column | None = None) -> DataFrame:
    """Contigs of a genome as consecutive pieces of one sequence with an N spacer between them.

    Rows are (genome, contig_no, offset, piece); joined by ``offset`` they are the
    single record, which is never built in memory. ``bucket`` must grow with contig_no.
    """
    size = F.length("seq").cast("long")
    grow = bucket if bucket is not None else F.floor(F.col("contig_no") / 4096)
    last = contigs.groupBy("genome").agg(F.max("contig_no").alias("last_no"))
    placed = prefix_scan(contigs, ["genome"], ["contig_no"], grow, {"offset": ("sum", size + spacer)})
    return placed.join(last, "genome").select(
        "genome", "contig_no", "offset",
        F.when(F.col("contig_no") == F.col("last_no"), F.col("seq"))
        .otherwise(F.concat("seq", F.lit("N" * spacer))).alias("piece"),
    )
