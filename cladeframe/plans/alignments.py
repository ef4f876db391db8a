"""Pair alignment, recombination and core genome queries, and the whole pairwise pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.operators import blocks as bl, clusters as cl, recombination as rc, sequences as sq
from cladeframe.operators.sequences import PAIR
from cladeframe.plans.registry import query
from cladeframe.plans.tables import BASES, LINES, PAIR_STATS, KEEP_ALL, RUNS, WINDOWS, Tables


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


def _parts(t: Tables) -> DataFrame:
    return sq.with_mismatches(sq.split_at_gaps(t.blocks))


@query("gap_runs", f"""WITH {LINES}, s AS (SELECT strain1, strain2, block_no, unnest(string_split(seq1, '')) AS c, generate_subscripts(string_split(seq1, ''), 1) - 1 AS i, 1 AS w FROM blk WHERE length(seq1) > 0
UNION ALL SELECT strain1, strain2, block_no, unnest(string_split(seq2, '')), generate_subscripts(string_split(seq2, ''), 1) - 1, 2 FROM blk WHERE length(seq2) > 0),
g AS (SELECT *, i - row_number() OVER (PARTITION BY strain1, strain2, block_no, w ORDER BY i) AS isl FROM s WHERE c = '-')
SELECT strain1, strain2, block_no, min(i) AS start, max(i) + 1 AS "end" FROM g GROUP BY strain1, strain2, block_no, w, isl HAVING count(*) >= 2""")
def _(t: Tables):
    return sq.gap_runs(t.blocks)


PART_TEXT = BASES + """ SELECT strain1, strain2, block_no, min(i) AS start, count(*) AS length, string_agg(c1, '' ORDER BY i) AS seq1, string_agg(c2, '' ORDER BY i) AS seq2 FROM kept GROUP BY strain1, strain2, block_no, isl"""


@query("split_by_removed_intervals", "WITH " + PART_TEXT)
def _(t: Tables):
    blocks = cut(t.blocks)
    return sq.split_by_removed_intervals(blocks, sq.gap_runs(blocks))


@query("split_at_gaps", "WITH " + PART_TEXT)
def _(t: Tables):
    return sq.split_at_gaps(t.blocks)


@query("pair_divergence", f"""WITH {BASES} SELECT strain1, strain2, n_parts, CAST(aligned AS BIGINT) AS aligned_length, CAST(mism AS BIGINT) AS mismatches, round(mism / aligned::DOUBLE, 9) AS divergence FROM tot""")
def _(t: Tables):
    return sq.pair_divergence(_parts(t)).withColumn("divergence", F.round("divergence", 9))


def _windows(t: Tables) -> DataFrame:
    parts = cut(_parts(t))
    return sq.sliding_window_divergence(sq.place_parts(parts), sq.pair_divergence(parts))


@query("sliding_window_divergence", f"""WITH {WINDOWS} SELECT strain1, strain2, window_no, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(mism AS BIGINT) AS mismatches, round(mism / length::DOUBLE, 9) AS divergence
FROM win JOIN wcnt USING (strain1, strain2, window_no)""")
def _(t: Tables):
    return _windows(t).withColumn("divergence", F.round("divergence", 9))


@query("identical_run_lengths", f"WITH {RUNS} SELECT strain1, strain2, run, count(*) AS n FROM runs GROUP BY ALL")
def _(t: Tables):
    return sq.identical_run_lengths(_parts(t))


@query("run_spectrum_ssd", f"""WITH {RUNS}, h AS (SELECT strain1, strain2, run, count(*) * run AS mass FROM runs GROUP BY strain1, strain2, run),
hc AS (SELECT strain1, strain2, run, sum(mass) OVER (PARTITION BY strain1, strain2 ORDER BY run) / sum(mass) OVER (PARTITION BY strain1, strain2) AS cum FROM h),
d AS (SELECT strain1, strain2, aligned, mism / aligned::DOUBLE AS d FROM tot),
w AS (SELECT *, unnest(generate_series(0, CAST(aligned - 1 AS BIGINT))) AS w FROM d),
o AS (SELECT w.strain1, w.strain2, w.w, d, cum FROM w ASOF LEFT JOIN hc ON w.strain1 = hc.strain1 AND w.strain2 = hc.strain2 AND w.w >= hc.run)
SELECT strain1, strain2, round(CASE WHEN isnan(sum(power(1 - coalesce(cum, 0) - exp(-d * w) * (d * w + 1), 2))) THEN NULL ELSE sum(power(1 - coalesce(cum, 0) - exp(-d * w) * (d * w + 1), 2)) END, 6) AS ssd FROM o GROUP BY strain1, strain2""")
def _(t: Tables):
    parts = cut(_parts(t))
    return rc.run_spectrum_ssd(sq.identical_run_lengths(parts), sq.pair_divergence(parts)).withColumn("ssd", F.round("ssd", 6))


@query("ssd_bootstrap_ci")
def _(t: Tables):
    parts = cut(_parts(t))
    return rc.ssd_bootstrap_ci(sq.identical_run_lengths(parts), sq.pair_divergence(parts))


@query("divergence_outlier_filter")
def _(t: Tables):
    kept = rc.divergence_outlier_filter(_parts(t))
    return sq.pair_divergence(kept)


class PairAnalysis:
    """All tables of the pairwise pipeline, each built once and shared by its consumers."""

    def __init__(self, blocks: DataFrame, sizes: DataFrame, window: int = 500, min_block: int = 0):
        """``blocks`` are pair alignments, ``sizes`` (genome, size) the genome lengths."""
        self.window = window
        self.texts = sq.split_at_gaps(blocks, min_block)
        self.parts = cut(sq.with_mismatches(self.texts))
        self.totals = cut(sq.pair_divergence(self.parts))
        self.placed = sq.place_parts(self.parts)
        self.windows = cut(sq.sliding_window_divergence(self.placed, self.totals, window))
        self.filtered = rc.divergence_outlier_filter(self.parts, min_block=min_block)
        self.final = cut(sq.pair_divergence(self.filtered))
        side = lambda c: sizes.select(F.col("genome").alias(f"strain{c}"), F.col("size").alias(f"genome{c}_size"))
        # the pair roster is every pair with blocks, also those without a part left
        pairs = blocks.select(*PAIR).distinct()
        self.sized = pairs.join(side(1), "strain1", "left").join(side(2), "strain2", "left")
        fractions = self.sized.join(self.totals, PAIR).select(
            *PAIR, (F.col("aligned_length") / F.least("genome1_size", "genome2_size")).alias("aligned_fraction")
        )
        after = sq.sliding_window_divergence(sq.place_parts(self.filtered), self.final, window)
        starts = after.groupBy(*PAIR).agg(F.avg("divergence").alias("mean_div"))
        self.fractions = fractions
        self.fit = cut(rc.mixture_fit(self.windows, starts, fractions, window))
        self.states = rc.segment_states(self.windows, self.fit, window)
        self.intervals = rc.state_intervals(self.states)

    def edges(self) -> DataFrame:
        """The 18-column pair result; a pair without aligned parts keeps a row of nulls."""
        runs = sq.identical_run_lengths(self.filtered)
        ssd = rc.run_spectrum_ssd(runs, self.final).join(rc.ssd_bootstrap_ci(runs, self.final), PAIR)
        base = self.totals.select(*PAIR, F.col("divergence").alias("divergence_raw"), F.col("aligned_length").alias("aligned_raw"))
        final = self.final.select(*PAIR, "divergence", F.col("aligned_length").alias("aligned"))
        weak = F.col("aligned_fraction") < 0.3
        bias = lambda c: F.when(weak, 0.0).otherwise(F.col(c)).alias(c)
        out = self.sized
        for table in (base, final, ssd, self.fractions, self.fit, rc.state_summary(self.states)):
            out = out.join(table, PAIR, "left")
        return out.select(
            *PAIR, "divergence_raw", "divergence", "aligned_raw", "aligned", "genome1_size", "genome2_size", bias("ssd"),
            bias("ssd_low"), bias("ssd_high"), (F.col("mu") / self.window).alias("mu_div"), (F.col("mnb") / self.window).alias("mnb_div"),
            (100 - F.col("fc")).alias("sim_fr"), "nb_size", "hmm_fr", "hmm_mu", "hmm_mnb",
        )


def _analysis(t: Tables) -> PairAnalysis:
    sizes = t.documents.select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("genome"), F.length("text").cast("long").alias("size"))
    return PairAnalysis(t.blocks, sizes)


@query("mixture_fit")
def _(t: Tables):
    return _analysis(t).fit


# A fit by moments stands in for the mixture, so that SQL can follow every window of every pair.
EMISSIONS = WINDOWS + """, cnt AS (SELECT win.strain1, win.strain2, window_no, start, length, mism / length::DOUBLE AS divergence, round(mism / length::DOUBLE * 500) AS k
  FROM win JOIN wcnt USING (strain1, strain2, window_no)),
em AS MATERIALIZED (SELECT c.strain1, c.strain2, window_no, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, divergence,
  k * ln(m * 0.5) - m * 0.5 - lgamma(k + 1) AS ec, lgamma(k + 2) - lgamma(k + 1) + 2 * ln(2 / (2 + m * 2)) + k * ln(1 - 2 / (2 + m * 2)) AS er
  FROM cnt c JOIN (SELECT strain1, strain2, avg(k) AS m FROM cnt GROUP BY 1, 2) USING (strain1, strain2) WHERE m > 0)"""
STICKY = ((0.95, 0.05), (0.2, 0.8))
BEST_PATH = EMISSIONS + f""", fw AS (
  SELECT strain1, strain2, window_no, ln(0.6) + ec AS c, ln(0.4) + er AS r, true AS bc, true AS br FROM em WHERE window_no = 0
  UNION ALL SELECT f.strain1, f.strain2, e.window_no, greatest(c + ln({STICKY[0][0]}), r + ln({STICKY[1][0]})) + ec, greatest(c + ln({STICKY[0][1]}), r + ln({STICKY[1][1]})) + er,
    c + ln({STICKY[0][0]}) >= r + ln({STICKY[1][0]}), c + ln({STICKY[0][1]}) >= r + ln({STICKY[1][1]})
  FROM fw f JOIN em e ON e.strain1 = f.strain1 AND e.strain2 = f.strain2 AND e.window_no = f.window_no + 1),
fwm AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT strain1, strain2, window_no, c >= r AS clonal FROM fwm JOIN (SELECT strain1, strain2, max(window_no) AS window_no FROM em GROUP BY 1, 2) USING (strain1, strain2, window_no)
  UNION ALL SELECT b.strain1, b.strain2, b.window_no - 1, CASE WHEN b.clonal THEN f.bc ELSE f.br END
  FROM bw b JOIN fwm f ON f.strain1 = b.strain1 AND f.strain2 = b.strain2 AND f.window_no = b.window_no WHERE b.window_no > 0)"""


def _moment_fit(t: Tables):
    windows = cut(_windows(t))
    mean = windows.groupBy(*PAIR).agg(F.avg(F.round(F.col("divergence") * 500)).alias("m"))
    return windows, mean.select(*PAIR, (F.col("m") * 0.5).alias("mu"), (F.col("m") * 2).alias("mnb"), F.lit(2.0).alias("nb_size"), F.lit(60.0).alias("fc"))


@query("segment_states", f"""WITH {EMISSIONS} SELECT strain1, strain2, window_no, start, length, round(divergence, 9) AS divergence,
CASE WHEN ec + CASE WHEN window_no = 0 THEN ln(0.6) ELSE 0 END >= er + CASE WHEN window_no = 0 THEN ln(0.4) ELSE 0 END THEN 'C' ELSE 'R' END AS state FROM em""")
def _(t: Tables):
    return rc.segment_states(*_moment_fit(t)).withColumn("divergence", F.round("divergence", 9))


@query("segment_states_sticky", f"""WITH RECURSIVE {BEST_PATH} SELECT strain1, strain2, window_no, start, length, round(divergence, 9) AS divergence,
CASE WHEN clonal THEN 'C' ELSE 'R' END AS state FROM bw JOIN em USING (strain1, strain2, window_no)""")
def _(t: Tables):
    return rc.segment_states(*_moment_fit(t), transitions=STICKY).withColumn("divergence", F.round("divergence", 9))


@query("segment_states_trained")
def _(t: Tables):
    analysis = _analysis(t)
    return rc.train_segment_states(analysis.windows, analysis.fit)


@query("recombination_edges")
def _(t: Tables):
    return _analysis(t).edges()


# Windows far from the pair's mean stand in for fitted states, so that SQL can follow.
STATES = WINDOWS + """, st AS (SELECT strain1, strain2, window_no, start, length, CASE WHEN mism * aligned > mism_all * length THEN 'R' ELSE 'C' END AS state
  FROM win JOIN wcnt USING (strain1, strain2, window_no) JOIN (SELECT strain1, strain2, aligned, mism AS mism_all FROM tot) USING (strain1, strain2)),
sr AS (SELECT strain1, strain2, start AS s, start + length AS e, max(start + length) OVER (PARTITION BY strain1, strain2 ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st WHERE state = 'R'),
si AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY strain1, strain2 ORDER BY s) AS isl FROM sr),
ivs AS (SELECT strain1, strain2, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS stop FROM si GROUP BY strain1, strain2, isl),
atp AS (SELECT k.strain1, k.strain2, block_no, off, off + i - start AS pos, c1, c2 FROM kept k JOIN placed USING (strain1, strain2, block_no, isl))"""


def _by_mean(t: Tables):
    texts = sq.place_parts(cut(sq.split_at_gaps(t.blocks)))
    parts = cut(texts.select(*PAIR, "block_no", "start", "length", "offset", sq.mismatch_offsets("seq1", "seq2").alias("mism")))
    totals = sq.pair_divergence(parts)
    windows = sq.sliding_window_divergence(parts, totals)
    mean = totals.select(*PAIR, "aligned_length", F.col("mismatches").alias("all_mismatches"))
    high = F.col("mismatches") * F.col("aligned_length") > F.col("all_mismatches") * F.col("length")
    states = cut(windows.join(mean, PAIR).withColumn("state", F.when(high, "R").otherwise("C")))
    return texts, totals, states


@query("state_intervals", f'WITH {STATES} SELECT strain1, strain2, start, stop AS "end" FROM ivs')
def _(t: Tables):
    return rc.state_intervals(_by_mean(t)[2])


@query("state_summary", f"""WITH {STATES} SELECT strain1, strain2, round(100.0 * count(*) FILTER (WHERE state = 'R') / count(*), 6) AS hmm_fr,
round(avg(mism / st.length::DOUBLE) FILTER (WHERE state = 'C'), 6) AS hmm_mu, round(avg(mism / st.length::DOUBLE) FILTER (WHERE state = 'R'), 6) AS hmm_mnb
FROM st JOIN wcnt USING (strain1, strain2, window_no) GROUP BY strain1, strain2""")
def _(t: Tables):
    return rc.state_summary(_by_mean(t)[2]).select(*PAIR, _r("hmm_fr"), _r("hmm_mu"), _r("hmm_mnb"))


@query("extract_intervals", f"""WITH {STATES} SELECT a.strain1, a.strain2, start AS interval_start, stop AS interval_end, block_no, CAST(min(pos) AS BIGINT) AS start, string_agg(c1, '' ORDER BY pos) AS seq1, string_agg(c2, '' ORDER BY pos) AS seq2
FROM atp a JOIN ivs v ON a.strain1 = v.strain1 AND a.strain2 = v.strain2 AND pos >= start AND pos < stop GROUP BY a.strain1, a.strain2, start, stop, block_no, off""")
def _(t: Tables):
    placed, _, states = _by_mean(t)
    return rc.extract_intervals(placed, rc.state_intervals(states))


FRAME = STATES + """, cv AS (SELECT DISTINCT strain1, strain2, pos FROM atp a SEMI JOIN ivs v ON a.strain1 = v.strain1 AND a.strain2 = v.strain2 AND pos >= start - 500 AND pos < stop + 500),
allpos AS (SELECT strain1, strain2, unnest(generate_series(0, CAST(aligned - 1 AS BIGINT))) AS pos FROM tot WHERE (strain1, strain2) IN (SELECT (strain1, strain2) FROM ivs)),
outp AS (SELECT a.strain1, a.strain2, a.pos FROM allpos a ANTI JOIN ivs v ON a.strain1 = v.strain1 AND a.strain2 = v.strain2 AND pos >= start - 500 AND pos < stop + 500),
oi AS (SELECT *, pos - row_number() OVER (PARTITION BY strain1, strain2 ORDER BY pos) AS isl FROM outp),
oo AS (SELECT *, min(pos) OVER (PARTITION BY strain1, strain2, isl) AS i0, max(pos) OVER (PARTITION BY strain1, strain2, isl) + 1 AS i1 FROM oi),
fr AS (SELECT atp.strain1, atp.strain2, i0 AS interval_start, i1 AS interval_end, block_no, CAST(min(pos) AS BIGINT) AS start, string_agg(c1, '' ORDER BY pos) AS seq1, string_agg(c2, '' ORDER BY pos) AS seq2,
  string_agg(CASE WHEN c1 = c2 OR ((CAST(pos AS BIGINT) * 1103515245 + 12345) % 2147483648) // 65536 % 2 = 0 THEN c1 ELSE c2 END, '' ORDER BY pos) || repeat('N', 500) AS consensus
  FROM atp JOIN oo USING (strain1, strain2, pos) GROUP BY atp.strain1, atp.strain2, i0, i1, block_no, off)"""


@query("clonal_frame", f"WITH {FRAME} SELECT strain1, strain2, interval_start, interval_end, block_no, start, seq1, seq2 FROM fr")
def _(t: Tables):
    placed, totals, states = _by_mean(t)
    return rc.clonal_frame(placed, totals, rc.state_intervals(states))


@query("clonal_frame_consensus", f"WITH {FRAME} SELECT strain1, strain2, interval_start, start, consensus FROM fr")
def _(t: Tables):
    placed, totals, states = _by_mean(t)
    return rc.clonal_frame_consensus(rc.clonal_frame(placed, totals, rc.state_intervals(states)))


@query("classify_pairs", f"""WITH {PAIR_STATS}, c AS (SELECT *, CASE WHEN hmm_fr = 0 THEN sim_fr > 0 ELSE sim_fr / hmm_fr > 2 END AS capped, divergence_raw < 1500 / aligned_raw AS near,
  CASE WHEN mu_div = 0 THEN mnb_div > 0 ELSE mnb_div / mu_div > 2.5 END AS mix FROM ps)
SELECT strain1, strain2, round(CASE WHEN near THEN 0 WHEN capped THEN hmm_fr ELSE sim_fr END, 6) AS total_r, round(CASE WHEN near THEN 1e-5 WHEN capped THEN hmm_mu ELSE mu_div END, 8) AS div, CASE WHEN capped THEN 'C' ELSE 'NC' END AS type FROM c WHERE mix OR near""")
def _(t: Tables):
    return rc.classify_pairs(t.pair_stats).select(*PAIR, _r("total_r"), _r("div", 8), "type")


@query("classify_pairs_keep_all", f"WITH {KEEP_ALL} SELECT strain1, strain2, round(total_r, 6) AS total_r, round(div, 8) AS div, type FROM kall")
def _(t: Tables):
    return rc.classify_pairs(t.pair_stats, keep_all=True).select(*PAIR, _r("total_r"), _r("div", 8), "type")


@query("genome_pairs", """WITH g AS (SELECT n_name AS genome FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name HAVING sum(c_acctbal) IS NOT NULL)
SELECT a.genome AS strain1, b.genome AS strain2 FROM g a JOIN g b ON a.genome < b.genome""")
def _(t: Tables):
    genomes = t.customer.select(F.col("c_nationkey").alias("n_nationkey")).join(t.nation, "n_nationkey").select(F.col("n_name").alias("genome"))
    return cl.genome_pairs(genomes)


# --- multi-genome blocks ----------------------------------------------------
BLOCKS = """lg AS (SELECT conv_id, max(length(text)) AS size FROM conversations GROUP BY conv_id),
br AS (SELECT conv_id AS label, role AS isolate, text || repeat('-', size - length(text)) AS seq, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations JOIN lg USING (conv_id)),
cb AS (SELECT label, isolate, seq FROM br WHERE rn = 1 AND label IN (SELECT label FROM br GROUP BY label HAVING count(DISTINCT isolate) = (SELECT count(DISTINCT role) FROM conversations)))"""
COLS = BLOCKS + """, ch AS (SELECT label, isolate, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM cb),
inf AS (SELECT label, i FROM ch GROUP BY label, i HAVING count(*) FILTER (WHERE c NOT IN ('-', 'N')) > 1),
ic AS (SELECT ch.* FROM ch JOIN inf USING (label, i))"""
CORE = BLOCKS + """, ch AS (SELECT label, isolate, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM cb),
rf AS (SELECT label, count(*) AS raw_len, count(*) FILTER (WHERE c <> '-') AS bare FROM ch WHERE isolate = 'assistant' GROUP BY label),
cc AS (SELECT label, i, count(DISTINCT c) AS k FROM ch WHERE label IN (SELECT label FROM rf WHERE bare >= 20 AND bare / raw_len::DOUBLE >= 0.1) GROUP BY label, i HAVING count(*) FILTER (WHERE c = '-') = 0),
ct AS (SELECT label, raw_len, count(*) AS degap_len, count(*) / raw_len::DOUBLE AS gapless_share, count(*) FILTER (WHERE k > 1) AS snp_count FROM cc JOIN rf USING (label) GROUP BY label, raw_len
  HAVING count(*) >= 20 AND count(*) / raw_len::DOUBLE >= 0.1)"""


def _complete(t: Tables):
    return bl.complete_blocks(t.block_rows, t.block_roster)


def _core(t: Tables):
    return bl.core_columns_and_snps(_complete(t), "assistant", 20, 0.1)


@query("complete_blocks", f"WITH {BLOCKS} SELECT * FROM cb")
def _(t: Tables):
    return _complete(t)


@query("drop_uninformative_columns", f"WITH {COLS} SELECT label, isolate, string_agg(c, '' ORDER BY i) AS seq FROM ic GROUP BY label, isolate")
def _(t: Tables):
    return bl.drop_uninformative_columns(_complete(t))


@query("core_columns_and_snps", f"WITH {CORE} SELECT label, raw_len, degap_len, round(gapless_share, 9) AS gapless_share, snp_count FROM ct")
def _(t: Tables):
    return _core(t)[0].withColumn("gapless_share", F.round("gapless_share", 9))


@query("core_genome_concat", f"""WITH {CORE}, pl AS (SELECT label, label * 7919 % 1009 AS start, CAST(coalesce(sum(degap_len) OVER (ORDER BY label * 7919 % 1009, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS loc_start, degap_len FROM ct)
SELECT isolate, label, start, loc_start, loc_start + degap_len AS loc_end, string_agg(c, '' ORDER BY i) AS seq FROM ch JOIN cc USING (label, i) JOIN pl USING (label) GROUP BY isolate, label, start, loc_start, degap_len""")
def _(t: Tables):
    table, core = _core(t)
    starts = table.select("label", (F.col("label") * 7919 % 1009).alias("start"))
    return bl.core_genome_concat(core, bl.block_locations(table, starts))
