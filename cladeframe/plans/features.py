"""Feature, summary and group-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.functions.labels import feature_class, gene_label
from cladeframe.operators import features as ft, membership as mb, stats as st
from cladeframe.plans.registry import query
from cladeframe.plans.tables import GENES, GROUPS, HITS, NAMES, NATION_GENES, Tables

BLOCKS = ("STRESS", "AMR", "POINT", "VIRULENCE")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


@query("presence_absence", f"""WITH {HITS} SELECT DISTINCT c_custkey AS sample, feature, CASE WHEN feature IS NULL THEN 0 ELSE 1 END AS present
FROM customer LEFT JOIN hits ON c_custkey = sample""")
def _(t: Tables):
    return ft.presence_absence(t.hits, t.roster)


@query("feature_class", f"WITH {HITS} SELECT feature_class, type, count(*) AS n FROM chits GROUP BY ALL")
def _(t: Tables):
    return ft.classify_hits(t.hits).groupBy("feature_class", "type").agg(F.count(F.lit(1)).alias("n"))


INFO = f"""WITH {HITS}, mc AS (SELECT feature, class, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, class) AS rn FROM chits GROUP BY feature, class),
mf AS (SELECT feature, feature_class, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, feature_class) AS rn FROM chits GROUP BY feature, feature_class),
info AS (SELECT feature, mf.feature_class, mc.class, count(DISTINCT sample) AS n_genomes, count(*) AS n_hits_total,
  round(100.0 * count(DISTINCT sample) / (SELECT count(*) FROM customer), 2) AS pct_genomes
FROM chits c JOIN mc USING (feature) JOIN mf USING (feature) WHERE mc.rn = 1 AND mf.rn = 1 GROUP BY feature, mf.feature_class, mc.class)"""


def _info(t: Tables):
    total = t.roster.agg(F.count(F.lit(1))).scalar()
    return ft.feature_info(ft.classify_hits(t.hits), total, ["feature_class", "class"])


@query("feature_info", INFO + " SELECT * FROM info ORDER BY feature_class, class, n_genomes DESC, feature")
def _(t: Tables):
    return _info(t).orderBy("feature_class", "class", F.desc("n_genomes"), "feature")


@query("heatmap_feature_order", INFO + f"""
SELECT feature, feature_class, class, n_genomes, list_position({list(BLOCKS)}, feature_class) AS block_no
FROM info WHERE n_genomes >= 5 AND n_genomes < 0.99 * (SELECT count(*) FROM customer)""")
def _(t: Tables):
    total = t.roster.agg(F.count(F.lit(1))).scalar()
    return ft.heatmap_feature_order(_info(t), total, BLOCKS, min_genomes=5, drop_core=True).select(
        "feature", "feature_class", "class", "n_genomes", "block_no"
    )


BURDEN = f"""WITH {HITS}, amr AS (SELECT * FROM chits WHERE type = 'AMR' AND feature <> 'red widget'),
d AS (SELECT DISTINCT sample, trim(unnest(string_split(class, '/'))) AS drug FROM amr),
dd AS (SELECT sample, count(*) AS n, string_agg(drug, ';' ORDER BY drug) AS drugs FROM d WHERE drug NOT IN ('', 'EFFLUX') GROUP BY sample),
g AS (SELECT sample, count(DISTINCT feature) FILTER (WHERE feature_class = 'AMR' AND class <> 'EFFLUX') AS a, count(DISTINCT feature) FILTER (WHERE feature_class = 'POINT') AS p FROM amr GROUP BY sample),
burden AS (SELECT c_custkey AS sample, coalesce(a, 0) AS n_amr_genes, coalesce(p, 0) AS n_point_mutations, coalesce(n, 0) AS n_drug_classes,
  CASE WHEN coalesce(n, 0) >= 3 THEN 1 ELSE 0 END AS mdr, coalesce(drugs, '') AS drug_classes
  FROM customer LEFT JOIN g ON g.sample = c_custkey LEFT JOIN dd ON dd.sample = c_custkey)"""


def _burden(t: Tables):
    return ft.burden_per_sample(ft.classify_hits(t.hits), t.roster, ignore=["red widget"])


@query("burden_per_sample", BURDEN + " SELECT * FROM burden")
def _(t: Tables):
    return _burden(t)


@query("burden_by_group", BURDEN + f""", {GROUPS} SELECT grp, count(*) AS n,
quantile_cont(n_amr_genes, 0.25) AS n_amr_genes_q1, quantile_cont(n_amr_genes, 0.5) AS n_amr_genes_median, quantile_cont(n_amr_genes, 0.75) AS n_amr_genes_q3,
quantile_cont(n_drug_classes, 0.25) AS n_drug_classes_q1, quantile_cont(n_drug_classes, 0.5) AS n_drug_classes_median, quantile_cont(n_drug_classes, 0.75) AS n_drug_classes_q3,
quantile_cont(n_point_mutations, 0.25) AS n_point_mutations_q1, quantile_cont(n_point_mutations, 0.5) AS n_point_mutations_median, quantile_cont(n_point_mutations, 0.75) AS n_point_mutations_q3,
round(100 * avg(mdr), 6) AS mdr_pct FROM burden JOIN grps USING (sample) GROUP BY grp""")
def _(t: Tables):
    return ft.burden_by_group(_burden(t), t.groups).withColumn("mdr_pct", F.round("mdr_pct", 6))


PREV = f"""WITH {GENES}, {GROUPS}, sz AS (SELECT grp, count(*) AS size FROM grps GROUP BY grp),
cn AS (SELECT feature, grp, count(*) AS n FROM genes JOIN grps USING (sample) GROUP BY ALL),
fx AS (SELECT DISTINCT feature FROM genes),
pv AS (SELECT fx.feature, sz.grp, coalesce(n, 0) AS n, 100.0 * coalesce(n, 0) / size AS pct FROM fx CROSS JOIN sz LEFT JOIN cn ON cn.feature = fx.feature AND cn.grp = sz.grp)"""


@query("prevalence_by_group", PREV + """ SELECT feature, grp, n, round(pct, 6) AS pct,
round(max(pct) OVER (PARTITION BY feature) - min(pct) OVER (PARTITION BY feature), 6) AS max_diff_pct FROM pv""")
def _(t: Tables):
    return ft.prevalence_by_group(t.genes, t.groups).select("feature", "grp", "n", _r("pct"), _r("max_diff_pct"))


@query("select_informative_genes", PREV + """, keep AS (SELECT feature FROM genes GROUP BY feature HAVING count(*) BETWEEN 5 AND 0.9 * (SELECT count(*) FROM customer)),
b AS (SELECT feature, max(pct) - min(pct) AS d, arg_min(grp, struct_pack(a := -pct, b := grp)) AS enriched_in FROM pv WHERE feature IN (SELECT feature FROM keep) GROUP BY feature)
SELECT feature, round(d, 6) AS max_diff_pct, enriched_in FROM b ORDER BY round(d, 9) DESC, feature LIMIT 50""")
def _(t: Tables):
    return ft.select_informative_genes(t.genes, t.groups, 5, 0.9, 50).select("feature", _r("max_diff_pct"), "enriched_in")


@query("select_variable_genes", f"""WITH {GENES}, k AS (SELECT feature, count(*) AS n FROM genes GROUP BY feature HAVING count(*) BETWEEN 5 AND 0.9 * (SELECT count(*) FROM customer))
SELECT feature, n, round(100.0 * n / (SELECT count(*) FROM customer), 6) AS pct FROM k
ORDER BY round(abs(100.0 * n / (SELECT count(*) FROM customer) - 50), 9), feature LIMIT 50""")
def _(t: Tables):
    return ft.select_variable_genes(t.genes, t.roster, 5, 0.9, 50).select("feature", "n", _r("pct"))


@query("unique_patterns_threshold", f"""WITH {NAMES}, p AS (SELECT DISTINCT list(sample ORDER BY sample) AS l FROM names GROUP BY feature)
SELECT count(*) AS n_patterns, round(0.05 / count(*), 12) AS threshold FROM p""")
def _(t: Tables):
    return ft.unique_patterns_threshold(t.names).select("n_patterns", _r("threshold", 12))


@query("share_within_group", """WITH c AS (SELECT o_orderpriority AS grp, o_orderstatus AS detail, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT grp, detail, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY grp), 9) AS share FROM c""")
def _(t: Tables):
    df = t.orders.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("detail"))
    return ft.share_within_group(df, "grp", "detail").withColumn("share", F.round("share", 9))


@query("carriage_rate", f"""WITH {NAMES}, {GROUPS}, tot AS (SELECT grp, count(*) AS total FROM grps GROUP BY grp)
SELECT grp, feature, count(*) AS n, total, round(100.0 * count(*) / total, 6) AS pct FROM names JOIN grps USING (sample) JOIN tot USING (grp) GROUP BY grp, feature, total""")
def _(t: Tables):
    return ft.carriage_rate(t.names, t.groups).withColumn("pct", F.round("pct", 6))


@query("cluster_purity", """WITH n AS (SELECT c_nationkey AS cluster, c_mktsegment AS label, count(*) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL)
SELECT cluster, CAST(sum(n) AS BIGINT) AS n_labelled, round(max(n) / sum(n), 9) AS dominant_share FROM n GROUP BY cluster""")
def _(t: Tables):
    df = t.customer.select(F.col("c_nationkey").alias("cluster"), F.col("c_mktsegment").alias("label"))
    return ft.cluster_purity(df, "cluster", "label", none="MACHINERY").withColumn("dominant_share", F.round("dominant_share", 9))


@query("contingency_with_totals", """SELECT CASE WHEN grouping(c_nationkey) = 1 THEN 'total' ELSE CAST(c_nationkey AS VARCHAR) END AS row,
CASE WHEN grouping(c_mktsegment) = 1 THEN 'total' ELSE c_mktsegment END AS "column", count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)""")
def _(t: Tables):
    return ft.contingency_with_totals(t.customer, "c_nationkey", "c_mktsegment")


@query("duplicate_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    return mb.duplicate_check(t.lineitem, "l_orderkey", "l_linenumber")


@query("collapse_levels", """WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY p_brand)
SELECT CASE WHEN rn <= 7 THEN p_brand ELSE 'Other' END AS level, count(*) AS n FROM part JOIN r USING (p_brand) GROUP BY 1""")
def _(t: Tables):
    return mb.collapse_levels(t.part, "p_brand").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("gene_label", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name
  WHEN p_size % 3 = 1 THEN 'gene' || p_partkey
  WHEN p_size % 2 = 0 THEN CASE WHEN length(repeat(p_type || ' ', 6) || 'x') <= 38 THEN repeat(p_type || ' ', 6) || 'x' ELSE left(repeat(p_type || ' ', 6) || 'x', 37) || '…' END || ' [group_' || p_partkey || ']' ELSE 'group_' || p_partkey END AS label FROM part""")
def _(t: Tables):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    gene = F.when(size % 3 == 1, F.concat(F.lit("gene"), key)).otherwise(F.concat(F.lit("group_"), key))
    names = F.when(size % 3 == 0, F.concat("p_name", F.lit(";other"))).otherwise(F.lit("nan"))
    product = F.when(size % 2 == 0, F.concat(F.repeat(F.concat("p_type", F.lit(" ")), 6), F.lit("x;y"))).otherwise("hypothetical protein")
    return t.part.select("p_partkey", gene_label(gene, names, product).alias("label"))


# --- group tests ------------------------------------------------------------
FISHER = f"""WITH {GENES}, ph AS (SELECT c_custkey AS sample, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer),
tt AS (SELECT sum(y) AS np, count(*) - sum(y) AS nn FROM ph),
tab AS (SELECT feature, sum(y) AS a, count(*) - sum(y) AS b FROM genes JOIN ph USING (sample) GROUP BY feature),
tb AS (SELECT feature, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(np - a AS BIGINT) AS c, CAST(nn - b AS BIGINT) AS d FROM tab, tt WHERE np - a + nn - b > 0),
u AS (SELECT DISTINCT a, b, c, d FROM tb),
k AS (SELECT *, unnest(generate_series(greatest(0, a + c - (c + d)), least(a + b, a + c))) AS x FROM u),
lp AS (SELECT a, b, c, d, x, lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(c+d-a-c+x+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) AS l FROM k),
pv AS (SELECT l.a, l.b, l.c, l.d, least(1.0, sum(exp(l.l))) AS p FROM lp l JOIN lp o ON l.a = o.a AND l.b = o.b AND l.c = o.c AND l.d = o.d AND o.x = o.a WHERE l.l <= o.l + 1e-7 GROUP BY ALL),
fisher AS (SELECT feature, a, b, c, d, 100.0 * a / (a + c) AS pct_pos, 100.0 * b / (b + d) AS pct_neg,
  CASE WHEN b * c = 0 THEN CASE WHEN a * d = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE a * d / (b * c)::DOUBLE END AS odds_ratio, p AS pvalue FROM tb JOIN pv USING (a, b, c, d)),
rk AS (SELECT *, rank() OVER (ORDER BY round(pvalue, 11)) + count(*) OVER (PARTITION BY round(pvalue, 11)) - 1 AS r, count(*) OVER () AS m FROM fisher),
fdr AS (SELECT *, least(1.0, min(pvalue * m / r) OVER (ORDER BY round(pvalue, 11) DESC RANGE UNBOUNDED PRECEDING)) AS qvalue FROM rk)"""


def _fisher(t: Tables):
    return st.fisher_exact_by_feature(t.genes, t.phenotype)


def _fisher_rounded(df, *extra):
    return df.select("feature", "a", "b", "c", "d", _r("pct_pos"), _r("pct_neg"), _r("odds_ratio"), _r("pvalue", 8), *extra)


FISHER_COLS = "feature, a, b, c, d, round(pct_pos, 6) AS pct_pos, round(pct_neg, 6) AS pct_neg, round(odds_ratio, 6) AS odds_ratio, round(pvalue, 8) AS pvalue"


@query("fisher_exact_by_feature", FISHER + f" SELECT {FISHER_COLS} FROM fisher")
def _(t: Tables):
    return _fisher_rounded(_fisher(t))


@query("bh_fdr", FISHER + f" SELECT {FISHER_COLS}, round(qvalue, 7) AS qvalue FROM fdr")
def _(t: Tables):
    # equal tables in another row order may differ in the last bits; p is rounded before ranking
    tested = _fisher(t).withColumn("pvalue", F.round("pvalue", 11))
    return _fisher_rounded(st.bh_fdr(tested), _r("qvalue", 7))


@query("top_k_by_pvalue", FISHER + " SELECT feature, round(pvalue, 8) AS pvalue FROM fisher ORDER BY round(pvalue, 8), feature LIMIT 20")
def _(t: Tables):
    p = _fisher(t).select("feature", _r("pvalue", 8))
    return st_top(p)


def st_top(p):
    return mb.top_k_by_pvalue(p, "pvalue", 20, ["feature"])


@query("annotate_results", FISHER + """ SELECT feature, round(pvalue, 8) AS pvalue,
CASE WHEN p_partkey IS NULL THEN 'NOT_FOUND' WHEN p_size % 4 = 0 THEN 'hypothetical protein' ELSE p_type END AS annotation, coalesce(p_name, '') AS gene_name,
p_partkey IS NOT NULL AND p_size % 4 <> 0 AS informative FROM fisher LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#5') ON feature = p_partkey""")
def _(t: Tables):
    note = t.part.filter(F.col("p_brand") != "Brand#5").select(
        F.col("p_partkey").alias("feature"), F.when(F.col("p_size") % 4 == 0, "hypothetical protein").otherwise(F.col("p_type")).alias("annotation"),
        F.col("p_name").alias("gene_name"),
    )
    return mb.annotate_results(_fisher(t).select("feature", _r("pvalue", 8)), note, "feature")


@query("merge_test_results", FISHER + """ SELECT feature, round(pvalue, 8) AS pvalue, coalesce(CAST(n AS VARCHAR), 'NA') AS lrt
FROM fisher LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON feature = l_partkey""")
def _(t: Tables):
    other = t.lineitem.filter("l_discount > 0.09").groupBy(F.col("l_partkey").alias("feature")).agg(F.count(F.lit(1)).alias("lrt"))
    return mb.merge_test_results(_fisher(t).select("feature", _r("pvalue", 8)), other, "feature", ["lrt"])


@query("chi_square_cramers_v", """WITH n AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*)::DOUBLE AS n FROM customer GROUP BY ALL),
f AS (SELECT n, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c, a, b FROM n),
s AS (SELECT sum(n) AS n, sum(n) * (sum(n * n / (r * c)) - 1) AS chi, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k FROM f)
SELECT CAST(n AS BIGINT) AS n, round(chi, 6) AS chi_square, round(sqrt(chi / (n * k)), 8) AS cramers_v FROM s""")
def _(t: Tables):
    return st.chi_square_cramers_v(t.customer, "c_nationkey", "c_mktsegment").select("n", _r("chi_square"), _r("cramers_v", 8))


YEARS = "yr AS (SELECT year(o_orderdate)::DOUBLE AS v, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS g FROM orders)"


def _years(t: Tables):
    return t.orders.select(F.year("o_orderdate").alias("v"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("g"))


@query("rank_sum_test", f"""WITH {YEARS}, h AS (SELECT v, count(*) FILTER (WHERE g = 'F') AS n1, count(*) FILTER (WHERE g = 'other') AS n2 FROM yr GROUP BY v),
m AS (SELECT *, coalesce(sum(n1 + n2) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n1 + n2 + 1) / 2.0 AS mid, (n1 + n2)::DOUBLE AS tt FROM h),
s AS (SELECT sum(n1)::DOUBLE AS n1, sum(n2)::DOUBLE AS n2, sum(n1 * mid) AS r1, sum(tt * tt * tt - tt) AS ties FROM m),
w AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS w, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sg FROM s),
d AS (SELECT a.v - b.v AS v, sum(a.n1 * b.n2) AS wt FROM h a, h b WHERE a.n1 > 0 AND b.n2 > 0 GROUP BY 1),
c AS (SELECT v, sum(wt) OVER (ORDER BY v) AS up, sum(wt) OVER () AS total FROM d),
q AS (SELECT (min(v) FILTER (WHERE up >= floor((total + 1) / 2)) + min(v) FILTER (WHERE up >= floor((total + 2) / 2))) / 2 AS shift,
  min(v) FILTER (WHERE up >= k) AS ci_low, min(v) FILTER (WHERE up >= total + 1 - k) AS ci_high
  FROM c, (SELECT greatest(1, floor(n1 * n2 / 2 - 1.959963984540054 * sqrt(n1 * n2 * (n1 + n2 + 1) / 12))) AS k FROM w))
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, w, round((w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5) / sg, 6) AS z, shift, ci_low, ci_high FROM w, q""")
def _(t: Tables):
    return st.rank_sum_test(_years(t), "v", "g", "F", "other").select("n1", "n2", "w", _r("z"), "shift", "ci_low", "ci_high")


@query("rank_sum_continuous", """WITH v AS (SELECT round(c_acctbal, 2) AS v, c_mktsegment AS g FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
r AS (SELECT *, avg(i) OVER (PARTITION BY v) AS mid FROM (SELECT *, row_number() OVER (ORDER BY v) AS i FROM v)),
s AS (SELECT count(*) FILTER (g = 'BUILDING') AS n1, count(*) FILTER (g <> 'BUILDING') AS n2, sum(mid) FILTER (g = 'BUILDING') AS r1 FROM r),
d AS (SELECT a.v - b.v AS d, row_number() OVER (ORDER BY a.v - b.v) AS i FROM v a JOIN v b ON a.g = 'BUILDING' AND b.g <> 'BUILDING'),
k AS (SELECT *, n1 * n2 AS total, greatest(1, floor(n1 * n2 / 2 - 1.959963984540054 * sqrt(n1 * n2 * (n1 + n2 + 1) / 12))) AS k FROM s)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, any_value(r1) - any_value(n1) * (any_value(n1) + 1) / 2 AS w,
  round(avg(d) FILTER (i = (total + 1) // 2 OR i = (total + 2) // 2), 4) AS shift, round(min(d) FILTER (i = k), 4) AS ci_low, round(min(d) FILTER (i = total + 1 - k), 4) AS ci_high FROM d, k GROUP BY n1, n2""")
def _(t: Tables):
    test = st.rank_sum_test(t.customer.withColumn("v", F.round("c_acctbal", 2)), "v", "c_mktsegment", "BUILDING", "MACHINERY")
    return test.select("n1", "n2", "w", _r("shift", 4), _r("ci_low", 4), _r("ci_high", 4))


@query("ks_two_sample", f"""WITH {YEARS}, h AS (SELECT v, count(*) FILTER (WHERE g = 'F') AS n1, count(*) FILTER (WHERE g = 'other') AS n2 FROM yr GROUP BY v),
c AS (SELECT sum(n1) OVER (ORDER BY v) / sum(n1) OVER () AS f1, sum(n2) OVER (ORDER BY v) / sum(n2) OVER () AS f2, sum(n1) OVER () AS n1, sum(n2) OVER () AS n2 FROM h),
d AS (SELECT max(abs(f1 - f2)) AS d, max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2 FROM c)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(d, 9) AS d, round(CASE WHEN d * sqrt(n1 * n2 / (n1 + n2)) < 0.2 THEN 1 ELSE least(1.0, greatest(0.0, 2 *
 (SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * d * d * n1 * n2 / (n1 + n2))) FROM range(1, 101) r(k)))) END, 8) AS pvalue FROM d""")
def _(t: Tables):
    return st.ks_two_sample(_years(t), "v", "g", "F", "other").select("n1", "n2", _r("d", 9), _r("pvalue", 8))


@query("group_summary", f"""WITH {YEARS} SELECT g, count(*) AS n, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, round(avg(v), 6) AS mean, quantile_cont(v, 0.75) AS q3, max(v) AS max FROM yr GROUP BY g""")
def _(t: Tables):
    return st.group_summary(_years(t), "v", "g").withColumn("mean", F.round("mean", 6))


@query("phi_cooccurrence", f"""WITH {NAMES}, n AS (SELECT count(*)::DOUBLE AS n FROM customer), c AS (SELECT feature, count(*) AS k FROM names GROUP BY feature),
top AS (SELECT feature, k FROM c, n WHERE k >= 5 AND k <= n - 5 ORDER BY k DESC, feature LIMIT 80),
x AS (SELECT a.feature AS fa, b.feature AS fb, count(*) AS n11 FROM names a JOIN names b ON a.sample = b.sample AND a.feature < b.feature GROUP BY ALL)
SELECT a.feature AS feature_a, b.feature AS feature_b, coalesce(n11, 0) AS n_both,
 round((n * coalesce(n11, 0) - a.k * b.k) / sqrt(a.k * (n - a.k) * b.k * (n - b.k)), 8) AS phi
FROM top a JOIN top b ON a.feature < b.feature CROSS JOIN n LEFT JOIN x ON fa = a.feature AND fb = b.feature""")
def _(t: Tables):
    return st.phi_cooccurrence(t.names, t.roster).withColumn("phi", F.round("phi", 8))


JACCARD = f"""WITH {NATION_GENES}, r AS (SELECT DISTINCT c_nationkey AS sample FROM customer),
v AS (SELECT * FROM ngenes WHERE feature IN (SELECT feature FROM ngenes GROUP BY feature HAVING count(*) < (SELECT count(*) FROM r))),
s AS (SELECT r.sample, count(feature) AS n FROM r LEFT JOIN v USING (sample) GROUP BY r.sample),
x AS (SELECT a.sample AS sa, b.sample AS sb, count(*) AS n FROM v a JOIN v b ON a.feature = b.feature AND a.sample < b.sample GROUP BY ALL),
jac AS (SELECT a.sample AS sample_a, b.sample AS sample_b, CASE WHEN a.n + b.n = 0 THEN 0.0 ELSE 1 - coalesce(x.n, 0) / (a.n + b.n - coalesce(x.n, 0))::DOUBLE END AS distance
 FROM s a JOIN s b ON a.sample < b.sample LEFT JOIN x ON sa = a.sample AND sb = b.sample)"""


def _jaccard(t: Tables):
    roster = t.customer.select(F.col("c_nationkey").alias("sample")).distinct()
    return st.jaccard_distance(t.nation_genes, roster)


@query("jaccard_distance", JACCARD + " SELECT sample_a, sample_b, round(distance, 9) AS distance FROM jac")
def _(t: Tables):
    return _jaccard(t).withColumn("distance", F.round("distance", 9))


@query("pcoa")
def _(t: Tables):
    return st.pcoa(_jaccard(t))


# square roots of Jaccard distances are Euclidean, so all axes together give every distance back
@query("pcoa_rebuilt_distances", JACCARD + " SELECT sample_a, sample_b, round(distance, 8) AS distance FROM jac")
def _(t: Tables):
    rooted = _jaccard(t).withColumn("distance", F.sqrt("distance"))
    place = st.pcoa(rooted, t.nation.count()).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("axis", "coordinate"))).alias("at"))
    left, right = (place.select(F.col("sample").alias(f"sample_{s}"), F.col("at").alias(f"at_{s}")) for s in "ab")
    apart = F.aggregate(F.map_keys("at_a"), F.lit(0.0), lambda total, k: total + F.pow(F.element_at("at_a", k) - F.element_at("at_b", k), F.lit(2.0)))
    return left.join(right, F.col("sample_a") < F.col("sample_b")).select("sample_a", "sample_b", F.round(apart, 8).alias("distance"))


def _nation_groups(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").alias("grp"))


@query("permanova", JACCARD + """, g AS (SELECT n_nationkey AS sample, n_regionkey AS grp FROM nation),
k AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT grp) AS a FROM g), sz AS (SELECT grp, count(*)::DOUBLE AS m FROM g GROUP BY grp),
ss AS (SELECT sum(distance * distance) AS tot, sum(CASE WHEN ga.grp = gb.grp THEN distance * distance / m ELSE 0 END) AS w
 FROM jac JOIN g ga ON ga.sample = sample_a JOIN g gb ON gb.sample = sample_b JOIN sz ON sz.grp = ga.grp)
SELECT round(((tot / n - w) / (a - 1)) / (w / (n - a)), 6) AS pseudo_f, round((tot / n - w) / (tot / n), 8) AS r2 FROM ss, k""")
def _(t: Tables):
    return st.permanova(_jaccard(t), _nation_groups(t)).select(_r("pseudo_f"), _r("r2", 8))


@query("permanova_pvalue", JACCARD + """, g AS (SELECT n_nationkey AS sample, n_regionkey AS grp FROM nation WHERE n_nationkey IN (SELECT sample FROM s)),
k AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT grp) AS a FROM g), sz AS (SELECT grp, count(*)::DOUBLE AS m FROM g GROUP BY grp),
perm AS (SELECT r, sample, row_number() OVER (PARTITION BY r ORDER BY md5('1:' || r || ':' || sample), sample) AS slot FROM g, generate_series(1, 999) AS x(r)),
slots AS (SELECT grp, row_number() OVER (ORDER BY grp, sample) AS slot FROM g),
lab AS (SELECT r, sample, grp FROM perm JOIN slots USING (slot) UNION ALL SELECT 0, sample, grp FROM g),
ss AS (SELECT la.r, sum(distance * distance) AS tot, sum(CASE WHEN la.grp = lb.grp THEN distance * distance / m ELSE 0 END) AS w
 FROM jac JOIN lab la ON la.sample = sample_a JOIN lab lb ON lb.sample = sample_b AND lb.r = la.r JOIN sz ON sz.grp = la.grp GROUP BY la.r),
f AS (SELECT r, ((tot / n - w) / (a - 1)) / (w / (n - a)) AS f, (tot / n - w) / (tot / n) AS r2 FROM ss, k)
SELECT round(any_value(f) FILTER (WHERE r = 0), 6) AS pseudo_f, round(any_value(r2) FILTER (WHERE r = 0), 8) AS r2,
 (count(*) FILTER (WHERE r > 0 AND f >= (SELECT f FROM f WHERE r = 0) * (1 - 1e-9)) + 1) / 1000.0::DOUBLE AS pvalue FROM f""")
def _(t: Tables):
    return st.permanova(_jaccard(t), _nation_groups(t)).select(_r("pseudo_f"), _r("r2", 8), "pvalue")


SRC = "src AS (SELECT l_extendedprice / 1000 AS v, l_returnflag AS source FROM lineitem)"


def _values(t: Tables):
    return t.lineitem.select((F.col("l_extendedprice") / 1000).alias("v"), F.col("l_returnflag").alias("source"))


@query("density_histogram", f"""WITH {SRC}, s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 29 AS w FROM src),
b AS (SELECT source, CAST(floor((v - lo) / w + 0.5) AS BIGINT) AS bin, count(*) AS n, lo, w FROM src, s GROUP BY ALL)
SELECT source, bin, round(lo + bin * w, 6) AS center, n, round(n / (sum(n) OVER (PARTITION BY source) * w), 9) AS density FROM b""")
def _(t: Tables):
    return st.density_histogram(_values(t), "v", "source").select("source", "bin", _r("center"), "n", _r("density", 9))


@query("kernel_density", f"""WITH {SRC}, s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 511 AS st FROM src),
sp AS (SELECT source, count(*) AS n, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * power(count(*)::DOUBLE, -0.2) AS bw FROM src GROUP BY source),
x AS (SELECT source, (v - lo) / st AS x, least(floor((v - lo) / st), 510) AS k FROM src, s),
wt AS (SELECT source, k, sum(w) AS w FROM (SELECT source, k, 1 - (x - k) AS w FROM x UNION ALL SELECT source, k + 1, x - k FROM x) GROUP BY ALL)
SELECT wt.source, CAST(g AS BIGINT) AS point, round(lo + g * st, 6) AS x, round(sum(w * exp(-0.5 * ((g - k) * st / bw) * ((g - k) * st / bw)) / (n * bw * 2.5066282746310002)), 9) AS density
FROM wt JOIN sp ON sp.source = wt.source CROSS JOIN s CROSS JOIN range(0, 512) r(g) GROUP BY wt.source, g, lo, st""")
def _(t: Tables):
    return st.kernel_density(_values(t), "v", "source").select("source", F.col("point").cast("long").alias("point"), _r("x"), _r("density", 9))


@query("wide_to_long", """WITH w AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE c_acctbal > 0) AS in_credit, count(*) FILTER (WHERE c_acctbal <= 0) AS in_debt FROM customer GROUP BY 1)
SELECT k, 'in_credit' AS kind, in_credit AS n FROM w UNION ALL SELECT k, 'in_debt', in_debt FROM w""")
def _(t: Tables):
    w = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(
        F.count_if(F.col("c_acctbal") > 0).alias("in_credit"), F.count_if(F.col("c_acctbal") <= 0).alias("in_debt")
    )
    return mb.wide_to_long(w, ["k"], ["in_credit", "in_debt"], "kind", "n")
