"""Identifier, membership, lookup, interval and contig queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.functions import labels as lb
from cladeframe.operators import intervals as iv, membership as mb
from cladeframe.plans.registry import query
from cladeframe.plans.tables import INTERVALS, Tables


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


@query("accession_short_id", """SELECT c_custkey, CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS short_id,
'GCA_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.1' AS other_prefix_kept FROM customer""")
def _(t: Tables):
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    path = F.concat(F.lit("/data/set.1/GCF_"), number, F.lit(".1_asm.fna"))
    other = F.concat(F.lit("GCA_"), number, F.lit(".1"))
    return t.customer.select(
        "c_custkey", lb.accession_short_id(path).alias("short_id"),
        F.when(lb.accession_short_id(other, ["GCF"]) == F.regexp_replace(other, r"\..*", ""), other).alias("other_prefix_kept"),
    )


@query("clean_sample_id", "SELECT c_custkey, c_name AS sample FROM customer")
def _(t: Tables):
    raw = F.concat(F.lit("  '"), "c_name", F.element_at(F.array(F.lit(".fna"), F.lit(".FASTA"), F.lit(".gff"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("\" "))
    inner = F.concat(F.lit(" "), "c_name", F.lit(".FNA "))
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, lb.clean_sample_id(raw)).otherwise(lb.clean_sample_id(inner)).alias("sample"))


@query("aligner_safe_names", """SELECT page_id, translate(url, '.-:;,()[]|/ ', '____________') AS replaced, replace(replace(url, '.', ''), '-', '') AS deleted FROM pages""")
def _(t: Tables):
    return t.pages.select(
        "page_id", lb.aligner_safe_name(F.col("url")).alias("replaced"), lb.aligner_safe_name(F.col("url"), "delete").alias("deleted")
    )


@query("sampling_year", """SELECT o_custkey AS tip, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS year FROM orders GROUP BY 1, 2""")
def _(t: Tables):
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("ca. "), F.date_format("o_orderdate", "yyyy"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return t.orders.select(F.col("o_custkey").alias("tip"), lb.sampling_year(text).alias("year")).dropDuplicates()


@query("pattern_membership_filter", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(CAST(c_custkey AS VARCHAR), '13|7+2|^9')")
def _(t: Tables):
    return mb.pattern_membership_filter(t.customer, "c_custkey", ["13", "7+2", "^9"]).select("c_custkey", "c_name")


@query("exact_membership_filter", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(t: Tables):
    ids = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return mb.exact_membership_filter(t.lineitem, ids, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("exact_membership_complement", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t: Tables):
    ids = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return mb.exact_membership_filter(t.customer, ids, "c_custkey", keep=False).select("c_custkey")


@query("threshold_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > -900 AND c_acctbal < 9500 AND abs(c_acctbal) >= 500")
def _(t: Tables):
    return mb.threshold_filter(t.customer, "c_acctbal", -900, 9500, 500).select("c_custkey", "c_acctbal")


@query("roster_reconcile", """SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'linked' ELSE 'missing' END AS status FROM customer""")
def _(t: Tables):
    files = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return mb.roster_reconcile(t.customer.select(F.col("c_custkey").alias("id")), files, "id")


@query("match_ids_exact_then_token", """WITH names AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'GCA_x_' || c_custkey ELSE c_custkey || '-' || c_custkey || '_contigs' END AS sample FROM customer),
ids AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders),
tk AS (SELECT sample, unnest(regexp_split_to_array(sample, '[^A-Za-z0-9]+')) AS tok FROM names),
one AS (SELECT tok, min(sample) AS sample FROM tk GROUP BY tok HAVING count(*) = 1)
SELECT id, coalesce(n.sample, one.sample) AS sample, CASE WHEN n.sample IS NOT NULL THEN 'exact' WHEN one.sample IS NOT NULL THEN 'token' ELSE 'missing' END AS matched_by
FROM ids LEFT JOIN names n ON n.sample = id LEFT JOIN one ON tok = id""")
def _(t: Tables):
    key, kind = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 3
    names = t.customer.select(
        F.when(kind == 0, key).when(kind == 1, F.concat(F.lit("GCA_x_"), key)).otherwise(F.concat(key, F.lit("-"), key, F.lit("_contigs"))).alias("name")
    )
    return mb.match_ids_exact_then_token(t.orders.select(F.col("o_custkey").cast("string").alias("oid")), names, "oid", "name")


@query("tree_year_group_join", """WITH y AS (SELECT DISTINCT o_custkey AS tip, year(o_orderdate) AS year FROM orders)
SELECT tip, year, CASE WHEN c_mktsegment = 'BUILDING' THEN 'listed' ELSE 'other' END AS grp FROM y JOIN customer ON c_custkey = tip WHERE c_acctbal > 0""")
def _(t: Tables):
    years = t.orders.select(F.col("o_custkey").alias("tip"), lb.sampling_year(F.date_format("o_orderdate", "yyyy-MM")).alias("year")).distinct()
    tips = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("tip"))
    listed = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tip"))
    return mb.tree_year_group_join(tips, years, listed)


@query("enrich_with_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, '') AS p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey")
def _(t: Tables):
    lookup = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return mb.enrich_with_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), lookup, "l_partkey", "p_name")


@query("inside_outside_pairs", """WITH p AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b FROM lineitem WHERE l_suppkey <> l_partkey % 100),
m AS (SELECT s_nationkey AS cluster, s_suppkey AS strain FROM supplier),
e AS (SELECT cluster, a, b FROM p JOIN m ON strain = a UNION ALL SELECT cluster, a, b FROM p JOIN m ON strain = b)
SELECT cluster, a AS strain1, b AS strain2, CASE count(*) WHEN 2 THEN 'inside' ELSE 'outside' END AS side FROM e GROUP BY cluster, a, b""")
def _(t: Tables):
    other = F.col("l_partkey") % 100
    pairs = t.lineitem.filter(F.col("l_suppkey") != other).select(
        F.least("l_suppkey", other).alias("strain1"), F.greatest("l_suppkey", other).alias("strain2")
    ).distinct()
    return mb.inside_outside_pairs(pairs, t.supplier.select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("strain")))


SEEDS = """seeds AS (SELECT c_mktsegment AS grp, c_custkey AS id FROM customer WHERE c_acctbal > 9900),
cat AS (SELECT c_custkey AS id, c_nationkey AS category FROM customer), ds AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
sr AS (SELECT grp, id, category FROM seeds JOIN cat USING (id)), w AS (SELECT DISTINCT grp, category FROM sr),
al AS (SELECT grp, cat.id, category FROM w JOIN cat USING (category) WHERE cat.id IN (SELECT id FROM ds))"""


def _seeds(t: Tables):
    return (
        t.customer.filter("c_acctbal > 9900").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("id")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("category")),
        t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct(),
    )


@query("snp_cluster_expansion", f"""WITH {SEEDS}
SELECT grp, in_seed, coalesce(total, 0) AS total, coalesce(extra, 0) AS extra FROM (SELECT grp, count(*) AS in_seed FROM sr GROUP BY grp)
LEFT JOIN (SELECT grp, count(*) AS total, count(*) FILTER (WHERE (grp, id) NOT IN (SELECT (grp, id) FROM seeds)) AS extra FROM al GROUP BY grp) USING (grp)""")
def _(t: Tables):
    return mb.snp_cluster_expansion(*_seeds(t))


@query("expansion_extras", f"WITH {SEEDS} SELECT grp, id, category FROM al WHERE (grp, id) NOT IN (SELECT (grp, id) FROM seeds)")
def _(t: Tables):
    return mb.expansion_extras(*_seeds(t))


LISTS = """lists AS (SELECT c_custkey AS id, 'rich' AS grp, 1 AS priority FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT DISTINCT o_custkey, 'urgent', 2 FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT c_custkey, 'building', 3 FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _lists(t: Tables):
    one = lambda df, col, grp, p: df.select(F.col(col).alias("id"), F.lit(grp).alias("grp"), F.lit(p).alias("priority"))
    return one(t.customer.filter("c_acctbal > 5000"), "c_custkey", "rich", 1).unionByName(
        one(t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct(), "o_custkey", "urgent", 2)
    ).unionByName(one(t.customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey", "building", 3))


@query("priority_group_assignment", f"""WITH {LISTS} SELECT f.id, f.grp AS first_wins, l.grp AS last_wins
FROM (SELECT id, arg_min(grp, priority) AS grp FROM lists GROUP BY id) f JOIN (SELECT id, arg_max(grp, priority) AS grp FROM lists GROUP BY id) l USING (id)""")
def _(t: Tables):
    lists = _lists(t)
    first = mb.priority_group_assignment(lists).withColumnRenamed("grp", "first_wins")
    return first.join(mb.priority_group_assignment(lists, overwrite=True).withColumnRenamed("grp", "last_wins"), "id")


@query("priority_group_sizes", f"""WITH {LISTS}, a AS (SELECT id, arg_max(grp, priority) AS grp FROM lists GROUP BY id)
SELECT grp, n_listed, coalesce(n_assigned, 0) AS n_assigned FROM (SELECT grp, count(*) AS n_listed FROM lists GROUP BY grp) LEFT JOIN (SELECT grp, count(*) AS n_assigned FROM a GROUP BY grp) USING (grp)""")
def _(t: Tables):
    lists = _lists(t)
    return mb.group_sizes(lists, mb.priority_group_assignment(lists, overwrite=True))


CALLS = """calls AS (SELECT c_custkey AS genome, CASE WHEN c_acctbal > 5000 THEN 'pos' WHEN c_acctbal > 2000 THEN 'partial' WHEN c_acctbal >= 0 THEN 'neg' END AS status FROM customer),
old AS (SELECT DISTINCT o_custkey AS genome FROM orders WHERE o_totalprice > 450000)"""


def _calls(t: Tables):
    b = F.col("c_acctbal")
    # an overdrawn customer stands for a genome without a call
    return t.customer.select(
        F.col("c_custkey").alias("genome"), F.when(b > 5000, "pos").when(b > 2000, "partial").when(b >= 0, "neg").alias("status")
    )


def _agreement(t: Tables):
    return mb.call_agreement(_calls(t), t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("genome")))


@query("call_agreement", f"""WITH {CALLS} SELECT coalesce(c.genome, o.genome) AS genome, status, CASE WHEN o.genome IS NULL THEN 'neg' ELSE 'pos' END AS old_call,
CASE WHEN status IS NOT NULL THEN (o.genome IS NOT NULL) = (status = 'pos') END AS agree FROM calls c FULL JOIN old o ON c.genome = o.genome""")
def _(t: Tables):
    return _agreement(t)


@query("agreement_counts", f"""WITH {CALLS}, a AS (SELECT status, o.genome IS NOT NULL AS was FROM calls c FULL JOIN old o ON c.genome = o.genome)
SELECT count(*) FILTER (WHERE was = (status = 'pos')) AS n_agree, count(*) FILTER (WHERE was <> (status = 'pos')) AS n_changed,
count(*) FILTER (WHERE was AND NOT coalesce(status = 'pos', false)) AS n_only_old, count(*) FILTER (WHERE NOT was AND status = 'pos') AS n_only_new, count(*) FILTER (WHERE status IS NULL) AS n_unknown FROM a""")
def _(t: Tables):
    return mb.agreement_counts(_agreement(t))


@query("phenotype_from_status", f"""WITH {CALLS} SELECT genome, CASE status WHEN 'pos' THEN 1 ELSE 0 END AS phenotype FROM calls
WHERE status <> 'partial' AND genome IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def _(t: Tables):
    return mb.phenotype_from_status(_calls(t), t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("genome")))


@query("sample_metadata_table", """WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey AS sample, CASE WHEN c_acctbal > 5000 THEN 'full' WHEN c_acctbal > 2000 THEN 'partial' ELSE 'absent' END AS detail,
CASE WHEN c_acctbal > 2000 THEN '+' ELSE '-' END AS carrier, CASE WHEN c_mktsegment = 'BUILDING' THEN 'first' WHEN o_custkey IS NOT NULL THEN 'second' ELSE 'other' END AS grp,
CASE WHEN c_acctbal > 2000 THEN 1 ELSE 0 END AS carrier_binary FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def _(t: Tables):
    ids = lambda cond: t.customer.filter(cond).select(F.col("c_custkey").alias("sample"))
    groups = ids("c_mktsegment = 'BUILDING'").select("sample", F.lit("first").alias("grp"), F.lit(1).alias("priority")).unionByName(
        t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("sample"), F.lit("second").alias("grp"), F.lit(2).alias("priority"))
    )
    return mb.sample_metadata_table(ids("true"), ids("c_acctbal > 5000"), ids("c_acctbal > 2000 AND c_acctbal <= 5000"), groups)


@query("sample_overlap", """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0),
u AS (SELECT 'common' AS "check", id FROM a WHERE id IN (SELECT id FROM b) AND id IN (SELECT id FROM c)
UNION ALL SELECT 'first_not_second', id FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'first_not_third', id FROM a WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'second_not_first', id FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'second_not_third', id FROM b WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'third_not_second', id FROM c WHERE id NOT IN (SELECT id FROM b))
SELECT "check", count(*) AS n, min(id) AS example FROM u GROUP BY 1""")
def _(t: Tables):
    o = lambda cond: t.orders.filter(cond).select(F.col("o_custkey").alias("id"))
    return mb.sample_overlap(o("o_orderstatus = 'F'"), o("o_orderpriority = '1-URGENT'"), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("labelled_union", """SELECT 'high' AS source, l_orderkey, l_discount FROM lineitem WHERE l_discount > 0.08 UNION ALL
SELECT 'taxed', l_orderkey, l_discount FROM lineitem WHERE l_tax > 0.06 UNION ALL SELECT 'all', l_orderkey, l_discount FROM lineitem""")
def _(t: Tables):
    li = t.lineitem
    cols = ["l_orderkey", "l_discount"]
    return mb.labelled_union({"high": li.filter("l_discount > 0.08").select(cols), "taxed": li.filter("l_tax > 0.06").select(cols), "all": li.select(cols)})


@query("st_label", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no MLST' WHEN c_custkey % 3 = 0 THEN 'ST32'
WHEN c_custkey % 3 = 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'novel ST' ELSE 'novel/partial (adk(~' || c_nationkey || '),purE(-))' END ELSE 'ST' || c_custkey END AS label FROM customer""")
def _(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    st = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 3 == 0, "32").when(k % 3 == 1, "-").otherwise(k.cast("string"))
    exact = F.array(F.lit("aroC(1)"), F.lit("dnaN(22)"))
    odd = F.array(F.lit("aroC(1)"), F.concat(F.lit("adk(~"), n.cast("string"), F.lit(")")), F.lit("purE(-)"))
    return t.customer.select("c_custkey", lb.st_label(st, F.when(n % 2 == 0, exact).otherwise(odd)).alias("label"))


# --- intervals and contigs --------------------------------------------------
MERGED = f"""{INTERVALS}, o AS (SELECT *, max(e) OVER (PARTITION BY genome ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
il AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY genome ORDER BY s, e) AS island FROM o),
mg AS (SELECT genome, min(s) AS start, max(e) AS "end" FROM il GROUP BY genome, island)"""
HOUR = 3_600_000_000


@query("merge_intervals", f'WITH {MERGED} SELECT genome, start, "end" FROM mg')
def _(t: Tables):
    return iv.merge_intervals(t.intervals, ["genome"], bucket_width=HOUR)


@query("merged_length", f'WITH {MERGED} SELECT genome, CAST(sum("end" - start) AS BIGINT) AS covered, count(*) AS n_islands FROM mg GROUP BY genome')
def _(t: Tables):
    return iv.merged_length(t.intervals, ["genome"], bucket_width=HOUR)


@query("complement_intervals", f"""WITH {MERGED}, sp AS (SELECT user_id AS genome, min(epoch_us(ts)) - 1000 AS s0, max(epoch_us(ts)) + 1000 AS e0 FROM events GROUP BY 1),
c AS (SELECT genome, greatest(start, s0) AS start, least("end", e0) AS "end", s0, e0 FROM mg JOIN sp USING (genome)),
g AS (SELECT genome, s0 AS start, min(start) AS stop FROM c GROUP BY genome, s0 UNION ALL SELECT genome, "end", coalesce(lead(start) OVER (PARTITION BY genome ORDER BY start), e0) FROM c)
SELECT genome, start, stop AS "end" FROM g WHERE start < stop""")
def _(t: Tables):
    spans = t.intervals.groupBy("genome").agg((F.min("start") - 1000).alias("start"), (F.max("start") + 1000).alias("end"))
    return iv.complement_intervals(spans, t.intervals, ["genome"], bucket_width=HOUR)


CONSENSUS = """ct AS (SELECT source AS genome, doc_id AS contig, length(text) AS length FROM documents),
h AS (SELECT source AS genome, doc_id AS contig, length(text) * (doc_id % 7) // 10 AS s, length(text) * (doc_id % 7 + 3) // 10 AS e FROM documents
  UNION ALL SELECT source, doc_id, length(text) * (doc_id % 5) // 10, length(text) * (doc_id % 5 + 4) // 10 FROM documents),
pos AS (SELECT genome, contig, s, e, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
cov AS (SELECT genome, contig, sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS c FROM pos GROUP BY ALL),
v AS (SELECT doc_id AS contig, CASE WHEN quality = 1 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n FROM labels),
lab AS (SELECT ct.genome, ct.contig, ct.length, CASE WHEN ct.length = 0 THEN 0 ELSE coalesce(c, 0) / ct.length::DOUBLE END AS aligned_share, coalesce(n, 0) + CASE WHEN d.lang = 'de' THEN 1 ELSE 0 END AS votes
  FROM ct JOIN documents d ON d.doc_id = ct.contig LEFT JOIN cov ON cov.contig = ct.contig LEFT JOIN v ON v.contig = ct.contig),
lb AS (SELECT *, CASE WHEN aligned_share >= 0.5 THEN CASE WHEN length >= 1500 THEN 'pESI' ELSE 'pESI_short' END WHEN votes >= 2 THEN 'plasmid_other' WHEN votes = 1 THEN 'uncertain' ELSE 'chromosome' END AS label FROM lab)"""


def _hits(t: Tables):
    n, k = F.length("text"), F.col("doc_id")
    one = lambda m, w: t.documents.select(
        F.col("source").alias("genome"), k.alias("contig"), F.floor(n * (k % m) / 10).alias("start"), F.floor(n * (k % m + w) / 10).alias("end")
    )
    return one(7, 3).unionByName(one(5, 4))


def _consensus(t: Tables):
    genome = t.documents.select(F.col("source").alias("genome"), F.col("doc_id").alias("contig"), "lang")
    marks = t.labels.select(F.col("doc_id").alias("contig"), "quality", "toxic").join(genome, "contig")
    tool = lambda df, cond, name: df.filter(cond).select("genome", "contig", F.lit(name).alias("tool"))
    calls = tool(marks, "quality = 1", "mob").unionByName(tool(marks, "toxic = 1", "platon")).unionByName(tool(genome, "lang = 'de'", "genomad"))
    return iv.contig_consensus_label(t.contigs, _hits(t), calls, min_length=1500)


@query("contig_consensus_label", f"WITH {CONSENSUS} SELECT genome, contig, length, round(aligned_share, 9) AS aligned_share, votes, label FROM lb")
def _(t: Tables):
    return _consensus(t).withColumn("aligned_share", F.round("aligned_share", 9))


@query("genome_plasmid_summary", f"""WITH {CONSENSUS}, th AS (SELECT genome, contig, contig * 37 % 900 * 1000 AS s, contig * 37 % 900 * 1000 + length AS e FROM ct),
t2 AS (SELECT th.genome, th.contig, s, e, max(e) OVER (PARTITION BY th.genome ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM th JOIN lb USING (contig) WHERE label LIKE 'pESI%'),
rc AS (SELECT genome, sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS c FROM t2 GROUP BY genome),
rl AS (SELECT genome, max(length * 30) AS ref_len FROM ct GROUP BY genome), tl AS (SELECT source AS genome, count(DISTINCT lang) AS n FROM documents GROUP BY 1),
p AS (SELECT lb.genome, count(*) AS n_contigs, CAST(sum(length) AS BIGINT) AS total_len, count(*) FILTER (WHERE label = 'pESI') AS n_pesi, count(*) FILTER (WHERE label = 'pESI_short') AS n_pesi_short,
  count(*) FILTER (WHERE label = 'plasmid_other') AS n_plasmid_other, count(*) FILTER (WHERE label = 'uncertain') AS n_uncertain, CAST(coalesce(sum(length) FILTER (WHERE label = 'chromosome'), 0) AS BIGINT) AS kept_len,
  CAST(coalesce(sum(length) FILTER (WHERE label = 'pESI'), 0) AS BIGINT) AS pl, CAST(coalesce(sum(length) FILTER (WHERE label = 'plasmid_other'), 0) AS BIGINT) AS plasmid_other_len FROM lb GROUP BY lb.genome),
f AS (SELECT p.*, coalesce(c, 0) / ref_len::DOUBLE AS cv, tl.n AS tn FROM p LEFT JOIN rc USING (genome) LEFT JOIN rl USING (genome) LEFT JOIN tl USING (genome))
SELECT genome, n_contigs, total_len, round(cv, 9) AS ref_coverage, CASE WHEN cv >= 0.06 THEN 'pos' WHEN cv >= 0.03 THEN 'partial' ELSE 'neg' END AS status, n_pesi, n_pesi_short, n_plasmid_other, n_uncertain, kept_len,
CASE WHEN cv >= 0.06 THEN pl ELSE 0 END AS pesi_len, plasmid_other_len, 4 - tn AS n_missing_tools FROM f""")
def _(t: Tables):
    at = F.col("contig") * 37 % 900 * 1000
    target = t.contigs.select("genome", "contig", at.alias("tstart"), (at + F.col("length")).alias("tend"), (F.col("length") * 30).alias("tlen"))
    tools = t.documents.select(F.col("source").alias("genome"), F.col("lang").alias("tool"))
    return iv.genome_plasmid_summary(_consensus(t), target, tools, pos=0.06, partial=0.03).withColumn("ref_coverage", F.round("ref_coverage", 9))


@query("genome_sizes", "SELECT source AS genome, CAST(sum(length(text)) AS BIGINT) AS size, count(*) AS n_contigs FROM documents GROUP BY source")
def _(t: Tables):
    return iv.genome_sizes(t.contigs)


N50 = """c AS (SELECT source AS genome, length(text) AS l, sum(length(text)) OVER (PARTITION BY source ORDER BY length(text) DESC RANGE UNBOUNDED PRECEDING) AS up, sum(length(text)) OVER (PARTITION BY source) AS tot FROM documents),
n AS (SELECT genome, max(l) AS n50 FROM c WHERE up * 2 >= tot GROUP BY genome)"""


@query("assembly_n50", f"WITH {N50} SELECT genome, n50 FROM n")
def _(t: Tables):
    return iv.assembly_n50(t.contigs)


@query("reference_isolate", f"WITH {N50} SELECT genome, n50 FROM n ORDER BY n50 DESC, genome LIMIT 1")
def _(t: Tables):
    return iv.reference_isolate(iv.assembly_n50(t.contigs))


@query("linearise_reference", """WITH c AS (SELECT source AS genome, doc_id AS contig_no, text,
coalesce(sum(length(text) + 100) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, max(doc_id) OVER (PARTITION BY source) AS m FROM documents)
SELECT genome, contig_no, CAST(o AS BIGINT) AS "offset", CASE WHEN contig_no = m THEN text ELSE text || repeat('N', 100) END AS piece FROM c""")
def _(t: Tables):
    contigs = t.documents.select(F.col("source").alias("genome"), F.col("doc_id").alias("contig_no"), F.col("text").alias("seq"))
    return iv.linearise_reference(contigs)
