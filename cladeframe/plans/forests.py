"""Cluster and tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.operators import clusters as cl, recombination as rc, trees as tr
from cladeframe.plans.registry import query
from cladeframe.plans.tables import CLOSURE, KEEP_ALL, NATION_TREE, TREE, Tables

T_ALL = "RECURSIVE " + TREE + CLOSURE
T_NATION = "RECURSIVE " + NATION_TREE + CLOSURE


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


def _parts(edges: DataFrame):
    edges = cut(edges)
    return edges, tr.tree_closure(edges), tr.tree_tips(edges)


def _tips(edges: DataFrame):
    edges = cut(edges)
    return edges, tr.tree_tips(edges)


@query("tree_closure", f"WITH {T_ALL} SELECT 't' AS tree_id, anc, descn AS \"desc\", dist, hops, branch FROM closure")
def _(t: Tables):
    return tr.tree_closure(t.tree)


@query("node_depths", f"WITH {T_ALL} SELECT 't' AS tree_id, descn AS node, dist AS depth, hops FROM closure WHERE anc = 'root'")
def _(t: Tables):
    return tr.node_depths(cut(t.tree))


@query("clade_members", f"WITH {T_ALL} SELECT 't' AS tree_id, anc AS node, descn AS tip, dist, hops, branch FROM closure WHERE descn IN (SELECT node FROM tips)")
def _(t: Tables):
    _, closure, tips = _parts(t.tree)
    return tr.clade_members(closure, tips)


@query("sister_clades", f"""WITH {T_ALL} SELECT 't' AS tree_id, a.node, b.node AS sister, n AS sister_tips FROM edges a JOIN edges b ON a.parent = b.parent AND a.node <> b.node JOIN sizes ON sizes.node = b.node
WHERE a.node NOT IN (SELECT node FROM tips)""")
def _(t: Tables):
    edges, closure, tips = _parts(t.tree)
    return tr.sister_clades(edges, closure, tips)


@query("tree_distances", f"""WITH {T_NATION}, a AS (SELECT * FROM closure WHERE descn IN (SELECT node FROM tips) AND branch IS NOT NULL)
SELECT 't' AS tree_id, x.descn AS tip_a, y.descn AS tip_b, x.anc AS mrca, CAST(x.dist + y.dist AS BIGINT) AS patristic, x.hops + y.hops AS edge_count, CAST(r.dist AS BIGINT) AS mrca_depth
FROM a x JOIN a y ON x.anc = y.anc AND x.descn < y.descn AND x.branch <> y.branch JOIN closure r ON r.anc = 'root' AND r.descn = x.anc""")
def _(t: Tables):
    return tr.tree_distances(*_tips(t.nation_tree))


@query("tree_distances_of_pairs", f"""WITH {T_ALL}, p AS (SELECT a.c_name AS tip_a, b.c_name AS tip_b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey * 7 % 1009 + 1),
u AS (SELECT * FROM closure WHERE descn IN (SELECT node FROM tips)),
m AS (SELECT tip_a, tip_b, max_by(x.anc, r.hops) AS mrca, max(r.hops) AS top FROM p JOIN u x ON x.descn = tip_a JOIN u y ON y.descn = tip_b AND y.anc = x.anc JOIN closure r ON r.anc = 'root' AND r.descn = x.anc GROUP BY 1, 2)
SELECT 't' AS tree_id, tip_a, tip_b, mrca, CAST(x.dist + y.dist AS BIGINT) AS patristic, x.hops + y.hops AS edge_count, CAST(r.dist AS BIGINT) AS mrca_depth
FROM m JOIN closure x ON x.descn = tip_a AND x.anc = mrca JOIN closure y ON y.descn = tip_b AND y.anc = mrca JOIN closure r ON r.anc = 'root' AND r.descn = mrca""")
def _(t: Tables):
    a = t.customer.select(F.col("c_name").alias("tip_a"), (F.col("c_custkey") * 7 % 1009 + 1).alias("c_custkey"))
    pairs = a.join(t.customer.select("c_custkey", F.col("c_name").alias("tip_b")), "c_custkey").select(F.lit("t").alias("tree_id"), "tip_a", "tip_b")
    return tr.tree_distances(*_tips(t.tree), pairs)


RATIO = KEEP_ALL + f""", ppair AS (SELECT strain1 AS a, strain2 AS b, div FROM kall),
am AS (SELECT * FROM closure WHERE branch IS NOT NULL AND descn IN (SELECT node FROM tips)),
met AS (SELECT x.anc AS mrca, x.branch AS ba, y.branch AS bb, div, p.a, p.b FROM ppair p JOIN am x ON x.descn = p.a JOIN am y ON y.descn = p.b AND y.anc = x.anc AND x.branch <> y.branch),
insd AS (SELECT c.anc AS node, avg(div) AS inside_div FROM met JOIN closure c ON c.descn = met.mrca GROUP BY c.anc),
acr AS (SELECT node, avg(div) AS sister_div FROM (SELECT ba AS node, div FROM met UNION ALL SELECT bb, div FROM met) GROUP BY node),
pd AS (SELECT c.anc AS node, x.dist + y.dist AS d FROM closure c JOIN am x ON x.anc = c.descn JOIN am y ON y.anc = x.anc AND x.descn < y.descn AND x.branch <> y.branch),
id AS (SELECT node, avg(d) AS inside_dist FROM pd GROUP BY node),
sd AS (SELECT x.branch AS node, avg(x.dist + y.dist) AS sister_dist FROM am x JOIN am y ON x.anc = y.anc AND x.branch <> y.branch GROUP BY x.branch),
ratio AS (SELECT e.node, n AS n_tips, sister_dist, inside_dist, sister_div, inside_div FROM edges e JOIN sizes USING (node) LEFT JOIN sd USING (node) LEFT JOIN id USING (node) LEFT JOIN acr USING (node) LEFT JOIN insd USING (node)
  WHERE e.parent IS NOT NULL AND e.node NOT IN (SELECT node FROM tips))"""


def _ratio(t: Tables):
    edges, closure, tips = _parts(t.nation_tree)
    pairs = cut(rc.classify_pairs(t.pair_stats, keep_all=True).select("strain1", "strain2", "div"))
    tip_pairs = pairs.select(F.lit("t").alias("tree_id"), F.col("strain1").alias("tip_a"), F.col("strain2").alias("tip_b"), "div")
    return tr.clade_vs_sister_ratio(edges, closure, tips, tip_pairs), closure, tips, pairs


@query("clade_vs_sister_ratio", f"""WITH {T_NATION}, {RATIO} SELECT 't' AS tree_id, node, n_tips, round(sister_dist, 6) AS sister_dist, round(inside_dist, 6) AS inside_dist, round(sister_dist / inside_dist, 8) AS dist_ratio,
round(sister_div, 8) AS sister_div, round(inside_div, 8) AS inside_div, round(sister_div / inside_div, 6) AS div_ratio FROM ratio""")
def _(t: Tables):
    return _ratio(t)[0].select(
        "tree_id", "node", "n_tips", _r("sister_dist"), _r("inside_dist"), _r("dist_ratio", 8), _r("sister_div", 8), _r("inside_div", 8), _r("div_ratio")
    )


@query("sweep_calls", f"""WITH {T_NATION}, {RATIO} SELECT 't' AS tree_id, node AS sweep_id, descn AS tip FROM ratio JOIN closure ON anc = node
WHERE descn IN (SELECT node FROM tips) AND sister_div / inside_div >= 1.0 AND n_tips >= 3""")
def _(t: Tables):
    ratios, closure, tips, pairs = _ratio(t)
    # nations are not real clades, so the cut is lowered to call some; no pair leaves the single tree
    return tr.sweep_calls(ratios, closure, tips, pairs, min_ratio=1.0)


@query("monophyly_test", f"""WITH {T_ALL}, l AS (SELECT c_name AS node, 'seg-' || c_mktsegment AS label FROM customer UNION ALL SELECT c_name, 'reg-' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT label, count(*) AS n_members FROM l GROUP BY label),
h AS (SELECT label, anc, count(*) AS held FROM l JOIN closure ON descn = l.node GROUP BY label, anc)
SELECT 't' AS tree_id, label, n_members, min(sizes.n) AS clade_size, min(sizes.n) = n_members AS monophyletic FROM h JOIN m USING (label) JOIN sizes ON sizes.node = anc WHERE held = n_members GROUP BY label, n_members""")
def _(t: Tables):
    _, closure, tips = _parts(t.tree)
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    seg = t.customer.select(F.lit("t").alias("tree_id"), F.col("c_name").alias("node"), F.concat(F.lit("seg-"), "c_mktsegment").alias("label"))
    reg = t.customer.join(nation, "c_nationkey").select(F.lit("t").alias("tree_id"), F.col("c_name").alias("node"), F.concat(F.lit("reg-"), F.col("n_regionkey").cast("string")).alias("label"))
    return tr.monophyly_test(closure, tips, seg.unionByName(reg))


@query("clade_label_consensus", f"""WITH {T_ALL}, l AS (SELECT c_name AS node, CASE WHEN c_nationkey % 4 = 0 THEN 'even' WHEN c_nationkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS label FROM customer)
SELECT 't' AS tree_id, anc AS node, CASE WHEN min(label) = max(label) AND count(label) = count(*) THEN min(label) ELSE 'mixed' END AS label FROM closure JOIN l ON l.node = descn GROUP BY anc""")
def _(t: Tables):
    _, closure, tips = _parts(t.tree)
    n = F.col("c_nationkey") % 4
    labels = t.customer.select(F.lit("t").alias("tree_id"), F.col("c_name").alias("node"), F.when(n == 0, "even").when(n > 1, F.col("c_mktsegment")).alias("label"))
    return tr.clade_label_consensus(closure, tips, labels)


@query("prune_tree", f"""WITH {T_ALL}, k AS (SELECT c_name AS node FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9800),
f AS (SELECT anc AS node FROM closure WHERE branch IS NOT NULL AND descn IN (SELECT node FROM k) GROUP BY anc HAVING count(DISTINCT branch) >= 2),
nd AS (SELECT node FROM f UNION SELECT node FROM k),
up AS (SELECT descn, arg_min(anc, hops) AS parent, arg_min(dist, hops) AS length FROM closure WHERE hops > 0 AND anc IN (SELECT node FROM f) GROUP BY descn)
SELECT 't' AS tree_id, nd.node, up.parent, CAST(up.length AS BIGINT) AS length, e.name FROM nd LEFT JOIN up ON descn = nd.node JOIN edges e ON e.node = nd.node""")
def _(t: Tables):
    edges, closure, _ = _parts(t.tree)
    keep = t.customer.filter("c_mktsegment = 'BUILDING' OR c_acctbal > 9800").select(F.lit("t").alias("tree_id"), F.col("c_name").alias("node"))
    return tr.prune_tree(edges, closure, keep)


@query("midpoint_root")
def _(t: Tables):
    return tr.midpoint_root(*_parts(t.tree))


@query("tip_order", """SELECT 't' AS tree_id, c_name AS tip, row_number() OVER (ORDER BY 'r' || n_regionkey, 'n' || c_nationkey, c_name) - 1 AS position FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(t: Tables):
    return tr.tip_order(*_tips(t.tree))


@query("tip_order_ladderized", """WITH s AS (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS nn FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 't' AS tree_id, c_name AS tip, row_number() OVER (ORDER BY rn, 'r' || n_regionkey, nn, 'n' || c_nationkey, c_name) - 1 AS position FROM s""")
def _(t: Tables):
    return tr.tip_order(*_tips(t.tree), ladderize=True)


@query("tip_overlap", """SELECT count(*) FILTER (WHERE c_acctbal > 0 AND c_acctbal < 8000) AS shared, count(*) FILTER (WHERE c_acctbal > 0 AND NOT c_acctbal < 8000) AS only_first, count(*) FILTER (WHERE NOT c_acctbal > 0 AND c_acctbal < 8000) AS only_second FROM customer""")
def _(t: Tables):
    tips = lambda cond: t.customer.filter(cond).select(F.col("c_name").alias("tip"))
    return tr.tip_overlap(tips("c_acctbal > 0"), tips("c_acctbal < 8000"))


@query("tangle_crossings", """WITH o AS (SELECT row_number() OVER (ORDER BY 'r' || n_regionkey, 'n' || c_nationkey, c_name) AS y1, row_number() OVER (ORDER BY c_mktsegment, c_name) AS y2 FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT count(*) AS crossings FROM o a JOIN o b ON a.y1 < b.y1 AND a.y2 > b.y2""")
def _(t: Tables):
    return tr.tangle_crossings(tr.tip_order(*_tips(t.tree)), tr.tip_order(*_tips(t.tree2)))


@query("tip_depth_percentile", f"WITH {T_ALL} SELECT 't' AS tree_id, count(*) AS n, round(quantile_cont(dist, 0.99), 6) AS depth_pct, CAST(max(dist) AS DOUBLE) AS max_depth FROM closure WHERE anc = 'root' AND descn IN (SELECT node FROM tips)")
def _(t: Tables):
    return tr.tip_depth_percentile(*_tips(t.tree)).withColumn("depth_pct", F.round("depth_pct", 6))


# --- clusters ---------------------------------------------------------------
def _distances(t: Tables):
    strict = rc.classify_pairs(t.pair_stats)
    return strict.select("strain1", "strain2", (F.col("total_r") / 100).alias("distance"))


def _strains(t: Tables):
    return t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("strain")).distinct()


@query("average_linkage_clusters")
def _(t: Tables):
    return cl.average_linkage_clusters(_distances(t), _strains(t), 0.2)


MEMBERS = "mem AS (SELECT DISTINCT 'n' || c_nationkey AS strain, CASE WHEN c_nationkey % 7 = 6 THEN 'n' || c_nationkey ELSE 'k' || c_nationkey % 7 END AS cluster FROM customer)"
PRUNED = f"""{KEEP_ALL}, {MEMBERS}, us AS (SELECT * FROM mem WHERE cluster IN (SELECT cluster FROM mem GROUP BY cluster HAVING count(*) > 1)),
sd AS (SELECT a.cluster, strain1, strain2, div, a.side FROM (SELECT cluster, strain1, strain2, div, CASE count(*) WHEN 2 THEN 'in' ELSE 'out' END AS side FROM kall JOIN us ON strain IN (strain1, strain2) GROUP BY cluster, strain1, strain2, div) a),
mo AS (SELECT cluster, avg(div) AS m FROM sd WHERE side = 'out' GROUP BY cluster),
kp AS (SELECT cluster, strain1, strain2 FROM sd LEFT JOIN mo USING (cluster) WHERE side = 'in' AND (m IS NULL OR div < m)),
pruned AS (SELECT DISTINCT cluster, strain1 AS strain FROM kp UNION SELECT cluster, strain2 FROM kp)"""


def _members(t: Tables):
    k = F.col("c_nationkey")
    name = F.concat(F.lit("n"), k.cast("string"))
    return t.customer.select(
        name.alias("strain"), F.when(k % 7 == 6, name).otherwise(F.concat(F.lit("k"), (k % 7).cast("string"))).alias("cluster")
    ).distinct()


def _pruned(t: Tables):
    return cl.prune_divergent_members(_members(t), rc.classify_pairs(t.pair_stats, keep_all=True).select("strain1", "strain2", "div"))


@query("prune_divergent_members", f"WITH {PRUNED} SELECT cluster, strain FROM pruned")
def _(t: Tables):
    return _pruned(t)


@query("renumber_with_singletons", f"""WITH {PRUNED}, al AS (SELECT strain, 0 AS rk, cluster AS label FROM pruned UNION ALL SELECT strain, 1, strain FROM mem WHERE strain NOT IN (SELECT strain FROM pruned))
SELECT strain, dense_rank() OVER (ORDER BY rk, label) AS cluster, count(*) OVER (PARTITION BY rk, label) AS size, count(*) OVER (PARTITION BY rk, label) >= 3 AS reported FROM al""")
def _(t: Tables):
    return cl.renumber_with_singletons(_pruned(t), _strains(t))
