"""Operators over a forest held as edges (tree_id, node, parent, length, name).

Roots have a null parent, tips a name. Depths, clade sizes, tip positions and last common
ancestors come from pointers that double their reach: about log2(depth) rounds of one row
a node. Questions on all ancestors of a node go through one closure table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.functions.lineage import cut, cut_while
from cladeframe.functions.scan import exact_percentiles, prefix_scan


def tree_closure(edges: DataFrame) -> DataFrame:
    """(tree_id, anc, desc, dist, hops, branch): every ancestor–descendant pair, self pairs at 0 hops.

    ``branch`` is the child of ``anc`` on the way to ``desc`` (null for self pairs).
    """
    far, more = cut_while(edges.filter(F.col("parent").isNotNull()).select(
        "tree_id", F.col("parent").alias("anc"), F.col("node").alias("desc"), F.col("length").alias("dist"),
        F.lit(1).alias("hops"), F.col("node").alias("branch"),
    ), F.lit(True))
    paths, reach = far, 1
    while more:
        # Paths of exactly ``reach`` hops are prolonged by all paths known; only the new ones are written.
        up = far.filter(F.col("hops") == reach).select("tree_id", "anc", F.col("desc").alias("mid"), F.col("dist").alias("d1"), "branch")
        down = paths.select("tree_id", F.col("anc").alias("mid"), "desc", F.col("dist").alias("d2"), "hops")
        far, more = cut_while(up.join(down, ["tree_id", "mid"]).select(
            "tree_id", "anc", "desc", (F.col("d1") + F.col("d2")).alias("dist"), (F.col("hops") + reach).alias("hops"), "branch"
        ), F.lit(True))
        paths, reach = paths.unionByName(far), reach * 2
    zero = F.lit(0).cast(paths.schema["dist"].dataType)
    own = edges.select(
        "tree_id", F.col("node").alias("anc"), F.col("node").alias("desc"), zero.alias("dist"),
        F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["node"].dataType).alias("branch"),
    )
    return paths.unionByName(own)


def tree_tips(edges: DataFrame) -> DataFrame:
    """(tree_id, node, name) of nodes that are nobody's parent."""
    inner = edges.select("tree_id", F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct()
    return edges.join(inner, ["tree_id", "node"], "left_anti").select("tree_id", "node", "name")


def lift(edges: DataFrame, **sums: Column) -> DataFrame:
    """(tree_id, node, hops, sums) of every node: each sum runs over the node and its ancestors, without the root.

    Every node points at an ancestor and holds the sums on the way to it; following the ancestor's own pointer doubles
    the way, so a tree of any shape takes log2(depth) rounds of at most one row a node. Nodes that have arrived at
    their root are written once and left out of later rounds.
    """
    own = lambda value: F.when(F.col("parent").isNull(), F.lit(0)).otherwise(value)
    names = ["hops", *sums]
    state = edges.select("tree_id", "node", F.col("parent").alias("up"), own(F.lit(1)).alias("hops"), *[own(v).alias(n) for n, v in sums.items()])
    arrived, moving, more = state.filter("up IS NULL"), state.filter("up IS NOT NULL"), True
    while more:
        seen = arrived.unionByName(moving).select("tree_id", F.col("node").alias("up"), F.col("up").alias("next"), *[F.col(n).alias(f"further_{n}") for n in names])
        state, more = cut_while(moving.join(seen, ["tree_id", "up"], "left").select(
            "tree_id", "node", F.col("next").alias("up"), *[(F.col(n) + F.coalesce(f"further_{n}", F.lit(0))).alias(n) for n in names]), F.col("up").isNotNull())
        arrived, moving = arrived.unionByName(state.filter("up IS NULL")), state.filter("up IS NOT NULL")
    return arrived.drop("up")


def tip_counts(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """(tree_id, node, n_tips): how many of ``tips`` are at or under each node.

    The same doubling seen from above: a node adds what the nodes exactly 1, 2, 4, … edges below it have gathered.
    """
    marked = tips.select("tree_id", "node", F.lit(1).cast("long").alias("n_tips"))
    state, more = edges.select("tree_id", "node", F.col("parent").alias("up")).join(marked, ["tree_id", "node"], "left").na.fill(0, ["n_tips"]), True
    while more:
        given = state.filter("up IS NOT NULL").groupBy("tree_id", F.col("up").alias("node")).agg(F.sum("n_tips").alias("given"))
        above = state.select("tree_id", F.col("node").alias("up"), F.col("up").alias("next"))
        state, more = cut_while(state.join(given, ["tree_id", "node"], "left").join(above, ["tree_id", "up"], "left").select(
            "tree_id", "node", F.col("next").alias("up"), (F.col("n_tips") + F.coalesce("given", F.lit(0))).alias("n_tips")), F.col("up").isNotNull())
    return state.drop("up")


def node_depths(edges: DataFrame) -> DataFrame:
    """Distance and hops of every node from its root."""
    return lift(edges, depth=F.col("length")).select("tree_id", "node", "depth", "hops")


def clade_members(closure: DataFrame, tips: DataFrame) -> DataFrame:
    """(tree_id, node, tip, dist, hops, branch): tips under each node."""
    return closure.join(tips.select("tree_id", F.col("node").alias("desc")), ["tree_id", "desc"]).select(
        "tree_id", F.col("anc").alias("node"), F.col("desc").alias("tip"), "dist", "hops", "branch"
    )


def clade_sizes(closure: DataFrame, tips: DataFrame) -> DataFrame:
    """Number of tips under each node."""
    return clade_members(closure, tips).groupBy("tree_id", "node").agg(F.count(F.lit(1)).alias("n_tips"))


def sister_clades(edges: DataFrame, closure: DataFrame, tips: DataFrame) -> DataFrame:
    """For every inner non-root node: its sister nodes with the number of tips under each."""
    sizes = clade_sizes(closure, tips)
    inner = edges.filter(F.col("parent").isNotNull()).join(tips, ["tree_id", "node"], "left_anti")
    other = edges.select("tree_id", "parent", F.col("node").alias("sister"))
    return (
        inner.select("tree_id", "node", "parent").join(other, ["tree_id", "parent"])
        .filter(F.col("node") != F.col("sister"))
        .join(sizes.select("tree_id", F.col("node").alias("sister"), F.col("n_tips").alias("sister_tips")), ["tree_id", "sister"])
        .select("tree_id", "node", "sister", "sister_tips")
    )


def seated_nodes(edges: DataFrame, tips: DataFrame, ladderize: bool = False) -> DataFrame:
    """(tree_id, node, parent, n_tips, before, hops, depth, position) of every node with tips at or under it.

    ``position`` counts the tips drawn before the node's first one, ``before`` those under its earlier siblings, which
    go by node id, or with ``ladderize`` by number of tips first. Siblings are ranged over all partitions, so a node
    may have any number of children.
    """
    by = ["n_tips", "node"] if ladderize else ["node"]
    sib = edges.select("tree_id", "node", "parent", "length").join(tip_counts(edges, tips).filter("n_tips > 0"), ["tree_id", "node"])
    placed = cut(sib.repartitionByRange("tree_id", "parent", *by).withColumn("__part", F.spark_partition_id()))
    ordered = cut(prefix_scan(placed, ["tree_id", "parent"], by, "__part", {"before": ("sum", "n_tips")}))
    return ordered.drop("__part", "length").join(lift(ordered, depth=F.col("length"), position=F.col("before")), ["tree_id", "node"])


def ancestor_table(seats: DataFrame) -> DataFrame:
    """(tree_id, k, i, low): the highest node that parts any of the tips i … i + 2^k from its neighbour.

    Tips i and i + 1 part at the parent of the only node that begins with tip i + 1 and has an earlier sibling. Runs of
    2^k such marks are joined from two runs half as long, so there are n·log n rows whatever the shape; ``low`` is
    (hops, node, depth).
    """
    upper = seats.select("tree_id", F.col("node").alias("parent"), F.struct("hops", "node", "depth").alias("low"))
    level, more = cut_while(seats.filter("before > 0").select("tree_id", "parent", (F.col("position") - 1).alias("i")).join(upper, ["tree_id", "parent"]).select(
        "tree_id", F.lit(0).alias("k"), "i", "low"), F.lit(True))
    levels, k = level, 0
    while more:
        other = level.select("tree_id", (F.col("i") - (1 << k)).alias("i"), F.col("low").alias("right"))
        k += 1
        level, more = cut_while(level.join(other, ["tree_id", "i"]).select("tree_id", F.lit(k).alias("k"), "i", F.least("low", "right").alias("low")), F.lit(True))
        levels = levels.unionByName(level)
    return levels


def tree_distances(edges: DataFrame, tips: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Patristic distance, edges between, last common ancestor and its depth of tip pairs.

    ``pairs`` (tree_id, tip_a, tip_b) are the asked ones; without them the answer is the square table, every pair of a
    tree once with tip_a < tip_b. The ancestor is found by two look-ups in ``ancestor_table``, so a pair costs the
    same in any tree. A tip asked against itself is its own ancestor; pairs with an unknown tip have no row.
    """
    return distances_of(cut(seated_nodes(edges, tips)), tips, pairs)


def distances_of(seats: DataFrame, tips: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``tree_distances`` from written ``seated_nodes``, which may serve several calls."""
    table = ancestor_table(seats)
    own = seats.join(tips.select("tree_id", "node"), ["tree_id", "node"], "left_semi").select("tree_id", "node", "position", "hops", "depth")
    end = lambda x: own.select("tree_id", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "position", "hops", "depth")])
    if pairs is None:
        sizes = own.groupBy("tree_id").agg(F.max("position").alias("last"))
        spread = end("a").join(sizes, "tree_id").filter(F.col("position_a") < F.col("last")).withColumn("position_b", F.explode(F.sequence(F.col("position_a") + 1, F.col("last"))))
        met = spread.join(end("b"), ["tree_id", "position_b"])
    else:
        asked = pairs.select("tree_id", F.col("tip_a").alias("node_a"), F.col("tip_b").alias("node_b"))
        met = asked.join(end("a"), ["tree_id", "node_a"]).join(end("b"), ["tree_id", "node_b"])
    gap = F.abs(F.col("position_a") - F.col("position_b"))
    met = met.withColumn("k", F.length(F.bin(gap)) - 1).withColumn("i", F.least("position_a", "position_b")).withColumn(
        "i2", F.greatest("position_a", "position_b") - F.expr("shiftleft(1L, k)"))
    first = table.select("tree_id", "k", "i", F.col("low").alias("low1"))
    second = table.select("tree_id", "k", F.col("i").alias("i2"), F.col("low").alias("low2"))
    own_low = F.when(gap == 0, F.struct(F.col("hops_a").alias("hops"), F.col("node_a").alias("node"), F.col("depth_a").alias("depth")))
    found = met.join(first, ["tree_id", "k", "i"], "left").join(second, ["tree_id", "k", "i2"], "left").withColumn("low", F.coalesce(own_low, F.least("low1", "low2")))
    a, b = (F.col("node_a"), F.col("node_b")) if pairs is not None else (F.least("node_a", "node_b"), F.greatest("node_a", "node_b"))
    return found.select(
        "tree_id", a.alias("tip_a"), b.alias("tip_b"), F.col("low.node").alias("mrca"),
        (F.col("depth_a") + F.col("depth_b") - 2 * F.col("low.depth")).alias("patristic"),
        (F.col("hops_a") + F.col("hops_b") - 2 * F.col("low.hops")).alias("edge_count"), F.col("low.depth").alias("mrca_depth"),
    )


def pair_mrca(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """Last common ancestor of given tip pairs (tree_id, tip_a, tip_b): the one where their branches differ."""
    up = closure.filter(F.col("branch").isNotNull())
    a = up.select("tree_id", F.col("desc").alias("tip_a"), F.col("anc").alias("mrca"), F.col("branch").alias("branch_a"))
    b = up.select("tree_id", F.col("desc").alias("tip_b"), F.col("anc").alias("mrca"), F.col("branch").alias("branch_b"))
    return pairs.join(a, ["tree_id", "tip_a"]).join(b, ["tree_id", "tip_b", "mrca"]).filter(
        F.col("branch_a") != F.col("branch_b")
    )


def _ratio(outside: Column, inside: Column) -> Column:
    """Outside against inside: infinite where only the inside is 0, null where both are."""
    return F.when((inside == 0) & (outside > 0), F.lit(float("inf"))).otherwise(F.try_divide(outside, inside))


def clade_vs_sister_ratio(edges: DataFrame, closure: DataFrame, tips: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per inner non-root node: mean distance and mean divergence to the sister against inside.

    ``pairs`` (tree_id, tip_a, tip_b, div) are the pair statistics. Mean tree distances
    need no tip pairs: inside a clade an edge with k of n tips below it is crossed by
    k·(n−k) pairs, and distances to the sister are sums of mean depths. A side without
    pairs gives null, and so does an inner node with one tip; a clade of mean 0 inside is infinitely far from a
    sister at any distance.
    """
    members = clade_members(closure, tips)
    clade = members.groupBy("tree_id", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").cast("double").alias("depth_sum"))
    below = clade.select("tree_id", F.col("node").alias("desc"), F.col("n").alias("k"))
    lengths = edges.select("tree_id", F.col("node").alias("desc"), F.col("length").alias("len"))
    inside = (
        closure.filter("hops > 0").join(below, ["tree_id", "desc"]).join(lengths, ["tree_id", "desc"])
        .join(clade.select("tree_id", F.col("node").alias("anc"), "n"), ["tree_id", "anc"])
        .groupBy("tree_id", F.col("anc").alias("node")).agg(
            F.try_divide(F.sum(F.col("len") * F.col("k") * (F.col("n") - F.col("k"))), F.first(F.col("n") * (F.col("n") - 1) / 2)).alias("inside_dist")
        )
    )
    inner = edges.filter(F.col("parent").isNotNull()).join(tips, ["tree_id", "node"], "left_anti").select("tree_id", "node", "parent", "length")
    parent = clade.select("tree_id", F.col("node").alias("parent"), F.col("n").alias("np"), F.col("depth_sum").alias("sp"))
    own = F.col("depth_sum") + F.col("n") * F.col("length")
    to_sister = own / F.col("n") + F.try_divide(F.col("sp") - own, F.col("np") - F.col("n"))
    shape = inner.join(clade, ["tree_id", "node"]).join(parent, ["tree_id", "parent"]).select(
        "tree_id", "node", "parent", "n", to_sister.alias("sister_dist")
    ).join(inside, ["tree_id", "node"], "left")

    met = pair_mrca(closure, pairs)
    at_node = met.groupBy("tree_id", "mrca").agg(F.sum("div").alias("s"), F.count("div").alias("c"))
    within = closure.join(at_node.select("tree_id", F.col("mrca").alias("desc"), "s", "c"), ["tree_id", "desc"]).groupBy(
        "tree_id", F.col("anc").alias("node")
    ).agg((F.sum("s") / F.sum("c")).alias("inside_div"))
    sides = met.select("tree_id", "mrca", F.explode(F.array("branch_a", "branch_b")).alias("node"), "div")
    across = sides.groupBy("tree_id", "node").agg(F.avg("div").alias("sister_div"))
    return shape.join(within, ["tree_id", "node"], "left").join(across, ["tree_id", "node"], "left").select(
        "tree_id", "node", F.col("n").alias("n_tips"), "sister_dist", "inside_dist",
        _ratio(F.col("sister_dist"), F.col("inside_dist")).alias("dist_ratio"), "sister_div", "inside_div",
        _ratio(F.col("sister_div"), F.col("inside_div")).alias("div_ratio"),
    )


def sweep_calls(
    ratios: DataFrame, closure: DataFrame, tips: DataFrame, pairs: DataFrame, min_ratio: float = 3.0, min_tips: int = 3
) -> DataFrame:
    """(tree_id, sweep_id, tip): clades far closer inside than to their sister, and whole trees as ``cf``.

    ``pairs`` (strain1, strain2, div) is the full pair table; for ``cf`` the smallest
    divergence leaving a tree is set against the mean one inside it.
    """
    from cladeframe.operators.membership import inside_outside_pairs

    called = ratios.filter((F.col("div_ratio") >= min_ratio) & (F.col("n_tips") >= min_tips)).select("tree_id", "node")
    clades = clade_members(closure, tips).join(called, ["tree_id", "node"], "left_semi").select(
        "tree_id", F.col("node").cast("string").alias("sweep_id"), "tip"
    )
    sides = inside_outside_pairs(pairs, tips.select(F.col("tree_id").alias("cluster"), F.col("node").alias("strain")), ["div"])
    whole = sides.groupBy(F.col("cluster").alias("tree_id")).agg(
        F.min(F.when(F.col("side") == "outside", F.col("div"))).alias("out"),
        F.avg(F.when(F.col("side") == "inside", F.col("div"))).alias("inn"),
    ).filter(_ratio(F.col("out"), F.col("inn")) >= min_ratio)
    frames = tips.join(whole.select("tree_id"), "tree_id", "left_semi").select(
        "tree_id", F.lit("cf").alias("sweep_id"), F.col("node").alias("tip")
    )
    return clades.unionByName(frames)


def monophyly_test(closure: DataFrame, tips: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label: members, tips under their last common ancestor, and whether the two agree.

    ``labels`` (tree_id, node, label). An ancestor is common when it has all members
    below it; the last one has the fewest tips.
    """
    n = labels.groupBy("tree_id", "label").agg(F.count(F.lit(1)).alias("n_members"))
    held = closure.join(labels.select("tree_id", F.col("node").alias("desc"), "label"), ["tree_id", "desc"]).groupBy(
        "tree_id", "label", F.col("anc").alias("node")
    ).agg(F.count(F.lit(1)).alias("held"))
    common = held.join(n, ["tree_id", "label"]).filter(F.col("held") == F.col("n_members"))
    return common.join(clade_sizes(closure, tips), ["tree_id", "node"]).groupBy("tree_id", "label", "n_members").agg(
        F.min("n_tips").alias("clade_size")
    ).withColumn("monophyletic", F.col("clade_size") == F.col("n_members"))


def clade_label_consensus(closure: DataFrame, tips: DataFrame, labels: DataFrame, mixed: str = "mixed") -> DataFrame:
    """(tree_id, node, label): the shared label of all tips under a node, else ``mixed``."""
    tagged = clade_members(closure, tips).select("tree_id", "node", "tip").join(
        labels.select("tree_id", F.col("node").alias("tip"), "label"), ["tree_id", "tip"], "left"
    )
    same = (F.min("label") == F.max("label")) & (F.count("label") == F.count(F.lit(1)))
    return tagged.groupBy("tree_id", "node").agg(F.when(same, F.min("label")).otherwise(mixed).alias("label"))


def prune_tree(edges: DataFrame, closure: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree on the kept tips (tree_id, node); nodes left with one child disappear."""
    under = clade_members(closure, keep)
    forks = under.filter(F.col("branch").isNotNull()).groupBy("tree_id", "node").agg(
        F.count_distinct("branch").alias("n")
    ).filter("n >= 2").select("tree_id", "node")
    nodes = forks.unionByName(keep.select("tree_id", "node")).distinct()
    # the nearest kept ancestor is the parent
    up = closure.filter("hops > 0").join(nodes.select("tree_id", F.col("node").alias("desc")), ["tree_id", "desc"], "left_semi").join(
        forks.select("tree_id", F.col("node").alias("anc")), ["tree_id", "anc"], "left_semi"
    )
    near = up.groupBy("tree_id", F.col("desc").alias("node")).agg(
        F.min_by("anc", "hops").alias("parent"), F.min_by("dist", "hops").alias("length")
    )
    return nodes.join(near, ["tree_id", "node"], "left").join(edges.select("tree_id", "node", "name"), ["tree_id", "node"]).select(
        "tree_id", "node", "parent", "length", "name"
    )


def midpoint_root(edges: DataFrame, closure: DataFrame, tips: DataFrame, new_node: str = "midpoint") -> DataFrame:
    """Edges rerooted at the middle of the longest tip–tip path of each tree.

    At every node the deepest tips of its two deepest branches bound a path; the longest
    of these is the diameter. Only edges between the new root and the old one flip. An old
    root left with one child is suppressed. Node ids are strings.
    """
    deep = clade_members(closure, tips).filter(F.col("branch").isNotNull()).groupBy("tree_id", "node", "branch").agg(
        F.max(F.struct("dist", "tip")).alias("d")
    )
    first = deep.groupBy("tree_id", "node").agg(F.max(F.struct("d", "branch")).alias("a"))
    second = deep.join(first, ["tree_id", "node"]).filter(F.col("branch") != F.col("a.branch")).groupBy("tree_id", "node").agg(
        F.max("d").alias("b")
    )
    span = first.join(second, ["tree_id", "node"]).groupBy("tree_id").agg(
        F.max(F.struct((F.col("a.d.dist") + F.col("b.dist")).alias("total"), F.col("a.d.tip").alias("tip"))).alias("s")
    ).select("tree_id", (F.col("s.total") / 2).alias("half"), F.col("s.tip").alias("desc"))
    # the edge holding the midpoint: the last ancestor-or-self of the deep tip within half of it
    below = closure.join(span, ["tree_id", "desc"]).filter(F.col("dist") <= F.col("half")).groupBy("tree_id").agg(
        F.max_by("anc", "hops").alias("x"), F.max("dist").alias("run"), F.first("half").alias("half")
    )
    spot = cut(below.join(edges.select("tree_id", F.col("node").alias("x"), F.col("parent").alias("px"), F.col("length").alias("lx")), ["tree_id", "x"]))
    at_root = spot.filter(F.col("px").isNull()).select("tree_id")
    move = spot.filter(F.col("px").isNotNull())
    kept_as_is = edges.join(move.select("tree_id"), "tree_id", "left_anti")
    to_x = F.col("half") - F.col("run")
    root_rows = move.select("tree_id", F.lit(new_node).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("string").alias("name"))
    x_rows = move.join(edges.select("tree_id", F.col("node").alias("x"), "name"), ["tree_id", "x"]).select(
        "tree_id", F.col("x").alias("node"), F.lit(new_node).alias("parent"), to_x.alias("length"), "name"
    )
    path = closure.join(move.select("tree_id", F.col("x").alias("desc")), ["tree_id", "desc"], "left_semi").filter("hops > 0").select(
        "tree_id", F.col("anc").alias("node"), "hops", F.col("branch").alias("toward")
    )
    lengths = edges.select("tree_id", F.col("node").alias("toward"), F.col("length").alias("l"))
    flipped = path.join(lengths, ["tree_id", "toward"]).join(move.select("tree_id", "lx", to_x.alias("to_x")), "tree_id").join(
        edges.select("tree_id", "node", "name"), ["tree_id", "node"]
    ).select(
        "tree_id", "node", F.when(F.col("hops") == 1, new_node).otherwise(F.col("toward")).alias("parent"),
        F.when(F.col("hops") == 1, F.col("lx") - F.col("to_x")).otherwise(F.col("l")).cast("double").alias("length"), "name",
    )
    touched = path.select("tree_id", "node").unionByName(move.select("tree_id", F.col("x").alias("node")))
    rest = edges.join(move.select("tree_id"), "tree_id", "left_semi").join(touched, ["tree_id", "node"], "left_anti").select(
        "tree_id", "node", "parent", F.col("length").cast("double").alias("length"), "name"
    )
    out = root_rows.unionByName(x_rows).unionByName(flipped).unionByName(rest)
    # suppress an old root with a single child left
    old = edges.filter(F.col("parent").isNull()).select("tree_id", "node")
    lone = out.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n")).join(
        old, ["tree_id", "node"]
    ).filter("n = 1").join(out.select("tree_id", "node", F.col("parent").alias("gp"), F.col("length").alias("gl")), ["tree_id", "node"]).select(
        "tree_id", F.col("node").alias("parent"), "gp", "gl"
    ).filter(F.col("gp").isNotNull())
    joined = out.join(lone, ["tree_id", "parent"], "left").select(
        "tree_id", "node", F.coalesce("gp", "parent").alias("parent"), (F.col("length") + F.coalesce("gl", F.lit(0.0))).alias("length"), "name"
    ).join(lone.select("tree_id", F.col("parent").alias("node")), ["tree_id", "node"], "left_anti")
    same = kept_as_is.select("tree_id", "node", "parent", F.col("length").cast("double").alias("length"), "name")
    return joined.unionByName(same)


def tip_order(edges: DataFrame, tips: DataFrame, ladderize: bool = False) -> DataFrame:
    """0-based drawing position of every tip: (tree_id, tip, position).

    A tip stands behind all tips of earlier siblings along its path; siblings go by node id, or with ``ladderize`` by
    clade size first.
    """
    seats = seated_nodes(edges, tips, ladderize)
    return seats.join(tips.select("tree_id", "node"), ["tree_id", "node"], "left_semi").select("tree_id", F.col("node").alias("tip"), "position")


def tip_overlap(first: DataFrame, second: DataFrame, on: str = "tip") -> DataFrame:
    """Shared tips and tips only in one of two trees."""
    a = first.select(on).distinct().withColumn("a", F.lit(True))
    b = second.select(on).distinct().withColumn("b", F.lit(True))
    has_a, has_b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return a.join(b, on, "full_outer").agg(
        F.count_if(has_a & has_b).alias("shared"), F.count_if(has_a & ~has_b).alias("only_first"),
        F.count_if(~has_a & has_b).alias("only_second"),
    )


def tangle_crossings(first: DataFrame, second: DataFrame, on: str = "tip") -> DataFrame:
    """Line crossings between two tip orders, that is inversions of one against the other.

    Counted digit by digit: at each binary digit of the second position, tips sharing the
    higher digits are read in the first order and ones before zeros are crossings. That is
    n·log n rows in bucketed scans instead of n² pairs.
    """
    both = first.select(on, F.col("position").alias("y1")).join(second.select(on, F.col("position").alias("y2")), on)
    both = cut(both)
    top = both.agg(F.max("y2")).first()[0] or 0
    levels = max(1, int(top).bit_length())
    spread = both.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).select(
        "digit", "y1",
        F.expr("shiftright(y2, digit + 1)").alias("high"), F.expr("shiftright(y2, digit) & 1").alias("bit"),
    )
    scan = prefix_scan(spread, ["digit", "high"], ["y1"], F.floor(F.col("y1") / 65536), {"ones": ("sum", "bit")})
    return scan.agg(F.coalesce(F.sum(F.when(F.col("bit") == 0, F.col("ones"))), F.lit(0)).alias("crossings"))


def tip_depth_percentile(edges: DataFrame, tips: DataFrame, percent: float = 99.0) -> DataFrame:
    """Interpolated percentile and maximum of tip depth per tree."""
    depth = node_depths(edges).join(tips.select("tree_id", "node"), ["tree_id", "node"], "left_semi")
    return exact_percentiles(depth, ["tree_id"], "depth", {"depth_pct": percent / 100, "max_depth": 1.0})
