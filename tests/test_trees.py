"""Depths, positions and last common ancestors against plain walks, on odd shapes."""

import random

import pytest

from cladeframe.functions.lineage import cut
from cladeframe.operators import trees as tr

EDGES = "tree_id string, node string, parent string, length double, name string"


def random_tree(rng, tree_id, n):
    rows = [(tree_id, f"{tree_id}0", None, 0.0, None)]
    for i in range(1, n):
        rows.append((tree_id, f"{tree_id}{i}", f"{tree_id}{rng.randrange(max(0, i - rng.choice([1, 3, n])), i)}", float(rng.randrange(1, 9)), None))
    return rows


def ladder(tree_id, n):
    """A caterpillar: one tip at each of the n inner nodes of a line, and one more at its end."""
    rows = [(tree_id, "i00000", None, 0.0, None)]
    rows += [(tree_id, f"i{i:05d}", f"i{i - 1:05d}", 1.0, None) for i in range(1, n)]
    rows += [(tree_id, f"t{i:05d}", f"i{min(i, n - 1):05d}", 1.0, f"t{i:05d}") for i in range(n + 1)]
    return rows


class Plain:
    def __init__(self, rows):
        self.parent = {(t, v): (t, p) if p else None for t, v, p, _, _ in rows}
        self.length = {(t, v): x for t, v, _, x, _ in rows}
        self.children = {}
        for v, p in self.parent.items():
            self.children.setdefault(p, []).append(v)
        self.tips = [v for v in self.parent if v not in self.children]

    def line(self, v):
        out = [v]
        while self.parent[out[-1]]:
            out.append(self.parent[out[-1]])
        return out

    def depth(self, v):
        return sum(self.length[u] for u in self.line(v)[:-1])

    def count(self, v):
        return 1 if v not in self.children else sum(map(self.count, self.children[v]))

    def order(self, ladderize):
        out = []

        def walk(v):
            if v not in self.children:
                out.append(v)
            for u in sorted(self.children.get(v, []), key=lambda u: (self.count(u), u) if ladderize else u):
                walk(u)

        roots = [v for v, p in self.parent.items() if p is None]
        for root in roots:
            at = len(out)
            walk(root)
            out[at:] = [(v, i) for i, v in enumerate(out[at:])]
        return dict(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = random_tree(rng, "a", 60) + random_tree(rng, "b", 25) + [("lone", "lone", None, 0.0, "lone")]
    return out + [("star", "hub", None, 0.0, None)] + [("star", f"s{i:02d}", "hub", float(i), None) for i in range(30)] + ladder("z", 12)


@pytest.fixture(scope="module")
def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES).repartition(3)


def test_depths_counts_and_positions(edges, rows):
    plain, tips = Plain(rows), tr.tree_tips(edges)
    assert {(r["tree_id"], r["node"]): (r["depth"], r["hops"]) for r in tr.node_depths(edges).collect()} == {v: (plain.depth(v), len(plain.line(v)) - 1) for v in plain.parent}
    assert {(r["tree_id"], r["node"]): r["n_tips"] for r in tr.tip_counts(edges, tips).collect()} == {v: plain.count(v) for v in plain.parent}
    for ladderize in (False, True):
        assert {(r["tree_id"], r["tip"]): r["position"] for r in tr.tip_order(edges, tips, ladderize).collect()} == plain.order(ladderize)


def test_distances_of_all_and_of_given_pairs(spark, edges, rows):
    plain, tips = Plain(rows), tr.tree_tips(edges)

    def want(a, b):
        up = plain.line(b)
        top = next(v for v in plain.line(a) if v in up)
        hops = plain.line(a).index(top) + up.index(top)
        return top[1], plain.depth(a) + plain.depth(b) - 2 * plain.depth(top), hops, plain.depth(top)

    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in tr.tree_distances(edges, tips).collect()}
    assert got == {(a[0], a[1], b[1]): want(a, b) for a in plain.tips for b in plain.tips if a[0] == b[0] and a[1] < b[1]}
    rng = random.Random(1)
    asked = [(a[0], a[1], b[1]) for a, b in (rng.sample([v for v in plain.tips if v[0] == t], 2) for t in "abz" for _ in range(9))] + [("star", "s03", "s03"), ("a", "nobody", "a1")]
    found = tr.tree_distances(edges, tips, spark.createDataFrame(asked, "tree_id string, tip_a string, tip_b string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((t, a, b, *want((t, a), (t, b))) for t, a, b in asked if a != "nobody")


def test_empty_forest(spark):
    none = spark.createDataFrame([], EDGES)
    assert tr.tip_order(none, tr.tree_tips(none)).count() == 0 and tr.tree_distances(none, tr.tree_tips(none)).count() == 0
    assert tr.node_depths(none).count() == 0


def test_long_caterpillar_for_given_pairs(spark):
    n = 20_000
    edges = spark.createDataFrame(ladder("c", n), EDGES).repartition(4)
    tips = tr.tree_tips(edges)
    rng = random.Random(2)
    asked = [tuple(sorted(rng.sample(range(n + 1), 2))) for _ in range(200)] + [(0, n), (n - 1, n)]
    pairs = spark.createDataFrame([("c", f"t{a:05d}", f"t{b:05d}") for a, b in asked], "tree_id string, tip_a string, tip_b string")
    seats = cut(tr.seated_nodes(edges, tips))
    assert seats.count() == 2 * n + 1
    got = {(r["tip_a"], r["tip_b"]): (r["mrca"], r["patristic"]) for r in tr.distances_of(seats, tips, pairs).collect()}
    depth = lambda i: min(i, n - 1)
    assert got == {(f"t{a:05d}", f"t{b:05d}"): (f"i{depth(a):05d}", float(depth(b) - depth(a) + 2)) for a, b in asked}
    order = {r["node"]: r["position"] for r in seats.filter("node LIKE 't%'").collect()}
    # the line goes on before the tip at each of its nodes, except at its end, where both tips stand first
    assert order[f"t{n - 1:05d}"] == 0 and order[f"t{n:05d}"] == 1 and all(order[f"t{i:05d}"] == n - i for i in range(n - 1))
