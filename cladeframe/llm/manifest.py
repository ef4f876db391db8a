"""Merkle manifest of a table: digests of rows, roots of groups, one root, and proofs.

A level is built by a sibling-shift self-join: every node equijoins the nodes at its computed sibling indices (index
XOR 1 in binary trees, slot offsets otherwise), so it knows what stands before and after it in its run, and the rows
of slot zero emit the parents. All groups climb together, a hot group like the others, for indices are part of the
key; a level is written to the shared folder, so a lost executor costs one level. Proofs are read off in blocks of a
fixed number of levels: a block of at most 256 nodes holds its own levels as short arrays and asks the block above
for the rest, so paths are made where they are used and never shuffled. Texts are read once and stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.functions.scan import sorted_index
from cladeframe.llm.common import table, tasks

BLOCK, ROWS_A_TASK = 256, 4096
PATH = "array<struct<before string, after string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def climb(leaves: DataFrame, arity: int = 2) -> list[DataFrame]:
    """Levels of the trees over ``leaves`` (tree, i, last, hash), lowest first.

    ``i`` runs from 0 to ``last`` without gaps in each tree; more columns of the leaves stay in the lowest level. Rows
    of a level are (tree, i, last, hash, before, after): the joined digests of the nodes before and after a node in
    its run, both null for the root of a tree, which climbs no further.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    found = leaves.agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("rows")).first()
    last, rows, level, levels = found["last"] or 0, found["rows"], leaves, []
    slot = (F.col("i") % arity).cast("long")
    while True:
        joined = level
        for shift in range(1, arity):
            at = F.col("i").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("i") - slot + (slot + shift) % arity
            other = level.select("tree", F.col("i").alias("__at"), F.col("hash").alias(f"__s{shift}"))
            joined = joined.withColumn("__at", at).join(other, ["tree", "__at"], "left").drop("__at")

        def side(wrapped: bool) -> Column:
            parts = [F.when((slot + s >= arity) == F.lit(wrapped), F.col(f"__s{s}")) for s in range(1, arity)]
            return F.when(F.col("last") > 0, F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))

        few = max(1, min(tasks(leaves.sparkSession), rows // ROWS_A_TASK))
        levels.append(cut(joined.select(*level.columns, side(True).alias("before"), side(False).alias("after")).coalesce(few)))
        if not last:
            return levels
        level = levels[-1].filter((slot == 0) & (F.col("last") > 0)).select(
            "tree", F.expr(f"i div {arity}").alias("i"), F.expr(f"last div {arity}").alias("last"), F.sha2(F.concat("hash", "after"), 256).alias("hash"))
        last, rows = last // arity, rows // arity


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, height, hash): the topmost node of every tree."""
    tops = [level.filter("last = 0").select("tree", F.lit(n).alias("height"), "hash") for n, level in enumerate(levels)]
    return cut(reduce(DataFrame.unionByName, tops).coalesce(tasks(levels[0].sparkSession)))


def along_paths(levels: list[DataFrame], above: DataFrame, arity: int, finish) -> DataFrame:
    """``finish(leaf, path)`` of every leaf, as columns; a path lists (before, after) from the leaf upwards.

    ``above`` (tree, height, path) is what follows the root of each tree. ``finish`` gets the leaf as a struct with the
    columns of the lowest level and returns a struct.
    """
    span = 1
    while arity ** (span + 1) <= BLOCK:
        span += 1
    above = above.withColumn("round", F.expr(f"height div {span}"))
    upper = None
    for turn in reversed(range((len(levels) - 1) // span + 1)):
        own = levels[turn * span:(turn + 1) * span]
        lowest = own[0].columns if turn == 0 else ["tree", "i"]
        rows = []
        for n, level in enumerate(own):
            width = arity ** (span - n)
            leaf = F.struct(*lowest) if n == 0 else F.lit(None)
            step = F.struct((F.col("i") % width).alias("at"), "before", "after")
            rows.append(level.select("tree", F.expr(f"i div {width}").alias("block"), F.lit(n).alias("n"), step.alias("step"), leaf.alias("leaf")))
        rows = reduce(lambda a, b: a.unionByName(b), rows)
        blocks = rows.groupBy("tree", "block").agg(
            F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.struct(F.col("step.at").alias("at"), "leaf")))).alias("leaves"),
            *[F.array_sort(F.collect_list(F.when(F.col("n") == n, F.col("step")))).alias(f"level{n}") for n in range(len(own))])
        # What follows a block: the path of the node above it or, in the topmost block of a tree, what follows the tree.
        ends = above.filter(F.col("round") == turn).select("tree", F.lit(0).cast("long").alias("block"), "path")
        after = ends if upper is None else ends.unionByName(upper.select("tree", F.col("i").alias("block"), "path"))
        met = blocks.join(after, ["tree", "block"], "left")

        def path_of(at: Column) -> Column:
            near = F.array(*[F.get(f"level{n}", F.floor(at / arity**n).cast("int")) for n in range(len(own))])
            steps = F.transform(F.filter(near, lambda s: s["before"].isNotNull()), lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
            return F.concat(steps, F.coalesce("path", F.array().cast(PATH)))

        done = finish if turn == 0 else (lambda leaf, path: F.struct(leaf["tree"].alias("tree"), leaf["i"].alias("i"), path.alias("path")))
        out = F.transform("leaves", lambda x: done(x["leaf"], path_of(x["at"])))
        upper = met.select(F.explode(out).alias("o")).select("o.*")
        if turn:
            upper = cut(upper)
    return upper


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of the joined siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass
class Manifest:
    """Levels of the groups' trees and of the tree over their roots; ``groups`` has (group, tree, height, subroot)."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    groups: DataFrame
    root: str | None
    arity: int

    def checked(self, shown: str = "hash") -> DataFrame:
        """Every leaf's columns but its place, with subroot, root, proof_sha256, folded_root and verified.

        ``shown`` names the column with the digest that is put to the proof.
        """
        none = self.groups.sparkSession.createDataFrame([(0, len(self.upper) - 1, [])], f"tree long, height int, path {PATH}")
        ends = along_paths(self.upper, none, self.arity, lambda leaf, path: F.struct(leaf["i"].alias("tree"), path.alias("path")))
        above = cut(self.groups.select("tree", "height").join(ends, "tree"))
        kept = [c for c in self.levels[0].columns if c not in ("i", "last", "before", "after")]

        def finish(leaf: Column, path: Column) -> Column:
            return F.struct(*[leaf[c].alias(c) for c in kept], proof_digest(path).alias("proof_sha256"), fold(leaf[shown], path).alias("folded_root"))

        proved = along_paths(self.levels, above, self.arity, finish)
        root = F.lit(self.root).cast("string")
        return proved.join(self.groups.select("tree", "subroot"), "tree").select(
            *[c for c in kept if c != "tree"], "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def build(leaves: DataFrame, arity: int = 2) -> Manifest:
    """Manifest of ``leaves`` (group, place, hash, and columns to carry).

    Leaves of a group ascend by place, nulls first, and equal places by their digest; groups ascend likewise. Every
    ``arity`` consecutive nodes become one, a last shorter run too, even a single node, until one is left. An empty
    table has no rows and no root.
    """
    placed = sorted_index(leaves.withColumnRenamed("group", "__group"), ["__group", "place", "hash"], "n")
    placed = cut(placed)
    sizes = placed.groupBy("__group").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = cut(sorted_index(sizes, ["__group"], "tree").withColumn("tree", F.col("tree") - 1))
    carried = [c for c in leaves.columns if c not in ("group", "place", "hash")]
    seated = placed.alias("p").join(groups.alias("g"), F.col("p.__group").eqNullSafe(F.col("g.__group"))).select(
        "g.tree", (F.col("p.n") - F.col("g.first")).alias("i"), (F.col("g.rows") - 1).alias("last"), "p.hash", *[F.col(f"p.{c}") for c in carried])
    levels = climb(cut(seated), arity)
    tops = roots_of(levels)
    upper = climb(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(tops.count() - 1).cast("long").alias("last"), "hash"), arity)
    top = upper[-1].first()
    named = groups.select("tree", F.col("__group").alias("group")).join(tops.select("tree", "height", F.col("hash").alias("subroot")), "tree")
    return Manifest(levels, upper, cut(named), top and top["hash"], arity)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by lang and doc_id, with ``shown``, the digest of the row as it was tampered with.

    Null fields count as ``-``; other columns are ignored; repeated rows are a leaf each.
    """
    row = lambda n_chars: digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = row(F.col("n_chars"))
    return docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("place"), leaf.alias("hash"), "doc_id",
        F.when(struck & F.col("n_chars").isNotNull(), row(F.try_add(F.col("n_chars"), F.lit(1)))).alias("struck"))


def op11(spark, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof says of the row as tampered with."""
    leaves = cut(document_leaves(table(spark, folder, "documents"))).withColumn("shown", F.coalesce("struck", "hash")).drop("struck")
    found = build(leaves).checked("shown")
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


def _walk(name: str, start: str, nodes: str) -> str:
    """Recursion of the check: a digest climbs past its siblings in ``nodes``."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT w.* REPLACE (w.level + 1 AS level, w.i // 2 AS i, w.last // 2 AS last, w.proof || coalesce(s.hash, '') AS proof,
    sha256(CASE WHEN w.i % 2 = 1 THEN s.hash || w.acc ELSE w.acc || coalesce(s.hash, '') END) AS acc)
  FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.last > 0
)"""


_FIELD = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "{0}::VARCHAR", "text")) + ")"
_RISE = "sha256(string_agg(hash, '' ORDER BY i))"
#: The same rows from the table itself: trees climb in one recursion, digests past their siblings in two. The checksum is made bit by bit.
OP11_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], repeat([0::BIGINT], 8)),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), leaves AS (
  SELECT doc_id, lang, {_LEAF.format('n_chars')} AS hash, {_LEAF.format('(n_chars + 1)')} AS struck,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, b: xor(t[((xor(c, b)) & 255) + 1], c // 256))) % 7 = 0 AND n_chars IS NOT NULL AS hit
  FROM documents, bits
), seated AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS i,
    count(*) OVER (PARTITION BY lang) - 1 AS last FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, i, last, hash FROM seated
  UNION ALL
  SELECT tree, level + 1, i // 2, any_value(last) // 2, {_RISE} FROM nodes WHERE last > 0 GROUP BY tree, level, i // 2
), tops AS (
  SELECT tree AS seat, hash AS subroot, count(*) OVER () - 1 AS span FROM nodes WHERE last = 0
), high AS (
  SELECT 0 AS tree, 0 AS level, seat AS i, span AS last, subroot AS hash FROM tops
  UNION ALL
  SELECT tree, level + 1, i // 2, any_value(last) // 2, {_RISE} FROM high WHERE last > 0 GROUP BY tree, level, i // 2
), {_walk('inner_walk', "SELECT doc_id, hash AS leaf, tree AS seat, tree, 0 AS level, i, last, CASE WHEN hit THEN struck ELSE hash END AS acc, '' AS proof FROM seated", 'nodes')},
{_walk('outer_walk', "SELECT doc_id, leaf, seat, 0 AS tree, 0 AS level, seat AS i, span AS last, acc, proof FROM inner_walk JOIN tops USING (seat) WHERE last = 0", 'high')}
SELECT doc_id, leaf, subroot, (SELECT hash FROM high WHERE last = 0) AS root, sha256(proof) AS proof_sha256, acc AS folded_root,
  acc = (SELECT hash FROM high WHERE last = 0) AS verified
FROM outer_walk JOIN tops USING (seat) WHERE last = 0
"""
