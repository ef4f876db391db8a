"""Driver tables and the study-like tables derived from them.

Each derived table exists twice: as a DataFrame for the operators and as an SQL text
for the reference check. Nothing is filtered by id or shortened.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    """Lazy access to one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- feature hits -------------------------------------------------------
    @cached_property
    def sold(self) -> DataFrame:
        """Line items with their customer and part."""
        li = self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
        orders = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", "p_size")
        return li.join(orders, "l_orderkey").join(part, "l_partkey")

    @cached_property
    def hits(self) -> DataFrame:
        """(sample, feature, type, subtype, method, class, subclass): one row per line item."""
        n, b = F.col("l_linenumber"), F.col("p_brand")
        return self.sold.select(
            F.col("o_custkey").alias("sample"), F.col("p_name").alias("feature"),
            F.when(F.col("l_returnflag") == "R", "AMR").when(F.col("l_returnflag") == "A", "VIRULENCE").otherwise("STRESS").alias("type"),
            F.when((F.col("l_linestatus") == "O") & (n <= 2), "POINT").otherwise(F.col("l_returnflag")).alias("subtype"),
            F.when(n == 7, "PARTIALP").when(n == 6, "POINTX").otherwise("EXACTX").alias("method"),
            F.when(b == "Brand#1", "EFFLUX").when(F.col("p_size") < 10, F.concat("p_type", F.lit("/"), b)).otherwise(F.col("p_type")).alias("class"),
            b.alias("subclass"),
        )

    @cached_property
    def genes(self) -> DataFrame:
        """Present cells (sample, feature) with one feature per part."""
        return self.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(
            self.orders.select("o_orderkey", "o_custkey"), "o_orderkey"
        ).select(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("feature")).distinct()

    @cached_property
    def names(self) -> DataFrame:
        """Present cells (sample, feature) with one feature per part name."""
        return self.sold.select(F.col("o_custkey").alias("sample"), F.col("p_name").alias("feature")).distinct()

    @cached_property
    def nation_genes(self) -> DataFrame:
        """Present cells with a bounded roster of samples (nations) and one feature per part and line number."""
        buyer = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(
            self.customer.select("c_custkey", "c_nationkey"), "c_custkey"
        )
        return self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(buyer, "l_orderkey").select(
            F.col("c_nationkey").alias("sample"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("feature")
        ).distinct()

    @cached_property
    def roster(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("sample"))

    @cached_property
    def groups(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("grp"))

    @cached_property
    def phenotype(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("sample"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("phenotype")
        )

    # --- intervals and contigs ---------------------------------------------
    @cached_property
    def intervals(self) -> DataFrame:
        """(genome, contig, start, end): events of a user as intervals in microseconds."""
        start = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.events.select(
            F.col("user_id").alias("genome"), F.col("event_type").alias("contig"), start.alias("start"),
            (start + (F.round(F.col("value") * 100).cast("long") * 600000)).alias("end"),
        )

    @cached_property
    def contigs(self) -> DataFrame:
        return self.documents.select(
            F.col("source").alias("genome"), F.col("doc_id").alias("contig"), F.length("text").cast("long").alias("length")
        )

    # --- pair alignments ----------------------------------------------------
    @cached_property
    def blocks(self) -> DataFrame:
        """Each document against the next one, line by line; the shorter line ends in gaps."""
        lines = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
        ids = self.documents.select("doc_id")
        left = lines.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi").select(
            F.col("doc_id").alias("pair"), "block_no", F.col("line").alias("a")
        )
        right = lines.join(ids.select((F.col("doc_id") + 1).alias("doc_id")), "doc_id", "left_semi").select(
            (F.col("doc_id") - 1).alias("pair"), "block_no", F.col("line").alias("b")
        )
        a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
        size = F.greatest(F.length(a), F.length(b))
        return left.join(right, ["pair", "block_no"], "full_outer").select(
            F.concat(F.lit("g"), F.col("pair").cast("string")).alias("strain1"),
            F.concat(F.lit("g"), (F.col("pair") + 1).cast("string")).alias("strain2"),
            F.col("block_no").cast("long").alias("block_no"), F.rpad(a, size, "-").alias("seq1"), F.rpad(b, size, "-").alias("seq2"),
        )

    # --- multi-genome blocks ------------------------------------------------
    @cached_property
    def block_rows(self) -> DataFrame:
        """(label, isolate, seq, row_no): turns of a conversation padded with gaps to its longest turn."""
        c = self.conversations
        longest = c.groupBy("conv_id").agg(F.max(F.length("text")).alias("size"))
        return c.join(longest, "conv_id").select(
            F.col("conv_id").alias("label"), F.col("role").alias("isolate"), F.rpad("text", F.col("size"), "-").alias("seq"),
            F.col("turn").alias("row_no"),
        )

    @cached_property
    def block_roster(self) -> DataFrame:
        return self.conversations.select(F.col("role").alias("isolate")).distinct()

    # --- trees --------------------------------------------------------------
    @cached_property
    def tree(self) -> DataFrame:
        """root → region → nation → customer; lengths in whole cents."""
        cents = F.round(F.abs("c_acctbal") * 100).cast("long")
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        none = F.lit(None).cast("string")
        top = self.region.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("t").alias("tree_id"), F.lit("root").alias("node"), none.alias("parent"), F.lit(0).cast("long").alias("length"), none.alias("name")
        )
        regions = self.region.select(F.lit("t").alias("tree_id"), key("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), (F.col("r_regionkey") + 1).cast("long").alias("length"), none.alias("name"))
        nations = self.nation.select(F.lit("t").alias("tree_id"), key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), (F.col("n_nationkey") + 1).cast("long").alias("length"), none.alias("name"))
        tips = self.customer.select(F.lit("t").alias("tree_id"), F.col("c_name").alias("node"), key("n", "c_nationkey").alias("parent"), cents.alias("length"), F.col("c_name").alias("name"))
        return top.unionByName(regions).unionByName(nations).unionByName(tips)

    @cached_property
    def nation_tree(self) -> DataFrame:
        """root → region → nation with nation lengths summed from all customers: a bounded set of tips."""
        weight = self.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
            (F.sum(F.round(F.abs("c_acctbal") * 100).cast("long")) % 9973 + 1).alias("w")
        )
        base = self.tree.filter(~F.col("node").startswith("Customer") & ~F.col("node").startswith("n"))
        tips = self.nation.join(weight, "n_nationkey").select(
            F.lit("t").alias("tree_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("w").cast("long").alias("length"),
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"),
        )
        return base.unionByName(tips)

    @cached_property
    def tree2(self) -> DataFrame:
        """The same customers under root → market segment."""
        none = F.lit(None).cast("string")
        seg = self.customer.select(F.col("c_mktsegment").alias("node")).distinct()
        top = seg.agg(F.count(F.lit(1)).alias("n")).select(F.lit("t").alias("tree_id"), F.lit("root").alias("node"), none.alias("parent"), F.lit(0).cast("long").alias("length"), none.alias("name"))
        mid = seg.select(F.lit("t").alias("tree_id"), "node", F.lit("root").alias("parent"), F.lit(1).cast("long").alias("length"), none.alias("name"))
        tips = self.customer.select(F.lit("t").alias("tree_id"), F.col("c_name").alias("node"), F.col("c_mktsegment").alias("parent"), F.lit(1).cast("long").alias("length"), F.col("c_name").alias("name"))
        return top.unionByName(mid).unionByName(tips)

    # --- pair statistics ----------------------------------------------------
    @cached_property
    def pair_stats(self) -> DataFrame:
        """Statistics of every nation pair trading with each other, from whole-number sums of all line items."""
        buyer = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(
            self.customer.select("c_custkey", "c_nationkey"), "c_custkey"
        )
        seller = self.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        li = self.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity").join(buyer, "l_orderkey").join(seller, "l_suppkey")
        name = lambda c: F.concat(F.lit("n"), c.cast("string"))
        a, b = F.least("c_nationkey", "s_nationkey"), F.greatest("c_nationkey", "s_nationkey")
        sums = li.filter(F.col("c_nationkey") != F.col("s_nationkey")).groupBy(name(a).alias("x"), name(b).alias("y")).agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("s"), F.sum(F.col("l_quantity").cast("long")).alias("q"),
            F.count(F.lit(1)).alias("n"),
        )
        s, q, n = F.col("s"), F.col("q"), F.col("n")
        return sums.select(
            F.least("x", "y").alias("strain1"), F.greatest("x", "y").alias("strain2"),
            (s % 997 / 20000.0).alias("divergence_raw"), (100000 + q % 200000).cast("double").alias("aligned_raw"),
            (q % 11 / 100.0).alias("mu_div"), (s % 13 / 50.0).alias("mnb_div"), (s % 101).cast("double").alias("sim_fr"),
            ((q + n) % 50).cast("double").alias("hmm_fr"), (s % 17 / 400.0).alias("hmm_mu"), (q % 19 / 100.0).alias("hmm_mnb"),
        )


# --- the same tables for the SQL check -------------------------------------
SOLD = """sold AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, o_custkey, p_name, p_type, p_brand, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
HITS = SOLD + """, hits AS (
  SELECT o_custkey AS sample, p_name AS feature,
    CASE l_returnflag WHEN 'R' THEN 'AMR' WHEN 'A' THEN 'VIRULENCE' ELSE 'STRESS' END AS type,
    CASE WHEN l_linestatus = 'O' AND l_linenumber <= 2 THEN 'POINT' ELSE l_returnflag END AS subtype,
    CASE l_linenumber WHEN 7 THEN 'PARTIALP' WHEN 6 THEN 'POINTX' ELSE 'EXACTX' END AS method,
    CASE WHEN p_brand = 'Brand#1' THEN 'EFFLUX' WHEN p_size < 10 THEN p_type || '/' || p_brand ELSE p_type END AS class,
    p_brand AS subclass FROM sold),
chits AS (SELECT *, CASE WHEN subtype = 'POINT' OR method LIKE 'POINT%' THEN 'POINT' ELSE type END AS feature_class
  FROM hits WHERE method <> 'PARTIALP')"""
GENES = "genes AS (SELECT DISTINCT o_custkey AS sample, l_partkey AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
NAMES = SOLD + ", names AS (SELECT DISTINCT o_custkey AS sample, p_name AS feature FROM sold)"
NATION_GENES = """ngenes AS (SELECT DISTINCT c_nationkey AS sample, l_partkey * 10 + l_linenumber AS feature
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
GROUPS = "grps AS (SELECT c_custkey AS sample, c_mktsegment AS grp FROM customer)"
INTERVALS = """iv AS (SELECT user_id AS genome, event_type AS contig, epoch_us(ts) AS s,
  epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS e FROM events)"""
LINES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents),
blk0 AS (SELECT coalesce(a.doc_id, b.doc_id - 1) AS pair, coalesce(a.block_no, b.block_no) AS block_no, coalesce(a.line, '') AS a, coalesce(b.line, '') AS b
  FROM (SELECT * FROM ln WHERE doc_id + 1 IN (SELECT doc_id FROM documents)) a
  FULL JOIN (SELECT * FROM ln WHERE doc_id - 1 IN (SELECT doc_id FROM documents)) b ON a.doc_id = b.doc_id - 1 AND a.block_no = b.block_no),
blk AS (SELECT 'g' || pair AS strain1, 'g' || (pair + 1) AS strain2, block_no,
  a || repeat('-', greatest(length(a), length(b)) - length(a)) AS seq1, b || repeat('-', greatest(length(a), length(b)) - length(b)) AS seq2 FROM blk0)"""
BASES = LINES + """,
ch AS (SELECT strain1, strain2, block_no, unnest(string_split(seq1, '')) AS c1, unnest(string_split(seq2, '')) AS c2,
  generate_subscripts(string_split(seq1, ''), 1) - 1 AS i FROM blk WHERE length(seq1) > 0),
gp AS (SELECT *, coalesce(c1 = '-' AND (lag(c1) OVER w = '-' OR lead(c1) OVER w = '-'), false)
  OR coalesce(c2 = '-' AND (lag(c2) OVER w = '-' OR lead(c2) OVER w = '-'), false) AS gap
  FROM ch WINDOW w AS (PARTITION BY strain1, strain2, block_no ORDER BY i)),
kept AS (SELECT strain1, strain2, block_no, i, c1, c2, i - row_number() OVER (PARTITION BY strain1, strain2, block_no ORDER BY i) AS isl
  FROM gp WHERE NOT gap),
parts AS (SELECT strain1, strain2, block_no, isl, min(i) AS start, count(*) AS len, count(*) FILTER (WHERE c1 <> c2) AS mm,
  FROM kept GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY strain1, strain2 ORDER BY block_no, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM parts),
tot AS (SELECT strain1, strain2, count(*) AS n_parts, sum(len) + count(*) - 1 AS aligned, sum(mm) + count(*) - 1 AS mism FROM parts GROUP BY ALL),
mpos AS (SELECT k.strain1, k.strain2, off + i - start AS pos FROM kept k JOIN placed USING (strain1, strain2, block_no, isl) WHERE c1 <> c2
  UNION ALL SELECT strain1, strain2, off - 1 FROM placed WHERE off > 0)"""
WINDOWS = BASES + """,
grid AS (SELECT strain1, strain2, aligned, greatest(CAST(ceil((aligned - 1000) / 50.0) AS BIGINT), 0) AS last_no FROM tot),
win AS (SELECT strain1, strain2, window_no, CASE WHEN window_no = 0 THEN 0 ELSE 500 + 50 * (window_no - 1) END AS start,
   CASE WHEN window_no = last_no THEN aligned - CASE WHEN window_no = 0 THEN 0 ELSE 500 + 50 * (window_no - 1) END ELSE 500 END AS length
  FROM (SELECT *, unnest(generate_series(0, last_no)) AS window_no FROM grid)),
cumb AS (SELECT strain1, strain2, pos // 50 AS bin, count(*) AS n FROM mpos GROUP BY ALL),
wcnt AS (SELECT win.strain1, win.strain2, window_no, coalesce(sum(n), 0) AS mism FROM win LEFT JOIN cumb
  ON win.strain1 = cumb.strain1 AND win.strain2 = cumb.strain2 AND bin * 50 >= start AND bin * 50 < start + length GROUP BY ALL)"""
RUNS = BASES + """,
mloc AS (SELECT k.strain1, k.strain2, block_no, isl, i - start AS pos, len FROM kept k JOIN parts USING (strain1, strain2, block_no, isl) WHERE c1 <> c2
  UNION ALL SELECT strain1, strain2, block_no, isl, -1, len FROM parts),
runs AS (SELECT strain1, strain2, coalesce(lead(pos) OVER (PARTITION BY strain1, strain2, block_no, isl ORDER BY pos), len) - pos - 1 AS run FROM mloc)"""
TREE = """edges AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS name
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey + 1, NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 1, NULL FROM nation
  UNION ALL SELECT c_name, 'n' || c_nationkey, CAST(round(abs(c_acctbal) * 100) AS BIGINT), c_name FROM customer)"""
NATION_TREE = """edges AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS name
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey + 1, NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, w, 'n' || n_nationkey FROM nation JOIN
    (SELECT c_nationkey, sum(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) % 9973 + 1 AS w FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""
CLOSURE = """, closure AS (
  WITH RECURSIVE up(anc, cur, node, dist, hops, branch) AS (
    SELECT node, node, node, CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR) FROM edges
    UNION ALL SELECT e.parent, e.parent, u.node, u.dist + e.length, u.hops + 1, u.anc FROM up u JOIN edges e ON u.anc = e.node WHERE e.parent IS NOT NULL)
  SELECT anc, node AS descn, dist, hops, branch FROM up),
tips AS (SELECT node FROM edges WHERE name IS NOT NULL),
sizes AS (SELECT anc AS node, count(*) AS n FROM closure WHERE descn IN (SELECT node FROM tips) GROUP BY 1)"""
PAIR_STATS = """ps AS (SELECT least(x, y) AS strain1, greatest(x, y) AS strain2, s % 997 / 20000.0 AS divergence_raw, 100000.0 + q % 200000 AS aligned_raw,
    q % 11 / 100.0 AS mu_div, s % 13 / 50.0 AS mnb_div, CAST(s % 101 AS DOUBLE) AS sim_fr, CAST((q + n) % 50 AS DOUBLE) AS hmm_fr, s % 17 / 400.0 AS hmm_mu, q % 19 / 100.0 AS hmm_mnb
  FROM (SELECT 'n' || least(c_nationkey, s_nationkey) AS x, 'n' || greatest(c_nationkey, s_nationkey) AS y,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))"""
KEEP_ALL = PAIR_STATS + """,
kall AS (SELECT strain1, strain2,
  CASE WHEN divergence_raw < 1500 / aligned_raw THEN 0.0
       WHEN (CASE WHEN hmm_fr = 0 THEN sim_fr > 0 ELSE sim_fr / hmm_fr >= 2 END) AND clear THEN hmm_fr ELSE sim_fr END AS total_r,
  CASE WHEN divergence_raw < 1500 / aligned_raw THEN 1e-5
       WHEN capped AND clear THEN hmm_mu
       WHEN hmm_fr <> 0 AND sim_fr / hmm_fr < 2 AND clear THEN mu_div ELSE divergence_raw END AS div,
  CASE WHEN capped THEN 'C' ELSE 'NC' END AS type
 FROM (SELECT *, CASE WHEN hmm_fr = 0 THEN sim_fr > 0 ELSE sim_fr / hmm_fr > 2 END AS capped,
   (CASE WHEN mu_div = 0 THEN mnb_div > 0 ELSE mnb_div / mu_div > 2.5 END) OR divergence_raw < 1500 / aligned_raw AS clear FROM ps))"""
