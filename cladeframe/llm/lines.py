"""Dropping lines that many documents share, with DataFrame functions only.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines of frequent hashes are
dropped everywhere but in one document, and texts are put together again by position. Only hashes and positions
pass the two shuffles of the counting and the join with frequent hashes; a text is shuffled at most once, to meet
its dropped positions. A line that a third of all documents hold is counted by partial sums, and its rows in the
join are split by the adaptive skew join, whose other side has one row for it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.llm.common import table

#: Space and the controls from tabulator to carriage return: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def drop_shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, text, n_lines, n_dropped) per row of ``docs``, without the lines of frequent keys.

    A key is a line in its normal form, of at least ``least_chars`` code points; it is frequent if at least
    ``least_docs`` documents hold it. Its lines stay only in the document of the largest id among them. Null and empty
    texts are one empty line; a text that loses all lines becomes empty. Rows of equal id are one document to the
    counting and give a row each; rows without an id are together one document, smaller than all others. Empty
    tables give no rows, other columns are ignored. Keys are compared by 128 bits of hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    lines = rows.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # The test of the raw length comes first: most short lines need no normal form.
    keys = lines.filter(F.char_length("line") >= least_chars).select("id", "mark", "pos", normal(F.col("line")).alias("key"))
    hashed = cut(keys.filter(F.char_length("key") >= least_chars).select(
        "id", "mark", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")))
    holders = hashed.groupBy("h", "g").agg(
        F.count_distinct("id").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("unnamed"), F.max("id").alias("keeper"))
    # A table of its own, so that both sides of the join are plain shuffles, which the skew join can split.
    frequent = cut(holders.filter(F.col("n") + F.col("unnamed") >= least_docs).select("h", "g", "keeper"))
    lost = hashed.join(frequent, ["h", "g"]).filter(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
    gone = lost.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))

    def without(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("d.gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    same = F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.mark") == F.col("d.mark"))
    left = F.get(F.transform(F.array(F.split("r.text", "\n")), without), F.lit(0))
    return rows.alias("r").join(gone.alias("d"), same, "left").select(
        F.col("r.id").alias(id_col), F.when(F.col("d.gone").isNull(), F.col("r.text")).otherwise(left).alias("text"),
        (F.char_length("r.text") - F.char_length(F.replace("r.text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("d.gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op12(spark, folder: str) -> DataFrame:
    """Lines before and after, and the digest of what is left of every document."""
    kept = drop_shared_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows from the table itself.
OP12_SQL = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
    translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.key IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
