"""SimHash fingerprints with DataFrame functions only.

Terms are pairs of neighbouring words, weighted by how often they occur. Every occurrence lets the 128 bits
of its hash vote; a bit of the fingerprint is set where most votes are. Two bits share one 64-bit sum, so a
text costs 64 additions per word in generated code and is never gathered: words are counted where they are
read. Permuted block tables find all fingerprints within a Hamming radius.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladeframe.llm.common import bucket_of, quantile_cuts, table, tasks

LANES, PAIR = 32, 0x100000001


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the halves ``high`` and ``low`` of each row's fingerprint.

    ``keys`` must tell the rows apart. A null text counts as empty, and the empty text is a term of its own.
    Where ``rows`` are already placed by some of ``keys`` nothing is shuffled.
    """
    words = rows.select(*keys, F.split(F.coalesce(text, F.lit("")), r"\s+").alias("a"))
    terms = words.select(*keys, F.explode(F.arrays_zip("a", F.slice("a", 2, F.size("a")).alias("b"))).alias("p"))
    hashed = terms.select(*keys, F.xxhash64("p.a", "p.b").alias("x"), F.xxhash64("p.a", "p.b", F.lit(1)).alias("y"))
    votes = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(PAIR))).alias(f"{h}{i}") for h in ("x", "y") for i in range(LANES)]
    counted = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"), *votes)

    def half(h: str) -> Column:
        bits = []
        for i in range(LANES):
            for lane, ones in ((i, F.col(f"{h}{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"{h}{i}", 32))):
                value = 1 << lane
                bits.append(F.when(ones * 2 > F.col("all"), F.lit(value - (1 << 64) if lane == 63 else value).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return counted.select(*keys, half("x").alias("high"), half("y").alias("low"))


def spelled(high: str, low: str) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits."""
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))
    return 1.0 - apart / F.lit(128.0)


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(query, id, apart): all fingerprints (id, high, low) within ``radius`` bits of each query fingerprint.

    Fingerprints that differ in at most ``radius`` bits agree in ``blocks`` - ``radius`` of the equal blocks;
    each choice of so many is a table whose key they are. A pair is kept in the first table in which it
    agrees, so none comes twice. Equal fingerprints search and are found as one: ``query`` and ``id`` are
    their smallest ids, to be joined with the rows by fingerprint, and a fingerprint does not find itself.
    Null fingerprints take no part. Queries are a stated set; each meets only the rows of its own keys.
    """
    width, kept = 128 // blocks, blocks - radius
    if kept < 1 or 128 % blocks or 64 % width:
        raise ValueError("blocks must divide 64 bits evenly and exceed the radius")
    mask = (1 << width) - 1

    def cut_up(df: DataFrame, name: str) -> DataFrame:
        single = df.filter("high is not null and low is not null").groupBy("high", "low").agg(F.min("id").alias(name))
        parts = [F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit(mask)) for h in ("high", "low") for i in range(64 // width)]
        tables = F.array(*[F.struct(F.lit(n).alias("t"), F.xxhash64(*[parts[i] for i in choice]).alias("k")) for n, choice in enumerate(combinations(range(blocks), kept))])
        return single.select(name, F.col("high").alias(f"{name}_high"), F.col("low").alias(f"{name}_low"), F.explode(tables).alias("e")).select("*", "e.t", "e.k").drop("e")

    a, b = cut_up(queries, "query"), cut_up(prints, "id")
    x, y = F.col("query_high").bitwiseXOR(F.col("id_high")), F.col("query_low").bitwiseXOR(F.col("id_low"))
    same = [F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit(mask)) == 0 for h in (x, y) for i in range(64 // width)]
    first = F.coalesce(*[F.when(reduce(lambda p, q: p & q, [same[i] for i in choice]), F.lit(n)) for n, choice in enumerate(combinations(range(blocks), kept))])
    apart = F.bit_count(x) + F.bit_count(y)
    return a.join(b, ["t", "k"]).filter((apart <= radius) & (apart > 0) & (first == F.col("t"))).select("query", "id", apart.alias("apart"))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, n, ghost, doc_id, text, next): every text with that of the next document, doc_id descending.

    Ids are cut into ordered buckets of even size; the first document of a bucket is also sent, as a ghost,
    behind the last of the bucket before it in that order, and the first of all behind the last of all. So one
    shuffle brings each text to its neighbour. Equal ids go by a hash of their text, null ids come last.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    cuts, top = quantile_cuts(rows, F.col("key"), 8 * tasks(docs.sparkSession))
    bucket = bucket_of(F.col("key"), cuts)
    at_cut = F.get(F.array(*[F.lit(c).cast("long") for c in cuts]), bucket) == F.col("key") if cuts else F.lit(False)
    places = F.array_compact(F.array(
        F.struct(bucket.alias("bucket"), F.lit(False).alias("ghost")),
        F.when(at_cut, F.struct((bucket + 1).alias("bucket"), F.lit(True).alias("ghost"))),
        F.when(F.col("key") == F.lit(top).cast("long"), F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("ghost"))),
    ))
    order = W.partitionBy("bucket").orderBy("ghost", F.desc("key"), "h")
    sent = rows.withColumn("e", F.explode(places)).select("e.bucket", "e.ghost", "doc_id", "key", "text", F.xxhash64("text").alias("h"))
    return sent.select("bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("n"), F.lead("text").over(order).alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints of each text and of its edited form, and their likeness.

    Null texts are empty, an only document is its own next, repeated rows give a row each, an empty table
    gives no rows, and other columns are ignored.
    """
    n_chars = F.char_length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    changed = with_next(docs).withColumn("n_chars", n_chars).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    keys = ["bucket", "ghost", "n", "doc_id", "n_chars", "sha"]
    forms = changed.withColumn("sha", F.sha2("edited", 256)).select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("form"), "text"), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text")))).alias("f"))
    prints = fingerprints(forms.select(*keys, "f.form", "f.text"), [*keys, "form"])
    pick = lambda form, half: F.max(F.when(F.col("form") == form, F.col(half)))
    both = prints.groupBy(*keys).agg(*[pick(i, h).alias(f"{h}{i}") for i in (0, 1) for h in ("high", "low")])
    order = W.partitionBy("bucket").orderBy("n")
    after = both.withColumns({"high2": F.lead("high0").over(order), "low2": F.lead("low0").over(order)}).filter(~F.col("ghost"))
    return after.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), spelled("high0", "low0").alias("fingerprint"), spelled("high1", "low1").alias("edited_fingerprint"),
        likeness(("high0", "low0"), ("high1", "low1")).alias("near_edited"), likeness(("high0", "low0"), ("high2", "low2")).alias("near_next"),
    )


def op1(spark, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited(table(spark, folder, "documents"))
