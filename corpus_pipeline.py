"""From raw documents to packed training sequences, one operator per stage.

Each stage is written as Parquet and read again before the next, so a lost executor costs at most its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeframe.functions.lineage import cut
from cladeframe.llm import dedup, mixing, packing, secrets, toxicity
from cladeframe.llm.common import table


def _packed(docs: DataFrame, *beside) -> DataFrame:
    """Every row as one struct, so that no stage meets the names of other columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *beside)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half.

    Null and empty texts score as the model's intercept; repeated rows stand or fall together; rows without doc_id are
    scored and have no label; an empty table gives no rows; other columns may have any names.
    """
    held = toxicity.fold(5, 0)
    train = toxicity.label_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "toxic", held, toxicity.SAMPLE)
    return toxicity.ToxicityModel.fit(train).score(_packed(docs, "text")).filter("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; see ``dedup.keep_first`` for repeated and missing ids."""
    return dedup.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text, null texts stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: the whole part for sure, a remainder by a hash of the row.

    Documents without words are no part of any source's share and stay once. Repeated rows are taken alike; rows
    without doc_id or source take part; an empty table gives no rows; other columns may have any names.
    """
    taken = mixing.mix(docs.select("doc_id", "source", "text")).taken().select("doc_id", "h", "size", "taken")
    times = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.col("taken") / F.col("size"))
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = taken.select("doc_id", "h", (F.floor(times) + F.when(draw < times - F.floor(times), 1).otherwise(0)).cast("int").alias("copies")).groupBy(
        "doc_id", "h").agg(F.max("copies").alias("copies"))
    on = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.h").eqNullSafe(F.col("c.h"))
    rows = _packed(docs, "doc_id", F.xxhash64("text").alias("h")).alias("d").join(copies.alias("c"), on)
    return rows.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 ids; a null text is empty, an empty table has no pieces."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, signatures and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return cut(STAGES[-1][1](spark, docs, sf_dir))
