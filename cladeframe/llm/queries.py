"""Queries of the text operators: name → (spark, folder) → DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import dedup, forest, lines, manifest, mixing, packing, quality, reversed_search, secrets, simhash, tokens, toxicity, warc


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1,
        "op2_warc": warc.op2,
        "op3_mixing": mixing.op3,
        "op4_toxicity": toxicity.op4,
        "op5_packing": packing.op5,
        "op6_quality": quality.op6,
        "op7_token_counts": tokens.op7,
        "op8_near_dedup": dedup.op8,
        "op9_secrets": secrets.op9,
        "op10_nearest": forest.op10,
        "op11_manifest": manifest.op11,
        "op12_line_dedup": lines.op12,
        "op13_reversed_search": reversed_search.op13,
    }


def checks() -> dict[str, str]:
    return {"op2_warc": warc.OP2_SQL, "op11_manifest": manifest.OP11_SQL, "op12_line_dedup": lines.OP12_SQL, "op13_reversed_search": reversed_search.OP13_SQL}
