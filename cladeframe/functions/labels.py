"""Identifier and label normalisation as plain Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# File suffixes stripped from sample and tip names.
SEQUENCE_SUFFIXES = ("fna", "fasta", "fa", "fas", "gbk", "gff")


def accession_short_id(col: Column, prefixes: Sequence[str] = ("GCA", "GCF")) -> Column:
    """``/x/GCA_009397805.1_asm.fna`` → ``9397805``: path, prefix, version and leading zeros go."""
    name = F.regexp_replace(F.trim(col), r"^.*/", "")
    name = F.regexp_replace(name, r"\.(fna|fa|fasta|gff)$", "")
    name = F.regexp_replace(name, rf"^(?:{'|'.join(prefixes)})_0*", "")
    return F.regexp_replace(name, r"\.[0-9]+.*$", "")


def clean_sample_id(col: Column, suffixes: Sequence[str] = SEQUENCE_SUFFIXES) -> Column:
    """Trim blanks and quotes, then one sequence-file suffix in any case."""
    bare = F.regexp_replace(F.trim(col), r"^['\"]+|['\"]+$", "")
    return F.regexp_replace(bare, rf"(?i)\.({'|'.join(suffixes)})$", "")


def aligner_safe_name(col: Column, mode: str = "replace", punctuation: str = ".-:;,()'[]|/ ") -> Column:
    """``replace`` turns punctuation into ``_``; ``delete`` drops ``.`` and ``-``."""
    if mode == "replace":
        return F.translate(col, punctuation, "_" * len(punctuation))
    return F.translate(col, ".-", "")


def sampling_year(col: Column) -> Column:
    """Leading four digits of a date text as an integer, else null."""
    return F.when(col.rlike(r"^[0-9]{4}"), F.substring(col, 1, 4).cast("int"))


def feature_class(type_: Column, subtype: Column, method: Column) -> Column:
    """``POINT`` for point mutations (by subtype or method), else the element type."""
    point = (F.upper(F.coalesce(subtype, F.lit(""))) == "POINT") | F.upper(
        F.coalesce(method, F.lit(""))
    ).startswith("POINT")
    return F.when(point, F.lit("POINT")).otherwise(type_)


def is_partial(method: Column) -> Column:
    """Truncated hits, by method name."""
    # Method names that mark an incomplete hit.
    names = ("PARTIALP", "PARTIALX", "PARTIAL_CONTIG_ENDP", "PARTIAL_CONTIG_ENDX", "INTERNAL_STOP")
    return F.upper(F.coalesce(method, F.lit(""))).isin(*names)


def st_label(st: Column, alleles: Column, main: str = "32") -> Column:
    """Sequence-type label; alleles not of the form ``name(number)`` make a novel type partial."""
    exact = r"^\w+\(\d+\)$"
    odd = F.filter(alleles, lambda x: ~x.rlike(exact))
    return (
        F.when(st.isNull(), F.lit("no MLST"))
        .when(st == main, F.lit(f"ST{main}"))
        .when((st == "-") & (F.size(odd) == 0), F.lit("novel ST"))
        .when(st == "-", F.concat(F.lit("novel/partial ("), F.array_join(odd, ","), F.lit(")")))
        .otherwise(F.concat(F.lit("ST"), st))
    )


def gene_label(gene: Column, names: Column, products: Column, max_len: int = 38) -> Column:
    """Readable gene label: real name, else a non-generic id, else trimmed product, else id."""
    name = F.trim(F.split(F.coalesce(names, F.lit("")), ";")[0])
    product = F.trim(F.split(F.coalesce(products, F.lit("")), ";")[0])
    cutoff = F.when(F.length(product) <= max_len, product).otherwise(
        F.concat(F.substring(product, 1, max_len - 1), F.lit("…"))
    )
    # Product texts that say nothing about the gene.
    empty_products = ("", "nan", "hypothetical protein", "not_found_in_panaroo_csv")
    return (
        F.when((name != "") & ~F.lower(name).isin("nan", "none"), name)
        .when((gene != "") & ~gene.startswith("group_"), gene)
        .when(~F.lower(product).isin(*empty_products), F.concat(cutoff, F.lit(" ["), gene, F.lit("]")))
        .otherwise(gene)
    )
