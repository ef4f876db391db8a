"""Scans of text, table, tree and XML inputs. Each takes a folder or glob of many files."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cladeframe.functions.labels import clean_sample_id
from cladeframe.functions.scan import row_index


def _text(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    return spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start")
    )


def _base_name(path: Column, suffix: str = "") -> Column:
    name = F.url_decode(F.regexp_replace(path, r"^.*/", ""))
    return F.regexp_replace(name, rf"{suffix}$", "") if suffix else name


def _group_or_name(path: Column, group: str, suffix: str) -> Column:
    """Value of a ``group=value`` folder where the files were written partitioned, else the file name."""
    folder = F.url_decode(F.regexp_extract(path, rf"/{group}=([^/]*)/", 1))
    return F.when(folder != "", folder).otherwise(_base_name(path, suffix))


def _number(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0-based record number inside a file; file splits are the buckets of the scan."""
    ordered = df.withColumn("__id", F.monotonically_increasing_id())
    out = row_index(ordered, list(keys), ["block_start", "__id"], F.col("block_start"), name)
    return out.withColumn(name, F.col(name) - 1).drop("__id", "block_start")


def scan_fasta(spark: SparkSession, path: str, suffix: str = r"\.(fna|fasta|fa)", number: bool = False) -> DataFrame:
    """(genome, contig, seq, length[, contig_no]); the contig id is the first token after ``>``."""
    raw = _text(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_extract("value", r"^([^\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    out = raw.select(
        _group_or_name(F.col("file"), "genome", suffix).alias("genome"), head.alias("contig"), body.alias("seq"), "block_start"
    ).filter(F.col("contig") != "").withColumn("length", F.length("seq").cast("long"))
    return _number(out, ["genome"], "contig_no") if number else out.drop("block_start")


def parse_pair_blocks(blocks: DataFrame) -> DataFrame:
    """(file, value) MAF paragraphs → rows with strain1, strain2, seq1, seq2 for blocks of exactly two."""
    lines = F.split("value", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"mult=2(\s|$)")), True).cast("int")
    last = lambda i: F.element_at(F.split(F.trim(F.try_element_at(lines, at + i)), r"\s+"), -1)
    pair = F.split(_group_or_name(F.col("file"), "pair", r"\.maf"), "_@_")
    return blocks.filter(at > 0).select(
        *[c for c in blocks.columns if c != "value"], pair[0].alias("strain1"), pair[1].alias("strain2"),
        last(1).alias("seq1"), last(2).alias("seq2"),
    )


def scan_pair_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(strain1, strain2, block_no, seq1, seq2) from files named ``A_@_B.maf`` or folders ``pair=A_@_B``."""
    parsed = parse_pair_blocks(_text(spark, path, "\n\n"))
    return _number(parsed, ["strain1", "strain2"], "block_no").select("strain1", "strain2", "block_no", "seq1", "seq2")


def scan_multi_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(label, isolate, contig, start, length, strand, seq, row_no); on ``-`` the start moves to the far end.

    A last block without a blank line after it counts like the others.
    """
    raw = _text(spark, path, "\n\n").filter(F.col("value").rlike(r"(^|\n)a "))
    rows = raw.select(
        F.regexp_extract("value", r"label=(\S+)", 1).alias("label"), F.posexplode(F.split("value", "\n")).alias("row_no", "line")
    ).filter(F.col("line").rlike(r"^s\s"))
    f = F.split("line", r"\s+")
    start, size = f[2].cast("long"), f[3].cast("long")
    return rows.select(
        "label", F.substring_index(f[1], ".", 1).alias("isolate"), F.regexp_replace(f[1], r"^[^.]*\.", "").alias("contig"),
        F.when(f[4] == "+", start).otherwise(start + size).alias("start"), size.alias("length"), f[4].alias("strand"),
        f[6].alias("seq"), "row_no",
    )


def scan_paf_hits(
    spark: SparkSession, path: str, min_aln: int = 500, min_ident: float = 0.9, keep_all: bool = False, named: bool = False
) -> DataFrame:
    """Alignment hits (genome, contig, qstart, qend, tlen, tstart, tend) of ragged tab lines.

    With ``keep_all`` weak hits stay, marked by ``passed``: the reference length is taken
    from all of them. The genome is the file's, or with ``named`` a field before each line's own,
    so that many genomes may share a file.
    """
    lead = F.split("value", "\t", 2)
    raw = _text(spark, path)
    lines = raw.select(lead[0].alias("genome"), lead[1].alias("value")) if named else raw.select(
        _group_or_name(F.col("file"), "genome", r"\.paf").alias("genome"), "value"
    )
    f = F.split("value", "\t")
    rows = lines.filter(F.size(f) >= 12).select(
        "genome", f[0].alias("contig"),
        f[2].cast("long").alias("qstart"), f[3].cast("long").alias("qend"), f[6].cast("long").alias("tlen"),
        f[7].cast("long").alias("tstart"), f[8].cast("long").alias("tend"),
        f[9].cast("long").alias("matches"), f[10].cast("long").alias("alnlen"),
    )
    good = (F.col("alnlen") >= min_aln) & (F.try_divide("matches", "alnlen") >= min_ident)
    marked = rows.withColumn("passed", F.coalesce(good, F.lit(False))).drop("matches", "alnlen")
    return marked if keep_all else marked.filter("passed").drop("passed")


def _with_header(rows: DataFrame, is_header: Callable[[Column], Column]) -> DataFrame:
    """(file, header, value): the lines below the first line of their file, which must satisfy ``is_header``.

    Another first line raises with the name of the file; an empty file gives no rows. Lines of one file have
    rising ids from its first byte on, so the header is the line of the smallest id in the block at byte 0.
    """
    plain = F.rtrim(F.regexp_replace("value", "^\ufeff", ""), F.lit("\r"))
    lines = rows.select("file", "block_start", plain.alias("value")).withColumn("__id", F.monotonically_increasing_id()).filter(F.col("value") != "")
    head = lines.filter(F.col("block_start") == 0).groupBy("file").agg(F.min_by("value", "__id").alias("header"))
    wrong = F.raise_error(F.concat(F.lit("unknown header: "), F.col("file")))
    head = head.select("file", F.when(is_header(F.col("header")), F.col("header")).otherwise(wrong).alias("header"))
    return lines.select("file", "value").join(head, "file").filter(F.col("value") != F.col("header"))


def _headed(rows: DataFrame, is_header: Callable[[Column], Column], sep: str = "\t", quoted: bool = False) -> DataFrame:
    """Attach each file's own header line: (file, cells) with ``cells`` a name → text map.

    With ``quoted`` a cell in double quotes may hold the separator.
    """
    def fields(line: Column) -> Column:
        if not quoted:
            return F.split(line, sep, -1)
        cells = F.split(line, rf'{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
        return F.transform(cells, lambda c: F.replace(F.regexp_replace(c, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))

    body = _with_header(rows, is_header).select("file", fields(F.col("header")).alias("names"), fields(F.col("value")).alias("fields"))
    width = F.size("names")
    padded = F.slice(F.concat("fields", F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width)
    return body.select("file", F.map_from_arrays("names", padded).alias("cells"))


def _has_columns(*groups: Sequence[str]) -> Callable[[Column], Column]:
    """Test of a tab-separated header: of every group at least one name is a column."""
    def test(line: Column) -> Column:
        names = F.split(line, "\t")
        return reduce(lambda x, y: x & y, [F.arrays_overlap(names, F.array(*[F.lit(n) for n in g])) for g in groups])

    return test


# Newer names of table columns and their older spellings.
HIT_COLUMNS = {
    "feature": ("Element symbol", "Gene symbol"),
    "name": ("Element name", "Sequence name"),
    "type": ("Type", "Element type"),
    "subtype": ("Subtype", "Element subtype"),
    "class": ("Class",),
    "subclass": ("Subclass",),
    "method": ("Method",),
}


def _sample_name(path: Column, suffix: str) -> Column:
    return clean_sample_id(F.regexp_replace(_group_or_name(path, "sample", r"\.(txt|tsv)"), rf"{suffix}$", ""))


def file_roster(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(sample, n_files) from file names alone, so an empty file still counts as a sample.

    The files of one ``sample=name`` folder count as one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    unit = F.regexp_replace("path", r"(/sample=[^/]*/).*$", "$1")
    return files.groupBy(_sample_name(F.col("path"), suffix).alias("sample")).agg(F.count_distinct(unit).alias("n_files"))


def scan_feature_hits(spark: SparkSession, path: str, suffix: str = r"\.amrfinder") -> DataFrame:
    """One long hit table from many per-genome tables with old or new column names.

    The sample comes from the file name or a ``sample=name`` folder; each file brings its own header. Two
    files of one sample, or a first line without the symbol and type columns, raise an error.
    """
    cells = _headed(_text(spark, path), _has_columns(HIT_COLUMNS["feature"], HIT_COLUMNS["type"]))
    repeated = file_roster(spark, path, suffix).filter("n_files > 1").agg(F.count(F.lit(1))).scalar()
    sample = F.when(repeated > 0, F.raise_error(F.lit("two files of one sample"))).otherwise(_sample_name(F.col("file"), suffix))
    pick = lambda names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])
    return cells.select(sample.alias("sample"), *[pick(v).alias(k) for k, v in HIT_COLUMNS.items()])


def scan_plasmid_calls(spark: SparkSession, mob: str, genomad: str, platon: str) -> DataFrame:
    """(genome, contig, tool) of the plasmid contigs named by three callers; an unknown header raises."""
    token = lambda c: F.split(F.trim(c), r"\s+")[0]

    def table(path: str, column: str, header: str) -> DataFrame:
        return _headed(_text(spark, path), _has_columns([column], [header])).withColumn("contig", token(F.try_element_at("cells", F.lit(column))))

    m = table(mob, "contig_id", "molecule_type").filter(F.lower(F.try_element_at("cells", F.lit("molecule_type"))) == "plasmid")
    g = table(genomad, "seq_name", "seq_name")
    name = lambda c, suffix: _group_or_name(c, "genome", suffix)
    calls = [
        m.select(name(F.col("file"), r"_mob\.txt").alias("genome"), "contig", F.lit("mob").alias("tool")),
        g.select(name(F.col("file"), r"_plasmid_summary\.tsv").alias("genome"), "contig", F.lit("genomad").alias("tool")),
        scan_fasta(spark, platon, r"\.plasmid\.fasta").select("genome", "contig", F.lit("platon").alias("tool")),
    ]
    return calls[0].unionByName(calls[1]).unionByName(calls[2]).distinct()


def scan_presence_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Present cells (sample, feature) of wide 0/1 tables whose first header cell is ``Gene``.

    A row is split against the header array, so the number of genomes does not widen the plan. A file that
    starts with another line raises.
    """
    lines = _with_header(_text(spark, path), lambda line: F.split(line, "\t")[0] == "Gene")
    body = lines.select(F.split("header", "\t").alias("names"), F.split("value", "\t").alias("fields"))
    zipped = F.slice(F.arrays_zip("names", "fields"), F.lit(2), F.size("names"))
    cells = body.select(F.col("fields")[0].alias("feature"), F.inline(zipped))
    return cells.filter(F.coalesce(F.col("fields").try_cast("double"), F.lit(0.0)) > 0).select(
        clean_sample_id(F.col("names")).alias("sample"), "feature"
    )


def scan_id_list(spark: SparkSession, path: str, strip: str = r"\.fna$") -> DataFrame:
    """(id, n): first token of each line that is neither blank nor a comment; n > 1 marks repeats."""
    line = F.trim(F.regexp_replace("value", "\r", ""))
    rows = _text(spark, path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return rows.groupBy(F.regexp_replace(F.split("line", r"\s+")[0], strip, "").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def scan_mlst_calls(spark: SparkSession, path: str) -> DataFrame:
    """(genome, scheme, st, alleles) of headerless typing lines."""
    f = F.split("value", "\t")
    return _text(spark, path).filter(F.size(f) >= 3).select(
        _base_name(f[0], r"\.fna").alias("genome"), f[1].alias("scheme"), f[2].alias("st"),
        F.slice(f, F.lit(4), F.size(f)).alias("alleles"),
    )


@F.pandas_udf(T.StringType())
def repair_mac_roman(text: pd.Series) -> pd.Series:
    """UTF-8 text that was once read as Mac Roman, put right; values without a full round trip stay."""
    kinds = text.dropna().drop_duplicates()
    repaired = kinds.str.encode("mac_roman", errors="ignore").str.decode("utf-8", errors="ignore")
    back = repaired.str.encode("utf-8").str.decode("mac_roman")
    return text.map(dict(zip(kinds, repaired.where(back == kinds, kinds))))


def scan_sampling_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(sample, facility, year) from ``;`` tables with a byte-order mark and DD.MM.YY[YY] dates.

    Files may order their columns differently; one without a ``Seq_number`` column raises.
    """
    cells = _headed(_text(spark, path), lambda line: line.rlike(r'(^|;)"?Seq_number"?(;|$)'), ";", quoted=True)
    cell = lambda name: F.trim(F.try_element_at("cells", F.lit(name)))
    y = F.regexp_extract(cell("date"), r"^\d{2}\.\d{2}\.(\d{2,4})$", 1)
    year = F.when(F.length(y) == 2, y.try_cast("int") + 2000).otherwise(y.try_cast("int"))
    filled = lambda c: F.when(c != "", c)
    return cells.select(filled(cell("Seq_number")).alias("sample"), repair_mac_roman(filled(cell("facility"))).alias("facility"), year.alias("year"))


#: Comment, quoted name, punctuation, plain name.
_NEWICK = re.compile(r"""\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[][^(),:;\[]*""")


def newick_trees(text: str) -> Iterator[list[list]]:
    """Per tree of a Newick text its nodes, parents first: [parent number, length, text, is a tip]."""
    nodes, stack, node, after_colon = [], [], None, False

    def add(tip: bool) -> int:
        nodes.append([stack[-1] if stack else None, None, None, tip])
        return len(nodes) - 1

    for match in _NEWICK.finditer(text):
        token = match.group()
        if token[0] == "[":
            continue
        if node is None and nodes and token in ",)" or node is None and token not in "(),;":
            node = add(True)
        if token == "(":
            stack.append(add(False))
        elif token == ",":
            node = None
        elif token == ")":
            if not stack:
                raise ValueError("closing bracket without an opening one")
            node = stack.pop()
        elif token == ";":
            if stack:
                raise ValueError("opening bracket without a closing one")
            if nodes:
                yield nodes
            nodes, node = [], None
        elif token != ":":
            nodes[node][1 if after_colon else 2] = token[1:-1].replace("''", "'") if token[0] == "'" and len(token) > 1 else token.strip()
        after_colon = token == ":"
    if stack:
        raise ValueError("opening bracket without a closing one")
    if nodes:
        yield nodes


def newick_edges(tree_id: str, text: str, tip_prefix: str = "") -> Iterator[tuple]:
    """Edge rows of the trees of one Newick text; several trees are told apart by ``#1``, ``#2``, … after the id.

    A tip is known by its name, without ``tip_prefix``. Inner nodes, and tips whose name is missing or repeated,
    are known by a running number behind a word that starts no tip name. The text of an inner node is its
    label, and where it is a number its support too; it never names the node.
    """
    try:
        trees = list(newick_trees(text))
    except ValueError as fault:
        raise ValueError(f"tree {tree_id}: {fault}") from fault
    for number, nodes in enumerate(trees, 1):
        own = tree_id if len(trees) == 1 else f"{tree_id}#{number}"
        names = [(n[2] or "").removeprefix(tip_prefix) if n[3] else "" for n in nodes]
        seen, word = Counter(names), "node"
        while any(n.startswith(word) for n in seen):
            word = f"_{word}"
        ids = [n if n and seen[n] == 1 else f"{word}{k}" for k, n in enumerate(names)]
        for k, (parent, length, label, tip) in enumerate(nodes):
            label = None if tip else label or None
            yield (own, ids[k], None if parent is None else ids[parent], float(length) if length else (None if parent is None else 0.0),
                   names[k] or None, label, float(label) if label and re.fullmatch(r"\d+(\.\d*)?([eE][-+]?\d+)?", label) else None)


EDGE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.StringType()), T.StructField("node", T.StringType()), T.StructField("parent", T.StringType()),
    T.StructField("length", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("support", T.DoubleType()),
])


def scan_tree_forest(spark: SparkSession, path: str, suffix: str = r"\.(nwk|txt|tree)", tip_prefix: str = "out_") -> DataFrame:
    """Edges of all trees of a folder, with labels and supports of inner nodes; empty files are skipped.

    The tree id is the file name, with a number where a file holds several trees. A Newick text cannot be
    split, so a file is the unit of work and files are the parallelism.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("value"), _group_or_name(F.col("_metadata.file_path"), "tree", suffix).alias("tree_id")
    ).filter(F.trim("value") != "")

    def parse(batches):
        for pdf in batches:
            rows = [r for t, v in zip(pdf["tree_id"], pdf["value"]) for r in newick_edges(t, v, tip_prefix)]
            yield pd.DataFrame(rows, columns=EDGE_SCHEMA.names)

    return files.mapInPandas(parse, EDGE_SCHEMA)


def scan_biosample_xml(spark: SparkSession, path: str) -> DataFrame:
    """(biosample, bioproject): the first project link whose label starts with ``PRJ``."""
    link = T.StructType([T.StructField(n, T.StringType()) for n in ("_VALUE", "_target", "_label")])
    schema = T.StructType([
        T.StructField("_accession", T.StringType()),
        T.StructField("Links", T.StructType([T.StructField("Link", T.ArrayType(link))])),
    ])
    rows = spark.read.format("xml").option("rowTag", "BioSample").option("recursiveFileLookup", "true").schema(schema).load(path)
    wanted = F.filter(F.col("Links.Link"), lambda x: (x["_target"] == "bioproject") & x["_label"].startswith("PRJ"))
    return rows.select(F.col("_accession").alias("biosample"), F.try_element_at(wanted, F.lit(1))["_label"].alias("bioproject"))


def scan_partitioned_results(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """Per-chunk result tables as one; every file's header is dropped, and one that disagrees with the schema raises."""
    return spark.read.option("header", "true").option("enforceSchema", "false").option("sep", sep).option("recursiveFileLookup", "true").schema(schema).csv(path)
