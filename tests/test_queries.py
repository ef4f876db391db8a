"""The contract file, and a sample of registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "feature_info", "burden_per_sample", "select_informative_genes", "bh_fdr", "rank_sum_test", "phi_cooccurrence", "jaccard_distance",
    "merge_intervals", "genome_plasmid_summary", "sliding_window_divergence", "run_spectrum_ssd", "extract_intervals", "core_genome_concat",
    "clade_vs_sister_ratio", "tangle_crossings", "prune_tree", "renumber_with_singletons", "scan_fasta", "scan_presence_matrix", "scan_tree_forest",
    "incremental_ingest",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    from tools.check import rows_of

    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
