"""The streaming sink of wide tables."""

import glob
import os

from pyspark.sql import functions as F

from cladeframe.sources import readers as rd, wide, writers as wr


def read(path):
    """All lines of all files, each file with its header."""
    out = []
    for f in sorted(glob.glob(os.path.join(path, "**", "part-*"), recursive=True)):
        with open(f, encoding="utf-8") as h:
            out.append([line.rstrip("\n").split("\t") for line in h])
    return out


def test_distance_matrix_is_square_and_sorted(spark, tmp_path):
    tips = spark.createDataFrame([("b",), ("a",), ("c",), ("lone",)], "tip string")
    d = spark.createDataFrame([("a", "b", 1.5), ("c", "a", 2.0), ("a", "b", 1.5), ("a", "gone", 9.0)], "tip_a string, tip_b string, distance double")
    wr.write_distance_matrix(d, tips, str(tmp_path / "m"))
    assert read(tmp_path / "m") == [[["tip", "a", "b", "c", "lone"], ["a", "0.0", "1.5", "2.0", ""], ["b", "1.5", "0.0", "", ""], ["c", "2.0", "", "0.0", ""], ["lone", "", "", "", "0.0"]]]


def test_many_parts_each_with_a_header(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wide, "CELLS_A_PART", 12)
    cells = spark.range(50).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature"), F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("sample"))
    wr.write_presence_matrix(cells, cells.select("sample").distinct(), str(tmp_path / "m"))
    files = read(tmp_path / "m")
    assert len(files) == 25 and all(f[0] == ["Gene", *[f"s{i}" for i in range(6)]] and len(f) == 3 for f in files)
    assert sorted(map(tuple, rd.scan_presence_matrix(spark, str(tmp_path / "m")).select("feature", "sample").collect())) == sorted((f"f{i}", f"s{i % 6}") for i in range(50))
    assert not [f for f in os.listdir(tmp_path / "m") if f.startswith("_staging")]


def test_odd_names_folders_and_columns_beyond_the_old_limit(spark, tmp_path):
    data = [('g"1', "s\t1", "A/B c"), ("g2", " s2", None), ("g2", "s\t1", "A/B c"), ("é", " s2", "x=y")]
    cells = spark.createDataFrame(data, "feature string, sample string, class string")
    wr.write_presence_matrix(cells, cells.select("sample"), str(tmp_path / "m"), by="class")
    back = spark.read.option("header", "true").option("sep", "\t").csv(str(tmp_path / "m"))
    got = {(r["Gene"], r["class"], r["s\t1"], r[" s2"]) for r in back.collect()}
    assert got == {('g"1', "A/B c", "1", "0"), ("g2", None, "0", "1"), ("g2", "A/B c", "1", "0"), ("é", "x=y", "0", "1")}
    many = spark.range(25_000).select(F.lit("g").alias("feature"), F.format_string("s%05d", "id").alias("sample"))
    wr.write_presence_matrix(many, many.select("sample"), str(tmp_path / "wide"))
    (lines,) = read(tmp_path / "wide")
    assert len(lines[0]) == 25_001 and lines[1] == ["g", *["1"] * 25_000]


def test_nothing_to_write(spark, tmp_path):
    none = spark.createDataFrame([], "feature string, sample string")
    wr.write_presence_matrix(none, none, str(tmp_path / "m"))
    assert read(tmp_path / "m") == []
