"""Sink for wide tables: sorted cells stream to lines of any number of columns.

A data source writer takes (folder, part, row_no, row, col_nos, cells, width) rows, a part's rows in order of row and
column, and writes one file per part, the header line first. A row brings the cells of a stretch of CELLS_A_ROW columns at
most, so a line may have as many columns as the roster has names. Files appear under the path only when the job commits: tasks write to a
``_staging`` folder, which readers skip, and what failed or repeated tasks leave there is removed.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cladeframe.functions.lineage import cut
from cladeframe.functions.scan import sorted_index

NAMES = ("folder", "part", "row_no", "row", "col_nos", "cells", "width")
CELLS_A_PART = 1 << 22
CELLS_A_ROW = 256


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _quoted(value: str) -> str:
    """A field as Spark's own tables write it."""
    if value and value.strip() == value and not re.search(r'[\t"\n\r]', value):
        return value
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (staged, final)


class _WideWriter(DataSourceWriter):
    def __init__(self, path: str, fill: str):
        self.path, self.fill, self.job = path.rstrip("/"), fill, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return posixpath.join(root, f"_staging-{self.job}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        files, sink, at, line, col = [], None, None, None, 0

        def pad(upto: int) -> None:
            sink.write((("\t" + self.fill) * (upto - col)).encode())

        def close(width: int) -> None:
            if sink is not None:
                pad(width)
                sink.write(b"\n")
                sink.close()

        width = 0
        for folder, part, row_no, row, col_nos, cells, wide in iterator:
            if (folder, part) != at:
                close(width)
                at, line, col, width = (folder, part), None, 0, wide
                name = f"part-{part:08d}-{uuid.uuid4().hex}.csv"
                inside = posixpath.join(folder, name) if folder else name
                staged = posixpath.join(self._staging(root), name)
                store.create_dir(posixpath.dirname(staged), recursive=True)
                sink = store.open_output_stream(staged, compression=None)
                files.append((staged, posixpath.join(root, inside)))
            if row_no != line:
                if line is not None:
                    pad(width)
                    sink.write(b"\n")
                line, col = row_no, 0
                sink.write(_quoted(row).encode())
            piece = []
            for col_no, value in zip(col_nos, cells):
                piece += [self.fill] * (col_no - col)
                piece.append(self.fill if value is None else _quoted(value))
                col = col_no + 1
            sink.write("".join("\t" + cell for cell in piece).encode())
        close(width)
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            for staged, final in message.files if message else []:
                store.create_dir(posixpath.dirname(final), recursive=True)
                store.move(staged, final)
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(root))


class WideSource(DataSource):
    """``df.write.format("wide_cells").option("fill", "0").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "wide_cells"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _WideWriter(self.options["path"], self.options.get("fill", ""))


def write_wide(cells: DataFrame, rows: DataFrame, columns: DataFrame, path: str, corner: str, fill: str = "", by: Column | None = None) -> None:
    """Write ``cells`` (row, col, value, and what ``by`` needs) as tab-separated tables with one line per row name.

    ``rows`` (row) and ``columns`` (col) are the rosters, in the files sorted by name; cells of other names fall out, missing
    ones are ``fill``, of repeated ones the smallest counts. Each file starts with a header line of ``corner`` and the
    columns; without columns there is nothing to write. With ``by`` every value has a folder ``key=value`` of its own holding the rows that have a cell in it.
    """
    spark = cells.sparkSession
    spark.dataSource.register(WideSource)
    text = lambda df, name: df.select(F.col(name).cast("string").alias(name)).filter(F.col(name).isNotNull()).distinct()
    cols = cut(sorted_index(text(columns, "col"), ["col"], "col_no").withColumn("col_no", F.col("col_no") - 1))
    lines = cut(sorted_index(text(rows, "row"), ["row"], "row_no"))
    width = cols.count()
    if not width:
        return
    a_part = max(1, CELLS_A_PART // max(1, width))
    folder = F.lit("") if by is None else by
    named = cells.select(folder.alias("folder"), F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), F.col("value").cast("string").alias("value"))
    # written once: the lines' cells, the lines without any and the headers of folders all come from here
    named = cut(named.groupBy("folder", "row", "col").agg(F.min("value").alias("value")))
    part = F.floor((F.col("row_no") - 1) / a_part).alias("part")
    body = named.join(lines, "row").join(cols, "col").select("folder", part, "row_no", "row", "col_no", "value")
    if by is None:
        # A row of the roster without any cell still has its line: its first cell is written as missing.
        bare = lines.join(named.select("row").distinct(), "row", "left_anti").select(
            F.lit("").alias("folder"), part, "row_no", "row", F.lit(0).cast("long").alias("col_no"), F.lit(None).cast("string").alias("value"))
        body = body.unionByName(bare)
    parts = (lines.select(F.lit("").alias("folder"), part) if by is None else body.select("folder", "part")).distinct()
    head = parts.withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).join(cols, "col_no").select(
        "folder", "part", F.lit(0).cast("long").alias("row_no"), F.lit(corner).alias("row"), "col_no", F.col("col").alias("value"))
    out = body.unionByName(head).withColumn("width", F.lit(width).cast("long"))
    at = ["folder", "part", "row_no", "row", "width"]
    stretch = F.floor(F.col("col_no") / CELLS_A_ROW).alias("stretch")
    # the grouping finds the rows where the parts already are
    rows_of = out.repartition("folder", "part").groupBy(*at, stretch).agg(F.array_sort(F.collect_list(F.struct("col_no", "value"))).alias("c"))
    rows_of = rows_of.withColumns({"col_nos": F.col("c.col_no"), "cells": F.col("c.value")}).sortWithinPartitions("folder", "part", "row_no", "stretch")
    rows_of.select(*NAMES).write.format("wide_cells").option("fill", fill).mode("append").save(path)


def folder_of(key: str, value: Column) -> Column:
    """``key=value`` as partition folders are named."""
    plain = F.replace(F.url_encode(F.nullif(value.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{key}="), F.coalesce(plain, F.lit("__HIVE_DEFAULT_PARTITION__")))
