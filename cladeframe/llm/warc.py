"""WARC archives as a chunked record table.

Payloads of any length pass as (record, chunk number) rows: the writer feeds slices of a payload through one
compressor, the reader inflates an archive as a stream and hands out bounded chunks, each with the digest of
the payload so far. Neither side holds the bytes of a whole record.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.lineage import cut, scratch_path
from cladeframe.llm.common import bounded_batches, table

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "page_id long, record_id string, uri string, record_type string, refers_to long, payload_bytes long, declared_digest string, "
    "chunk_no int, chunk binary, chunk_bytes long, digest_so_far string, last boolean"
)


def record_kinds(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is the response and the others
    revisit it; shorter ones are all responses. A row that repeats the smallest page_id is a response too, as
    is every copy when no page_id is known. Copies are counted before they are shuffled, and only digests
    that occur more than once join back; a hot digest is split by the adaptive skew join.
    """
    payload = F.coalesce("html", F.lit(""))
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    first = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1").drop("copies")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return known.join(first, "payload_digest", "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, chunk_chars: int = 65_536, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write one gzip member per record into archives under ``folder`` and return the list of archives.

    ``folder`` must be reachable by all executors. A retried task writes new files; only the files that a
    finished task reports are in the list, so leftovers of lost executors are never read.
    """
    bounded_batches(records.sparkSession)

    def run(batches):
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        stem, made, sink, done = f"{context.partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if sink is None:
                    path = posixpath.join(root, f"{stem}-{made:04d}.warc.gz")
                    sink, n, made = store.open_output_stream(path, compression=None), 0, made + 1
                put_record(sink.write, row, chunk_chars)
                n += 1
                if sink.tell() >= archive_bytes:
                    done.append((path, n, sink.tell()))
                    sink.close()
                    sink = None
        if sink is not None:
            done.append((path, n, sink.tell()))
            sink.close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    exact = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}  # pandas would turn nullable longs into doubles
    return cut(records.withColumns(exact).mapInPandas(run, MANIFEST))


def put_record(write, row, chunk_chars: int) -> None:
    """Stream one record: header lines, then the payload slice by slice."""
    revisit = row.record_type == "revisit"
    body = 0 if revisit else row.payload_bytes
    lines = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row.page_id is not None:
        lines.append(f"X-Page-ID: {row.page_id}")
    if row.url is not None:
        plain = re.fullmatch(r"[\x21-\x7e]+", row.url)
        lines += [f"WARC-Target-URI: {row.url}"] if plain else [f"{name}: {quote(row.url, safe=':/?&=')}" for name in ("WARC-Target-URI", "X-Quoted-URI")]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {row.refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{row.payload_digest}", f"X-Payload-Length: {row.payload_bytes}", "Content-Type: text/html", f"Content-Length: {body}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    write(pack.compress(("\r\n".join(lines) + "\r\n\r\n").encode()))
    if not revisit:
        for at in range(0, len(row.html), chunk_chars):
            write(pack.compress(row.html[at:at + chunk_chars].encode()))
    write(pack.compress(b"\r\n\r\n") + pack.flush())


class Inflated:
    """Bytes of a chain of gzip members, pulled on demand."""

    def __init__(self, source, step: int):
        self.source, self.step, self.member, self.left, self.buffer = source, step, None, b"", b""

    def fill(self) -> bool:
        while True:
            if not self.left:
                self.left = self.source.read(self.step)
                if not self.left:
                    if self.member is not None:
                        raise ValueError("archive ends inside a record")
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(self.left, self.step)
            if self.member.eof:
                self.left, self.member = self.member.unused_data, None
            else:
                self.left = self.member.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.fill():
                if self.buffer:
                    raise ValueError("archive ends inside a header")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return out

    def some(self, most: int) -> bytes:
        if not self.buffer and not self.fill():
            raise ValueError("archive ends inside a payload")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def archive_chunks(source, chunk_bytes: int, payload: bool):
    """Rows of CHUNKS of one open archive; raises where a payload does not match its declared digest."""
    stream = Inflated(source, chunk_bytes)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        digest, left, number = hashlib.sha256(), int(names["Content-Length"]), 0
        declared = names["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = names["WARC-Type"] == "revisit"
        page, refers, uri = names.get("X-Page-ID"), names.get("X-Refers-To-Page-ID"), unquote(names["X-Quoted-URI"]) if "X-Quoted-URI" in names else names.get("WARC-Target-URI")
        same = (
            page and int(page), names["WARC-Record-ID"].strip("<>"), uri, names["WARC-Type"], refers and int(refers),
            int(names["X-Payload-Length"]), declared,
        )
        while True:
            part = stream.some(min(left, chunk_bytes)) if left else b""
            left -= len(part)
            digest.update(part)
            so_far = digest.copy().hexdigest()
            if not left and not revisit and so_far != declared:
                raise ValueError(f"payload of {same[1]} does not match its digest")
            yield (*same, number, part if payload else None, len(part), declared if revisit else so_far, not left)
            number += 1
            if not left:
                break
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError(f"record {same[1]} has no end mark")


def read_archives(archives: DataFrame, chunk_bytes: int = 65_536, payload: bool = True) -> DataFrame:
    """Chunk rows of the listed archives, a task per few archives; without ``payload`` the bytes stay behind."""
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                store = fs.FileSystem.from_uri(root)[0] if root else fs.LocalFileSystem()
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for row in archive_chunks(source, chunk_bytes, payload):
                        rows.append(row)
                        held += row[9] if payload else 200
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    def frame(rows):
        columns = dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        return pd.DataFrame({n: pd.array(v, dtype="Int64") if n in ("page_id", "refers_to") else list(v) for n, v in columns.items()})

    spark = archives.sparkSession
    shared = scratch_path(spark, "x")
    root = shared if re.match(r"\w+:", shared) else ""
    return archives.repartition(max(1, archives.count())).mapInPandas(run, CHUNKS)


def join_chunks(chunks: DataFrame) -> DataFrame:
    """(page_id, record_id, payload) of responses, for records known to fit in memory."""
    return chunks.filter("record_type = 'response'").groupBy("page_id", "record_id").agg(
        F.decode(F.unhex(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: F.hex(x["chunk"])), ""
        )), "utf-8").alias("payload")
    )


def op2(spark, folder: str) -> DataFrame:
    """Write a record per page, read the archives back, and return what the records say and hold.

    Null html is an empty payload, a null page_id or url stays null, repeated rows give a record each, an
    empty table gives no archive and no rows, other columns are ignored.
    """
    archives = write_archives(record_kinds(table(spark, folder, "pages")), scratch_path(spark, "warc"))
    return read_archives(archives, payload=False).filter("last").select(
        "page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


#: The same rows from the table itself.
OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
