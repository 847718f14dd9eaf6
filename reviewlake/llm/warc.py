"""WARC archives: write, normalise a monolithic gzip file, index, read back.

Crawlers and plain ``gzip`` often leave an archive as one gzip stream, in
which no record can be reached without inflating all before it.  Here

1. ``write_archives`` writes the records of each task as such a stream;
2. ``normalise`` inflates each stream once, in chunks, rewrites every record
   as a gzip member of its own and writes a sidecar index of offsets;
3. ``read_archives`` opens each member by its index entry and parses it.

Files lie in the shared folder.  A task attempt writes under a name of its
own, and the next step reads only names that a finished task returned (they
are kept as a Parquet manifest), so a lost executor or a second attempt
leaves at most an unused file.

Payload: the html in UTF-8, null as empty.  Of the rows with equal payloads of
at least ``min_dedup`` bytes those with the smallest page_id are responses,
all others revisit it; smaller payloads are always responses.  Rows that tie
on the smallest page_id are all responses; a null page_id is never the
smallest unless all are null (then all are responses).  An empty table gives
no archive and no rows; further columns are ignored; ``url`` may be null or
hold any character (percent-encoded in its header).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, scratch, written

MIN_DEDUP = 100
CHUNK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
COLUMNS = ("page_id", "url", "payload", "digest", "refers_to")
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decide(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """Adds payload, its digest, and for revisits the page_id they refer to."""
    hashed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = (hashed.where(F.length("payload") >= min_dedup).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("digest", "first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return hashed.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one WARC record."""
    uri = re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    name = "null" if page_id is None else page_id
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("ascii") + block + b"\r\n\r\n"


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """One monolithic gzip archive per task: rows (path, n_records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        path, out, n = f"{base}/mono-{uuid.uuid4().hex}.warc.gz", None, 0
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        for b in batches:
            if out is None and b.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(path, compression=None)
            for row in zip(*(b.column(c).to_pylist() for c in COLUMNS), strict=True):
                out.write(gz.compress(record(*row)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return decided.select(*COLUMNS).mapInArrow(write, "path string, n_records long")


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of a gzip file (one member or several), in chunks."""
    z = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            if out := z.decompress(data):
                yield out
            data = b""
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a WARC byte stream into records by their Content-Length."""
    buf = bytearray()
    need = None
    for c in chunks:
        buf += c
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = re.search(rb"\r\nContent-Length: *(\d+)", buf[:end], re.I)
                need = end + 4 + int(size[1]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf:
        raise ValueError(f"archive ends inside a record ({len(buf)} bytes left)")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column path) with a member per record and a sidecar
    index: rows (path, index_path, n_records)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for b in batches:
            for src in b.column("path").to_pylist():
                fs.create_dir(base, recursive=True)
                path, at, index = f"{base}/records-{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(src, compression=None) as f, \
                        fs.open_output_stream(path, compression=None) as out:
                    for rec in records(inflate(f)):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(rec) + gz.flush()
                        out.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with fs.open_output_stream(f"{path}.idx", compression=None) as out:
                    out.write("".join(f"{a}\t{n}\n" for a, n in index).encode())
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "index_path": [f"{path}.idx"], "n_records": [len(index)]})

    return archives.select("path").mapInArrow(rewrite, "path string, index_path string, n_records long")


def parse(rec: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to) of one record; a
    response's payload is hashed anew and must agree with its header."""
    head, _, block = rec[:-4].partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    page = lambda v: None if v is None or (x := v[10:-1]) == b"null" else int(x)  # noqa: E731  <urn:page:N>
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    kind = fields[b"WARC-Type"].decode()
    if kind == "response":
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest differs in {head[:200]!r}")
    return (page(fields[b"WARC-Record-ID"]), size, digest, kind, page(fields.get(b"WARC-Refers-To")))


def read_archives(indexed: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each member opened by its index entry."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index_path in zip(*(b.column(c).to_pylist() for c in ("path", "index_path")), strict=True):
                fs, _ = open_fs(folder)
                with fs.open_input_stream(index_path, compression=None) as f:
                    entries = [tuple(map(int, x.split(b"\t"))) for x in f.read().splitlines()]
                with fs.open_input_file(path) as f:
                    for k in range(0, len(entries), 5_000):
                        out = []
                        for at, n in entries[k:k + 5_000]:
                            f.seek(at)
                            out.append(parse(zlib.decompress(f.read(n), 31)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in READ_SCHEMA.split(", ")]
    return indexed.select("path", "index_path").mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    mono = written(write_archives(decide(pages), f"{folder}/mono"), "warc-mono")
    indexed = written(normalise(spread(mono), f"{folder}/records"), "warc-index")
    return read_archives(spread(indexed), folder)


def spread(files: DataFrame) -> DataFrame:
    """Deal a manifest's few rows out, so that tasks get about one file each."""
    return files.repartition(max(1, 2 * files.count()), "path")
