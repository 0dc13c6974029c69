"""WARC files by index: offset, length, URL and digest of each record are known before any body is read."""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, shared_path

#: Ranges with at most so many bytes between them are read at once, up to MAX_READ bytes.
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: A task reads records of at most about SPAN bytes, and of less (LEAST_SPAN at least) where cores would be idle.
SPAN, LEAST_SPAN = 64 << 20, 2 << 20
#: The date in the records: that of the pages isn't known, and the clock's would make each run's bytes differ.
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, record_id string, page_id long, url string, digest string, status int, n_bytes long"
_CHUNK = 1 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0  ]")


def _open(uri: str):
    """(file system, path) of a URI, or of a plain path; local, HDFS and object stores alike."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """One gzip member with a response record, the same bytes on every run. A null page is status 204, a null URL no
    target header, a null id a name by content; a URL with blanks or control characters is escaped and marked, so that it
    is read back as it was."""
    body = b"" if html is None else html.encode("utf-8", "surrogatepass")
    head = "HTTP/1.1 204 No Content\r\n\r\n" if html is None else "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head.encode() + body
    content = hashlib.sha1(repr(url).encode() + b"\n" + block).hexdigest()
    name = f"urn:sha1:{content}" if page_id is None else f"urn:page:{page_id}"
    lines = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        odd = not url or bool(_UNSAFE.search(url))
        lines.append("WARC-Target-URI: " + (urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=~-._", errors="surrogatepass") if odd else url))
        if odd:
            lines.append("X-Target-URI-Escaped: 1")
    lines += [f"WARC-Payload-Digest: {_digest(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(raw: bytes) -> dict:
    """The index fields and the page of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.lower()] = v.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    url = fields.get("warc-target-uri")
    if "x-target-uri-escaped" in fields:
        url = urllib.parse.unquote(url, errors="surrogatepass")
    name = fields.get("warc-record-id", "").strip("<>")
    out = {"record_id": name, "page_id": int(name[9:]) if re.fullmatch(r"urn:page:-?\d+", name) else None, "url": url, "type": fields.get("warc-type")}
    if "application/http" in fields.get("content-type", ""):
        http, _, block = block.partition(b"\r\n\r\n")
        out["status"] = int(http.split(b" ", 2)[1])
    else:
        out["status"] = 200
    out["digest"] = fields.get("warc-payload-digest") or _digest(block)
    out["body"] = block
    return out


def write_warc(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) as .warc.gz files with one gzip member a record; returns (file, records).

    Each task attempt has files of its own name, so that a lost executor leaves no more than a file
    that nobody lists: take the files from the result, and write it to a table before using it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = _open(folder)
        disk.create_dir(base, recursive=True)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = disk.open_output_stream(f"{base}/{name}", compression=None)
                out.write(record(*row, date))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "file string, records long")


def scan(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed record) of each gzip member of a stream."""
    offset, left = 0, b""
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            data = left or stream.read(_CHUNK)
            if not data:
                if used:
                    raise ValueError("a record is cut off")
                return
            left = b""
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            left = unpack.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def index_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """INDEX of the response records in the .warc.gz files of files.file: one pass, bodies are dropped."""
    names = ["file", "offset", "length", "record_id", "page_id", "url", "digest", "status", "n_bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for file in b.column(0).to_pylist():
                disk, at = _open(file)
                with disk.open_input_stream(at, compression=None) as stream:
                    for offset, length, raw in scan(stream):
                        r = parse(raw)
                        if r["type"] == "response":
                            rows.append((file, offset, length, r["record_id"], r["page_id"], r["url"], r["digest"], r["status"], len(r["body"])))
                        if len(rows) >= 5000:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return files.select("file").mapInArrow(run, INDEX)


def coalesced(ranges: list[tuple[int, int]], gap: int = MAX_GAP, most: int = MAX_READ) -> list[tuple[int, int, list[int]]]:
    """(start, end, positions in ranges) of the reads that cover sorted (offset, length) ranges."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        end = offset + length
        if reads and offset - reads[-1][1] <= gap and max(end, reads[-1][1]) - reads[-1][0] <= most:
            start, last, held = reads[-1]
            held.append(i)
            reads[-1] = (start, max(last, end), held)
        else:
            reads.append((offset, end, [i]))
    return reads


def read_records(selected: DataFrame) -> DataFrame:
    """(page_id, url, html) of the records in `selected`, which are rows of an index (others of its columns are ignored).

    Ranges are cut into tasks by place, so that each has its share of the bytes, sorted, and near ones read together;
    nothing else of the files is read. A row that is selected twice is returned twice; no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, offsets, lengths = (c.to_pylist() for c in b.columns)
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                disk, at = _open(files[i])
                with disk.open_input_file(at) as f:
                    for start, end, held in coalesced(list(zip(offsets[i:j], lengths[i:j]))):
                        f.seek(start)
                        data, rows = f.read(end - start), []
                        for k in held:
                            a = offsets[i + k] - start
                            r = parse(zlib.decompress(data[a : a + lengths[i + k]], 31))
                            rows.append((r["page_id"], r["url"], None if r["status"] == 204 else r["body"].decode("utf-8", "surrogatepass")))
                        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "html"])
                i = j

    places = Table(selected.select("file", "offset", "length"), "warc_places").df
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # a number of its own: adaptive execution would go by the size of the index rows, and make one task of them
    tasks = max(1, -(-total // SPAN), min(-(-total // LEAST_SPAN), places.sparkSession.sparkContext.defaultParallelism))
    near = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, "page_id long, url string, html string")


def first_per_digest(index: DataFrame) -> DataFrame:
    """One index row per payload digest and status: the lowest page id (null last), then the lowest place."""
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("file").alias("c"), F.col("offset").alias("d"))
    row = F.struct("file", "offset", "length", "page_id", "url", "digest", "status")
    return index.groupBy("digest", "status").agg(F.min_by(row, order).alias("r")).select("r.*")


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages as WARC files, their index, and the pages of the records selected from it: one per payload.

    Returns (page_id, url, html); of pages with equal html the one with the lowest id, null last. Pages
    with null html are alike, and differ from empty ones. Null ids and URLs come back as they were; other
    columns of pages are ignored; no pages give none."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    files = Table(write_warc(pages, folder), "warc_files")
    n = max(1, min(files.df.count(), 100_000))
    index = Table(index_warc(spark, files.df.repartition(n)), "warc_index")
    return read_records(first_per_digest(index.df))
