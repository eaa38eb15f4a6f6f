"""WARC archives: write pages, and read records as a table of chunks.

Payloads cross to Python as rows of record and chunk number, and files are read
as such rows, so no task holds a whole payload in Python. Every chunk row
carries the running size and SHA-1 of its record. Archives lie in the shared
folder, a gzip member for each record. A file counts only if the table of
written files names it, so what a lost task leaves behind is not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage, shared_folder

CHUNK = 1 << 18  # bytes of a payload in a row
REVISIT_BYTES = 1000  # equal payloads of at least this size are written once
FILE_BYTES = 1 << 30  # compressed size at which a task begins another file
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """A record per row: ``page, url, size, digest, record_type, refers_to, payload``.

    Of equal payloads of at least ``least`` bytes the largest page id is the
    response; rows that share that id are responses too.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    big = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    big = cut_lineage(big.select(F.col("digest").alias("d"), F.col("size").alias("s"), "keeper"))
    rows = rows.join(big, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return rows.select(
        "page", "url", "size", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The records with ``chunk_no`` and ``chunk``, in order, instead of ``payload``; a record without one has one row."""
    pieces = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    rows = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1)))
    return rows.withColumn("chunk", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("payload")


def _line(text: str) -> str:
    """A header value on one line of ASCII."""
    return "".join(c if " " < c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _head(page: int | None, url: str | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """WARC headers and the HTTP headers that open the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows to gzip archives; ``(path, n_records)`` of the files that count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        store.create_dir(top, recursive=True)
        out, path, count, done = None, "", 0, []
        left = seen = pack = None

        def put(data: bytes, last: bool = False) -> None:
            nonlocal pack
            pack = pack or zlib.compressobj(1, zlib.DEFLATED, 31)
            out.write(pack.compress(data))
            if last:
                out.write(pack.flush())
                pack = None

        for batch in batches:
            for page, url, size, digest, kind, refers_to, number, chunk in zip(*(batch.column(n).to_pylist() for n in ("page", "url", "size", "digest", "record_type", "refers_to", "chunk_no", "chunk"))):
                if out is None:
                    path = f"{top}/part-{uuid.uuid4().hex}.warc.gz"
                    out, count = store.open_output_stream(path, compression=None), 0
                if number == 0:
                    put(_head(page, url, size, digest, kind, refers_to))
                    left, seen = size if kind == "response" else 0, hashlib.sha1()
                if kind == "response":
                    put(chunk)
                    seen.update(chunk)
                    left -= len(chunk)
                    if not left and seen.hexdigest() != digest:
                        raise ValueError(f"record {page}: the chunks do not give digest {digest}")
                if not left:
                    put(b"\r\n\r\n", last=True)
                    count += 1
                    if out.tell() >= FILE_BYTES:
                        out.close()
                        done.append((path, count))
                        out = None
        if out is not None:
            out.close()
            done.append((path, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "n_records"])

    columns = ["page", "url", "size", "digest", "record_type", "refers_to", "chunk_no", "chunk"]
    return cut_lineage(rows.select(columns).mapInArrow(scan, "path string, n_records bigint"))


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _records(stream, chunk: int) -> Iterator[tuple[dict[str, str], dict[str, str], Iterator[bytes]]]:
    """WARC headers, HTTP headers and payload chunks of each record; read the chunks before the next record."""
    while True:
        version = stream.readline()
        while version in (b"\r\n", b"\n"):
            version = stream.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        head = _headers(stream)
        left = int(head["content-length"])
        http: dict[str, str] = {}
        if head.get("content-type", "").startswith("application/http"):
            status = stream.readline()
            left -= len(status)
            while True:
                line = stream.readline()
                left -= len(line)
                if not line.rstrip(b"\r\n"):
                    break
                name, _, value = line.decode("utf-8", "replace").partition(":")
                http[name.strip().lower()] = value.strip()

        def payload(left: int = left) -> Iterator[bytes]:
            while left > 0:
                data = stream.read(min(chunk, left))
                if not data:
                    raise EOFError("the archive ends inside a record")
                left -= len(data)
                yield data

        yield head, http, payload()


CHUNKS = "record_id string, page bigint, record_type string, url string, refers_to bigint, declared_bytes bigint, declared_digest string, chunk_no int, chunk binary, bytes_so_far bigint, sha1_so_far string, last boolean"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(files: DataFrame, folder: str, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """A row for each chunk of each record of the files, at least one a record.

    ``bytes_so_far`` and ``sha1_so_far`` cover the payload up to and with the
    chunk; ``declared_*`` are what the headers say, with the digest in hex.
    Without ``payload`` the ``chunk`` column is NULL.
    """
    names = [part.split()[0] for part in CHUNKS.split(", ")]

    def rows(path: str, store: fs.FileSystem) -> Iterator[tuple]:
        with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as stream:
            for head, http, chunks in _records(stream, chunk):
                said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                fixed = (
                    head.get("warc-record-id"), _page(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), _page(head.get("warc-refers-to")),
                    int(http["content-length"]) if "content-length" in http else None, base64.b32decode(said).hex() if said else None,
                )
                size, seen, number, held = 0, hashlib.sha1(), 0, None
                for data in chunks:
                    if held is not None:
                        yield (*fixed, number, held if payload else None, size, seen.hexdigest(), False)
                        number += 1
                    size += len(data)
                    seen.update(data)
                    held = data
                yield (*fixed, number, held if payload else None, size, seen.hexdigest(), True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())

        def batch(block: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names=names)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                block, held = [], 0
                for row in rows(path, store):
                    block.append(row)
                    held += len(row[8] or b"") + 300
                    if held >= 8 * CHUNK:
                        yield batch(block)
                        block, held = [], 0
                if block:
                    yield batch(block)

    spread = max(files.count(), 1)  # a task for each archive
    return files.select("path").repartition(spread).mapInArrow(scan, CHUNKS)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back, and describe each record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``: size and
    bare hex SHA-1 of the full payload, for a revisit those that its headers
    declare. A NULL payload is empty; a NULL URL has no target header; a NULL id
    stays NULL and revisits an equal page that has an id. Of equal rows with one
    id all are responses. An empty table gives no rows.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    files = write_archives(chunk_rows(page_records(pages, id_col, url_col, payload_col)), folder)
    ends = read_archives(files, folder, payload=False).where("last")
    whole = F.col("record_type") == "response"
    return ends.select(
        F.col("page").alias(id_col),
        F.when(whole, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
