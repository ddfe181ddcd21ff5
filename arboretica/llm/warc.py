"""WARC archives: a writer of one gzip member per record, and a sequential reader that checks framing and digests."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from .shared import keep, new_path

_CHUNK = 1 << 18
#: Bytes of an archive file, after which a writer begins another.
FILE_BYTES = 256 << 20
SALTS = 64


class WarcError(ValueError):
    """The archive is cut short, badly framed, or a digest does not fit."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record as one gzip member."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Target-URI: " + uri.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers.items()]
    lines += [b"Content-Length: " + str(len(body)).encode(), b"", b""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines)) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def read_records(stream, check: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of a gzip WARC stream, in order, one member at a time.

    Bytes are inflated as they are read; what is held is one record. Each member must hold exactly one record: a version
    line, headers, as many body bytes as Content-Length says, and two line ends. Digests are compared if ``check``.
    """
    pending = b""
    while True:
        if not pending:
            pending = bytes(stream.read(_CHUNK))
            if not pending:
                return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not pending:
                pending = bytes(stream.read(_CHUNK))
                if not pending:
                    raise WarcError("the archive ends inside a member")
            try:
                parts.append(inflate.decompress(pending))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            pending = inflate.unused_data
        data = b"".join(parts)
        head, found, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or not lines[0].startswith(b"WARC/"):
            raise WarcError("no WARC header")
        headers = {}
        for line in lines[1:]:
            name, colon, value = line.partition(b":")
            if not colon:
                raise WarcError(f"bad header line {line[:80]!r}")
            headers[name.decode().strip().lower()] = value.decode().strip()
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError("no content length") from None
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise WarcError("content length does not fit the record")
        body = rest[:length]
        if check and "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest(body)}":
            raise WarcError("block digest does not fit")
        yield headers, body


def _text(value: str | None) -> str:
    """A header value: line ends and other control characters would break the framing."""
    from urllib.parse import quote

    return "" if value is None else quote(value, safe=":/?#[]@!$&'()*+,;=%-._~")


def _writer(path: str, file_bytes: int):
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, name, wrote, n = None, "", 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                key, url, html, first = (batch.column(c)[row].as_py() for c in ("id", "url", "html", "refers_to"))
                payload = (html or "").encode()
                headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "X-Page-Id": "" if key is None else str(key), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Payload-Length": str(len(payload))}
                if first is not None:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(first)}
                body = payload if first is None else b""
                headers["WARC-Block-Digest"] = f"sha1:{digest(body)}"
                data = record("response" if first is None else "revisit", _text(url), headers, body)
                if out is not None and wrote + len(data) > file_bytes:
                    out.close()
                    yield _file_row(name, n, wrote)
                    out = None
                if out is None:  # a new name each time: what a lost or repeated task has left is never read
                    name, wrote, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                wrote, n = wrote + len(data), n + 1
        if out is not None:
            out.close()
            yield _file_row(name, n, wrote)
    return run


def _file_row(name: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, path: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write one record per row; returns the folder and the table ``(file, records, bytes)`` of the archives that count.

    Of the records whose payloads are equal and of at least ``min_bytes`` bytes, that with the largest id is a response and
    the others are revisits of it; repeated rows with that id are all responses. A null body is empty. A null id is smaller
    than any other; where a payload has null ids only, all its records are responses.

    The owners are found on narrow rows: digests are counted per (digest, salt) and then per digest, and only digests that
    occur twice go back, to one row for each salt they occur with; so neither a hot payload nor its join meets in one task.
    Each writer task streams its rows to its own files in the shared folder.
    """
    spark = pages.sparkSession
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(body_col).alias("html"))
    # the payload's SHA-1 in the JVM, so that text crosses to Python once, in the writer
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = source.withColumn("hex", F.sha1(body)).withColumn("size", F.octet_length(F.coalesce("html", F.lit("")))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    part = marked.where(F.col("size") >= min_bytes).groupBy("hex", "salt").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n"))
    part = keep(part, "digests")
    owner = part.groupBy("hex").agg(F.max("owner").alias("owner"), F.sum("n").alias("n")).where("n > 1 AND owner IS NOT NULL").select("hex", "owner")
    back = part.select("hex", "salt").join(owner, "hex")
    joined = marked.join(back, ["hex", "salt"], "left").select(
        "id", "url", "html",
        F.when((F.col("size") >= min_bytes) & (F.col("id").isNull() | (F.col("id") != F.col("owner"))), F.col("owner")).alias("refers_to"),
    )
    path = path or new_path(spark, "warc")
    files = keep(joined.mapInArrow(_writer(path, file_bytes), "file string, records long, bytes long"), "warc-files")
    return path, files


_RECORD_FIELDS = [("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def read_archives(files: DataFrame, path: str, *, with_payload: bool = False, check: bool = True) -> DataFrame:
    """Read archives back: rows ``(id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])``.

    files: the table of archives; each is read by one task, sequentially. For revisits length and digest are those that the
    record names, as its payload lies elsewhere; for responses they are of the payload that was read, and must agree.
    """
    fields = _RECORD_FIELDS if with_payload else _RECORD_FIELDS[:-1]
    schema = pa.schema(fields)

    def rows(name, fs, root):
        with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for headers, body in read_records(stream, check):
                kind, told = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
                size = int(headers.get("x-payload-length", len(body)))
                if kind == "response":
                    if check and (told != digest(body) or size != len(body)):
                        raise WarcError(f"payload of page {headers['x-page-id']} does not fit its digest")
                key, first = headers.get("x-page-id"), headers.get("x-refers-to-page")
                yield (int(key) if key else None, headers.get("warc-target-uri"), size, told, kind, int(first) if first else None, body)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*out), fields)], schema=schema)

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out, size = [], 0
                for row in rows(name, fs, root):
                    out.append(row)
                    size += len(row[-1])
                    if len(out) >= 2000 or with_payload and size > 8 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    columns = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # a file is one task's work: an explicit number of partitions is not coalesced
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(run, columns)
