"""WARC archives: written as one gzip stream each, then normalised to one gzip member per record with an offset index.

``write_archives`` stores payloads; of records with equal payloads one is a response and the others revisit it.
``normalise`` inflates each archive once, as a stream, and rewrites every record as a gzip member of its own, so
that a record can be read by its offset; beside each new archive lies its index. ``read_archives`` reads records through the index.

Tasks move bytes in chunks and hold one header and one chunk at a time (reading yields whole payloads). They write through the file
system that the folder's URI names, under names of their own attempt; what a lost attempt left behind is
named by no manifest and so never read. An archive is the unit of parallel work; the writer closes one after
ARCHIVE_BYTES of records.

Defined results: a null payload is empty; a null URL gives no target header; control characters in a URL are
percent-encoded; a row without an id gets a record without a number (its id reads back as null) and is never referred
to; rows that repeat the smallest id of equal payloads are responses too; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

CHUNK = 1 << 18
ARCHIVE_BYTES = 1 << 27
GZIP = 31  # zlib's window setting for the gzip format
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
MANIFEST = "path string, index string, records bigint, bytes bigint"
RECORD = ("archive string, offset bigint, length bigint, record_type string, page_id bigint, refers_to bigint, "
          "target_uri string, payload_bytes bigint, payload_digest string, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _of_urn(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit that keeps the HTTP header and leaves the payload out."""
    head = HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to. Groups of equal payloads are met by hash and pre-aggregated; only those with
    several members take part in the join."""
    own = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    key = F.sha2("payload", 256)
    large = F.octet_length("payload") >= min_bytes
    groups = (own.where(large).groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1 and first is not null").select("key", "first"))
    joined = own.withColumn("own_key", F.when(large, key)).join(groups, F.col("own_key") == F.col("key"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``plan_revisits``, each archive as one gzip stream; its manifest."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        context, done = TaskContext.get(), []
        sink, packer, n, size = None, None, 0, 0
        name = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}"

        def close():
            sink.write(packer.flush())
            sink.close()
            done.append({"path": f"{name}-{len(done)}.warc.gz", "index": None, "records": n, "bytes": size})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if sink is None:
                    sink, packer, n, size = fs.open_output_stream(f"{name}-{len(done)}.warc.gz", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                data = record(page_id, url, payload.encode(), refers_to, date)
                sink.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield _manifest(done)

    return materialize(records.mapInArrow(run, MANIFEST), "archives")


def _manifest(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


class Inflated:
    """The content of a gzip file, of one member or several, read forward in chunks."""

    def __init__(self, source):
        self.source, self.inflate, self.rest, self.started = source, zlib.decompressobj(GZIP), b"", False
        self.buffer, self.at = b"", 0

    def _more(self) -> bool:
        self.buffer, self.at = self.buffer[self.at:], 0
        while True:
            data = self.rest or self.source.read(CHUNK)
            if data and self.inflate.eof:
                self.inflate = zlib.decompressobj(GZIP)
            self.started |= bool(data)
            out = self.inflate.decompress(data, CHUNK)
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
            if out:
                self.buffer += out
                return True
            if not data:
                if self.started and not self.inflate.eof:
                    raise ValueError("the archive ends inside a gzip member")
                return False

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        out, self.at = self.buffer[self.at:end + 1], end + 1
        return out

    def read(self, n: int) -> bytes:
        """At most n bytes, at least one unless at the end."""
        if self.at == len(self.buffer) and not self._more():
            return b""
        out = self.buffer[self.at:self.at + n]
        self.at += len(out)
        return out


def read_header(source: Inflated) -> tuple[bytes, dict[str, str]] | None:
    """The next record's header, as it stands and by name in lower case; None at the end."""
    line = source.line()
    while line in (b"\r\n", b"\n"):
        line = source.line()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"a record begins with {line[:40]!r}")
    lines = [line]
    while (line := source.line()).strip():
        lines.append(line)
    if not line:
        raise ValueError("the archive ends inside a header")
    fields = {}
    for x in lines[1:]:
        name, _, value = x.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join(lines) + b"\r\n", fields


def rewrite(source, sink, index) -> tuple[int, int]:
    """Copy an archive record by record, each as a gzip member; offsets go to the index. Records and bytes written."""
    inflated, offset, n = Inflated(source), 0, 0
    while (found := read_header(inflated)) is not None:
        header, fields = found
        member, size, left = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, int(fields["content-length"])

        def put(packed: bytes) -> int:
            sink.write(packed)
            return len(packed)

        size += put(member.compress(header))
        while left:
            data = inflated.read(min(left, CHUNK))
            if not data:
                raise ValueError("the archive ends inside a record")
            size += put(member.compress(data))
            left -= len(data)
        size += put(member.compress(b"\r\n\r\n") + member.flush())
        index.write(f"{offset}\t{size}\t{fields.get('warc-type', '')}\t{fields.get('warc-record-id', '')}\n".encode())
        offset, n = offset + size, n + 1
    return n, offset


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives of a manifest (a row per archive, by ``path``); the manifest of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        attempt, done = TaskContext.get().taskAttemptId(), []
        for batch in batches:
            for path in batch["path"].to_pylist():
                to = f"{root}/{path.rpartition('/')[2].removesuffix('.gz').removesuffix('.warc')}-{attempt}.warc.gz"
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(to, compression=None) as sink, fs.open_output_stream(to + ".idx") as index:
                    n, size = rewrite(source, sink, index)
                done.append({"path": to, "index": to + ".idx", "records": n, "bytes": size})
        yield _manifest(done)

    return materialize(_one_each(archives).mapInArrow(run, MANIFEST), "normalised")


def _one_each(manifest: DataFrame) -> DataFrame:
    """About a task per archive."""
    return manifest.repartition(max(1, manifest.count()))


def read_member(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record."""
    inflate = zlib.decompressobj(GZIP)
    text = inflate.decompress(data)
    if not inflate.eof or inflate.unused_data:
        raise ValueError("a record is not one gzip member")
    header, _, rest = text.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in header.decode().split("\r\n")[1:]))
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def read_archives(spark: SparkSession, normalised: DataFrame, folder: str) -> DataFrame:
    """All records of normalised archives, each read by its offset. A response's digest is that of the payload read;
    a revisit has the digest and the size its header states, and no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in RECORD.split(", ")])
        rows, held = [], 0
        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist()):
                with fs.open_input_stream(index) as lines, fs.open_input_file(path) as archive:
                    for line in lines.read().decode().splitlines():
                        offset, length, *_ = line.split("\t")
                        archive.seek(int(offset))
                        fields, http, payload = read_member(archive.read(int(length)))
                        new = fields["warc-type"] == "response"
                        size = len(payload) if new else int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = sha1_base32(payload) if new else fields["warc-payload-digest"].removeprefix("sha1:")
                        if new and fields["warc-payload-digest"] != "sha1:" + digest:
                            raise ValueError(f"{path}: the payload at {offset} does not have its digest")
                        rows.append(dict(zip(names, (path, int(offset), int(length), fields["warc-type"], _of_urn(fields["warc-record-id"]), _of_urn(fields.get("warc-refers-to")),
                                                     fields.get("warc-target-uri"), size, digest, payload if new else None))))
                        held += len(payload)
                        if held > 1 << 24 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return _one_each(normalised).mapInArrow(run, RECORD)
