"""A Python data source for WARC archives, and deduplicated writing of pages to them.

Reading plans one partition for each archive file (files are bounded when they
are written), parses a record's headers first, and leaves its payload undecoded,
or for plain archives unread, unless the record passes the pushed predicates and the
payload is asked for.  Predicates on ``record_type`` and other header columns
(``=``, ``IN``, ``IS NULL``, ``IS NOT NULL``) are pushed down.

Paths may be of any file system that pyarrow opens (``file:``, ``hdfs:``, ``s3:``,
``gs:``); archives are written to the shared folder of the session, each by one
task attempt under a name of its own.  Every committed job leaves a manifest of its
files; where a folder has manifests, the files of all of them are read and no others.
"""

from __future__ import annotations

import base64
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from tangentia.llm.common import HUBS, join_one, shared_dir, written

#: Bytes after which a task begins another archive file.
ROTATE_BYTES = 256 << 20
#: Payloads from this size on are stored once.
LEAST_DEDUP_BYTES = 1000
#: Pages of one payload from which its response is broadcast to them.
COPIES = 10_000
#: Manifests are ``_committed-<job>.json``.
_COMMIT = "_committed-"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column, WARC header and how to read it.
_HEADERS = {
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "record_id": "WARC-Record-ID",
    "page_id": "Page-ID",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "Payload-Length",
    "refers_to": "Refers-To-Page-ID",
}
_LONGS = {"page_id", "payload_bytes", "refers_to"}
_SCHEMA = (
    "record_type string, target_uri string, record_id string, page_id long, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _digest_header(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _digest_hex(header: str | None) -> str | None:
    """Bare hex of a SHA-1 label in base32 or hex, of any case; null for any other digest."""
    kind, _, value = (header or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _long(header: str | None) -> int | None:
    return int(header) if header and re.fullmatch(r"-?[0-9]{1,18}", header.strip()) else None


def _clean(value: str) -> str:
    """A header value on one line; the percent escapes of line ends are undone by no one, as URIs have none."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcSource(DataSource):
    """``format("warc")``; options ``path`` and, for writing, ``rotate_bytes`` and ``gzip`` (``true``)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


class WarcWriter(DataSourceWriter):
    """Writes rows (page_id, url, record_type, refers_to, digest, payload) as records, each gzipped on its own.

    A job's files count once its manifest is written.  ``overwrite`` then removes
    the manifests and archives that were there before, so what a reader meets in
    between is both, never neither.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.rotate = int(options.get("rotate_bytes", ROTATE_BYTES))
        self.gzip = options.get("gzip", "true").lower() == "true"

    def write(self, rows: Iterator) -> _Written:
        where, root = open_fs(self.path)
        where.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for row in rows:
            if out is None or size >= self.rotate:
                if out is not None:
                    out.close()
                name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}"
                files.append(name)
                out, size = where.open_output_stream(f"{root}/{name}", compression=None), 0
            data = self._record(row)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def _record(self, row) -> bytes:
        payload = bytes(row["payload"] or b"")
        uri = row["url"]
        headers = {
            "WARC-Type": row["record_type"],
            "WARC-Record-ID": self._record_id(row["page_id"], row["record_type"], row["digest"]),
            "WARC-Date": "1970-01-01T00:00:00Z",
            **({} if uri is None else {"WARC-Target-URI": _clean(uri)}),
            "WARC-Payload-Digest": _digest_header(row["digest"]),
            "Payload-Length": str(len(payload)),
            **({} if row["page_id"] is None else {"Page-ID": str(row["page_id"])}),
        }
        if row["record_type"] == "revisit":
            headers |= {
                "WARC-Profile": _PROFILE,
                "WARC-Refers-To": self._record_id(row["refers_to"], "response", row["digest"]),
                "Refers-To-Page-ID": str(row["refers_to"]),
            }
            data = record_bytes(headers, b"")
        else:
            data = record_bytes(headers | {"Content-Type": "text/html; charset=utf-8"}, payload)
        if not self.gzip:
            return data
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    def _record_id(self, page_id: int | None, kind: str, digest: str) -> str:
        """An id that a revisit can name without having met the response: of the job, page and payload."""
        if page_id is None:
            return f"<{uuid.uuid4().urn}>"
        return f"<{uuid.uuid5(uuid.UUID(self.job), f'{kind}/{page_id}/{digest}').urn}>"

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = open_fs(self.path)
        where.create_dir(root, recursive=True)
        before = [i for i in _listed(where, root) if _is_archive(i.path) or _is_manifest(i.path)] if self.overwrite else []
        files = sorted(f for m in messages if m for f in m.files)
        with where.open_output_stream(f"{root}/{_COMMIT}{self.job}.json") as out:
            out.write(json.dumps(files).encode())
        gone = [i.path for i in before if i.base_name not in files]
        for path in sorted(gone, key=lambda x: not _is_manifest(x)):
            where.delete_file(path)

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = open_fs(self.path)
        for m in messages:
            for f in m.files if m else ():
                where.delete_file(f"{root}/{f}")


def _listed(where: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """The files below a folder, or the one file a path names."""
    if where.get_file_info(root).type == fs.FileType.Directory:
        return where.get_file_info(fs.FileSelector(root, recursive=True))
    return [where.get_file_info(root)]


def _is_archive(path: str) -> bool:
    return path.endswith((".warc", ".warc.gz"))


def _is_manifest(path: str) -> bool:
    return re.search(rf"(^|/){_COMMIT}[0-9a-f]+\.json$", path) is not None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the data source API's name
        """Takes the predicates on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in _HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _HEADERS and isinstance(f, IsNull | IsNotNull):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[_File]:
        where, root = open_fs(self.path)
        found = _listed(where, root)
        jobs = [i.path for i in found if _is_manifest(i.path)]
        paths = [i.path for i in found if _is_archive(i.path)]
        if jobs:
            paths = []
            for job in jobs:
                with where.open_input_stream(job) as f:
                    paths += [f"{job.rpartition('/')[0]}/{name}" for name in json.loads(f.read())]
        return [_File(p) for p in sorted(paths)] or [_File("")]

    def passes(self, values: dict) -> bool:
        return all((values[c] in x) if how == "in" else ((values[c] is None) == x) for c, how, x in self.tests)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = open_fs(self.path)
        wants = "payload" in self.names
        rows, held = [], 0
        with where.open_input_stream(partition.path, compression=None) as raw:
            for headers, block in records(_members(raw) if partition.path.endswith(".gz") else raw):
                values = header_values(headers)
                if not self.passes(values):
                    continue
                if wants:
                    values["payload"] = None if values["record_type"] == "revisit" else payload_of(headers, block())
                    held += len(values["payload"] or b"")
                rows.append(values)
                if len(rows) >= 4096 or held >= 32 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kind = {"payload": pa.binary()} | {c: pa.int64() for c in _LONGS}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kind.get(c, pa.string())) for c in self.names], self.names
        )


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What a record's block carries: of an HTTP message its body, without the transfer's chunks; of others, and of what is no message, the block."""
    if not _is_http(headers):
        return block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not re.match(rb"HTTP/|[A-Z]+ \S+ HTTP/", head):
        return block
    chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head)
    return _unchunked(body) if chunked else body


def _unchunked(body: bytes) -> bytes:
    """The chunks' data up to the first that has none; a body that doesn't hold to the form stays as it is."""
    out, at = [], 0
    while True:
        m = re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]*\r\n").match(body, at)
        if not m:
            return body
        n = int(m[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n + 2


def header_values(headers: dict[str, str]) -> dict:
    out: dict = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
    for c in _LONGS:
        out[c] = _long(out[c])
    out["payload_digest"] = _digest_hex(out["payload_digest"])
    if out["payload_bytes"] is None and out["record_type"] != "revisit" and not _is_http(headers):
        out["payload_bytes"] = _long(headers.get("content-length"))  # of an HTTP message, no header tells its body's
    return out


def _is_http(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").partition(";")[0].strip().lower() == "application/http"


class _Members(io.RawIOBase):
    """Gzip members one after the other as one stream; ``skip`` passes bytes over."""

    def __init__(self, raw):
        self.raw, self.left, self.z = raw, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data = self.left or self.raw.read(1 << 18)
            if not data:
                return 0
            got = self.z.decompress(bytes(data), len(buffer))
            self.left = self.z.unconsumed_tail
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                buffer[: len(got)] = got
                return len(got)


def _members(raw) -> io.BufferedReader:
    return io.BufferedReader(_Members(raw), 1 << 18)


def records(stream) -> Iterator[tuple[dict[str, str], object]]:
    """Headers of each record (names in lower case) and a function that reads its block.

    A block that isn't asked for before the next record is passed over undecoded.
    """
    stream = stream if isinstance(stream, io.BufferedReader) else io.BufferedReader(_Plain(stream), 1 << 18)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", errors="replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        n, taken = _long(headers.get("content-length", "0")), []
        if not line or n is None or n < 0:
            raise ValueError("a record's headers end early or give no length")

        def block(n=n, taken=taken) -> bytes:
            if not taken:
                data = stream.read(n)
                if len(data) < n:
                    raise ValueError(f"a record ends early: {len(data)} of {n} bytes")
                taken.append(data)
            return taken[0]

        yield headers, block
        if not taken:
            while n:
                got = len(stream.read(min(n, 1 << 18)))
                if not got:
                    raise ValueError("a record ends early")
                n -= got


class _Plain(io.RawIOBase):
    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.raw.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, with the push-down of predicates that Spark leaves off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_DEDUP_BYTES,
    **options: str,
) -> None:
    """Write every row of ``pages`` as a WARC record below ``path``.

    The payload is the html in UTF-8; a null html is an empty payload.  Of
    records with equal payloads of at least ``least_bytes``, that with the largest
    id is a response and the others are revisits of it; shorter payloads are all
    responses.  Rows with a null id are responses and never referred to, rows
    that repeat the largest id are responses too (and carry the same record
    id, as page and payload are the same).  A null url is left out.  What was
    written to ``path`` before stays; revisits refer to records of the same call.
    """
    register(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(html_col, F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    kept = (
        pages.select(
            F.col(id_col).cast("long").alias("page_id"), F.encode(F.coalesce(html_col, F.lit("")), "utf-8").alias("payload")
        )
        .where(large & F.col("page_id").isNotNull())
        .groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    kept = written(kept.withColumnRenamed("digest", "_at"), "copies")
    # the payloads move once, unsorted; small ones, of which very many may be equal, meet no digest and are spread by row,
    # and a payload of very many pages is told to them where they are dealt by row too
    rows = rows.withColumn("_at", F.when(large, F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string")))
    most = max(COPIES, (kept.agg(F.sum("copies")).first()[0] or 0) // HUBS)
    rows = join_one(rows, kept, ["_at"], "copies", most, "page_id", "shuffle_hash")
    revisit = large & F.col("page_id").isNotNull() & (F.col("kept") > F.col("page_id"))
    rows = rows.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
        "digest",
        "payload",
    )
    rows.write.format("warc").mode("append").options(path=path, **options).save()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Length and digest of a response come from the payload read back, those of a
    revisit from its headers.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tangentia/warc-{uuid.uuid4().hex}"
    archive_pages(pages, path)
    back = read_archives(spark, path)
    response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )

