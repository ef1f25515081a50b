"""WARC archives of pages: written with one gzip member a record, and read back record by record.

*Writing.* Pages are grouped by the SHA-256 of their payload. Of equal payloads the one
with the smallest page id is a response, the others are revisits that refer to it and
hold no payload. Only pages whose payload may have a copy (a filter of fixed size says
so) are shuffled. Each task writes archives of its own, begins a new one beyond
``archive_bytes``, and hands back what it wrote (``manifest``). File names are new for
each attempt, and only those in the manifest are read, so a task that runs twice does no harm.

*Reading.* Archives are dealt out to tasks. A task reads each front to back in chunks:
zlib decompresses one member at a time, Content-Length says where the block ends, and
the digests of block and payload are computed on the way and compared with those
stated. Neither an archive nor a record is held whole, unless payloads are asked for.

Archives are files of the folder's store, through any file system that pyarrow knows
(shared file, hdfs, s3, gs, abfs).

Defined results: a null payload is the empty one. A row without an id revisits the
smallest id with an equal payload; where there is none it is a response. Rows equal in
id and payload are all responses, or all revisits. A null url has no target. An empty
table writes no archive. A digest that differs makes ``digest_ok`` false; an archive
that ends early, or a record whose framing is wrong, stops the read with the path. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.staging import shuffle_width
from .batches import map_rows
from .key_filter import likely, unlikely
from .scratch import Scratch

LEAST_BYTES = 0
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
MOST_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, BREAK = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


def digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _lines(first: bytes, named: list[tuple[str, str | None]]) -> bytes:
    return first + BREAK + b"".join(f"{name}: {value}".encode() + BREAK for name, value in named if value is not None) + BREAK


def member(kind: str, named: list[tuple[str, str | None]], block: bytes, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    head = _lines(VERSION, [("WARC-Type", kind), ("WARC-Date", date), *named, ("WARC-Block-Digest", "sha1:" + digest(hashlib.sha1(block))), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(BREAK + BREAK) + z.flush()


def _page_uri(page: str) -> str:
    return f"<{_PAGE}{quote(page, safe='')}>"


def _page_of(uri: str | None) -> str | None:
    bare = (uri or "").strip("<>")
    return unquote(bare[len(_PAGE):]) if bare.startswith(_PAGE) else None


def page_member(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """The record of a page: a response, or a revisit of the page ``refers_to``, whose block ends with the HTTP header."""
    block = _lines(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    named = [("WARC-Record-ID", _page_uri(page) if page is not None else f"<{uuid.uuid4().urn}>"),
             ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")),
             ("WARC-Payload-Digest", "sha1:" + digest(hashlib.sha1(payload))), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return member("response", named, block + payload, date)
    return member("revisit", [*named, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_uri(refers_to))], block, date)


@dataclass
class Record:
    """What a record says, and what was found: ``payload`` where it is kept."""

    headers: dict[str, str]
    block_bytes: int = 0
    payload_bytes: int | None = None
    block_digest: str = ""
    payload_digest: str | None = None
    digest_ok: bool = True
    payload: bytes | None = field(default=None, repr=False)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


class _Plain:
    """The plain bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: Members):
        self.source, self.z, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Add to ``held``; false at the member's end."""
        if self.z.eof:
            return False
        raw = self.source.raw or self.source.stream.read(CHUNK)
        if not raw:
            raise ValueError("the archive ends inside a record")
        try:
            self.held += self.z.decompress(raw, CHUNK)
        except zlib.error as e:
            raise ValueError(f"not a gzip member: {e}") from e
        self.source.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.held:
            if len(self.held) > MOST_HEADER or not self.more():
                raise ValueError("a record's header does not end")
        found, self.held = self.held.split(mark, 1)
        return found

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.held = self.held[:size], self.held[size:]
            size -= len(piece)
            yield piece


class Members:
    """The gzip members of a stream, one after the other."""

    def __init__(self, stream):
        self.stream, self.raw = stream, b""

    def __iter__(self) -> Iterator[_Plain]:
        while True:
            self.raw = self.raw or self.stream.read(CHUNK)
            if not self.raw:
                return
            yield _Plain(self)


def _named(head: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = head.split(BREAK)
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs}


def _size(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise ValueError("a header has no Content-Length")
    return int(value)


def read_record(plain: _Plain, keep_payload: bool = False) -> Record:
    first, headers = _named(plain.until(BREAK + BREAK))
    if not first.startswith(b"WARC/"):
        raise ValueError("a record does not begin with its version")
    record = Record(headers)
    size = _size(headers)
    http = headers.get("content-type", "").startswith("application/http")
    block, body, head, kept, n_body = hashlib.sha1(), hashlib.sha1(), b"" if http else None, [], 0
    for piece in plain.pieces(size):
        block.update(piece)
        if head is not None:  # still in the HTTP header
            head += piece
            if BREAK + BREAK not in head:
                if len(head) > MOST_HEADER:
                    raise ValueError("an HTTP header does not end")
                continue
            start, piece = head.split(BREAK + BREAK, 1)
            record.payload_bytes, head = _size(_named(start)[1]), None
        body.update(piece)
        n_body += len(piece)
        if keep_payload:
            kept.append(piece)
    while plain.more():
        pass
    if plain.held != BREAK + BREAK:
        raise ValueError("a record does not end where its Content-Length says")
    stated = headers.get("warc-payload-digest")
    record.block_bytes, record.block_digest = size, digest(block)
    revisit = record.kind == "revisit"
    record.payload_digest = (stated or "").removeprefix("sha1:") if revisit else digest(body)
    if not revisit:
        record.payload_bytes, record.payload = n_body, b"".join(kept) if keep_payload else None
    record.digest_ok = (headers.get("warc-block-digest") in (None, "sha1:" + record.block_digest)) and (revisit or stated in (None, "sha1:" + record.payload_digest))
    return record


def read_stream(stream, keep_payload: bool = False) -> Iterator[Record]:
    for plain in Members(stream):
        yield read_record(plain, keep_payload)


def planned(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to) as texts; ``refers_to`` is set where the record is a revisit."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    copies = scratch.keep(groups.filter((F.col("n") > 1) & F.col("least").isNotNull()).select("key", "least"), "copies")
    alone = unlikely(rows, "key", copies).withColumn("least", F.lit(None).cast(pages.schema[page_id].dataType))
    both = alone.unionByName(likely(rows, "key", copies).join(copies, "key", "left"))
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return both.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", refers_to.cast("string").alias("refers_to"))


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Archives of ``planned`` records in ``folder``; running the result gives (path, records, bytes) of each archive."""
    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, n, size = None, "", 0, 0
        for page, url, payload, refers_to in part:
            if out is None:
                store.create_dir(base, recursive=True)
                name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                info = member("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1" + BREAK, date)
                out.write(info)
                size += len(info)
            packed = page_member(page, url, payload.encode(), refers_to, date)
            out.write(packed)
            n, size = n + 1, size + len(packed)
            if size >= archive_bytes:
                out.close()
                yield f"{folder}/{name}", n, size
                out = None
        if out is not None:
            out.close()
            yield f"{folder}/{name}", n, size

    return map_rows(records, run, "path string, records bigint, bytes bigint")


def read(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives named in ``manifest.path``."""
    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        for (path,) in part:
            store, name = pyarrow.fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as stream:
                try:
                    for r in read_stream(stream, keep_payload):
                        yield (path, r.kind, _page_of(r.headers.get("warc-record-id")), _page_of(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri"),
                               r.payload_bytes, r.payload_digest, r.digest_ok, r.payload)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e

    dealt = manifest.select("path").repartition(shuffle_width(manifest))
    return map_rows(dealt, run, "path string, record_type string, page_id string, refers_to string, url string, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary")


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits whose response is not there or has another payload digest."""
    responses = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.filter("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left_anti")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write all ``pages`` to archives in ``folder`` (by default one under the shared folder); the manifest, as written."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfwise/warc-{uuid.uuid4().hex}"
    scratch = Scratch(spark)
    return scratch.result(write(planned(pages, scratch, least_bytes=least_bytes, **columns), folder.rstrip("/"), archive_bytes), "manifest")
