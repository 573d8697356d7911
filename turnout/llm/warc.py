"""WARC archives: one gzip member a record, written by tasks and read back in sequence.

The reader never holds an archive: it inflates members bit by bit, takes each record's header up to the blank line, then as
many bytes as Content-Length says, feeding them to the digest as they come, and checks the block digest and the payload digest.
Every archive is one task's work; archives are closed at ``archive_bytes``, so their number follows the data.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest id is the response and the others
refer to it.

Defined cases: a null or empty html is an empty payload; a null url is written as an empty target; rows with a null id are
responses of their own; rows that repeat the largest id of a payload are all responses; line breaks in a url are percent-encoded;
an empty table writes no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.files import Output, attempt_file, dealt, run_folder, ship, store

CHUNK = 1 << 16
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string, problem string"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """An archive that does not follow the format, with the place in the file."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record in the plain form; a revisit has the HTTP head but not the payload."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


@dataclass
class Record:
    """What the reader keeps of a record."""

    headers: dict[str, str]
    block_bytes: int
    payload_bytes: int
    payload_sha1: bytes
    problem: str | None = None
    body: bytes | None = field(default=None, repr=False)


class _Framing:
    """Takes the bytes of one gzip member and frames the record in it."""

    def __init__(self, keep_body: bool):
        self.keep, self.buffer, self.headers, self.left = keep_body, bytearray(), None, 0
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.block_bytes = self.payload_bytes = 0
        self.http_head: bytearray | None = bytearray()
        self.tail, self.parts = bytearray(), []

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            seen = max(0, len(self.buffer) - 3)
            self.buffer += data
            end = self.buffer.find(b"\r\n\r\n", seen)
            if end < 0:
                if len(self.buffer) > 1 << 20:
                    raise WarcError("header without end")
                return
            lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = self.headers.get("content-length", "")
            if not length.isdigit():
                raise WarcError("no Content-Length")
            self.left, data, self.buffer = int(length), bytes(self.buffer[end + 4:]), bytearray()
        own, rest = data[:self.left], data[self.left:]
        self.left -= len(own)
        self.tail += rest
        if own:
            self.block.update(own)
            self.block_bytes += len(own)
            self._payload(own)

    def _payload(self, data: bytes) -> None:
        if self.http_head is not None and "http" in self.headers.get("content-type", ""):
            seen = max(0, len(self.http_head) - 3)
            self.http_head += data
            end = self.http_head.find(b"\r\n\r\n", seen)
            if end < 0:
                return
            data, self.http_head = bytes(self.http_head[end + 4:]), None
        self.payload.update(data)
        self.payload_bytes += len(data)
        if self.keep:
            self.parts.append(data)

    def close(self) -> Record:
        if self.headers is None:
            raise WarcError("member without a record header")
        problem = None
        stated = self.headers.get("warc-block-digest")
        if self.left:
            problem = f"{self.left} bytes missing"
        elif bytes(self.tail) != b"\r\n\r\n":
            problem = "bytes after the record"
        elif stated and stated != "sha1:" + base32_sha1(self.block.digest()):
            problem = "block digest differs"
        elif self.headers.get("warc-type") != "revisit" and (want := self.headers.get("warc-payload-digest")) and want != "sha1:" + base32_sha1(self.payload.digest()):
            problem = "payload digest differs"
        return Record(self.headers, self.block_bytes, self.payload_bytes, self.payload.digest(), problem, b"".join(self.parts) if self.keep else None)


def read_archive(read: Callable[[int], bytes], keep_body: bool = False) -> Iterator[Record]:
    """The records of an archive in order; ``read(n)`` gives the next bytes, at most n, and none at the end."""
    data = read(CHUNK)
    while data:
        inflate, framing = zlib.decompressobj(31), _Framing(keep_body)
        while not inflate.eof:
            try:
                plain = inflate.decompress(data, CHUNK * 4)
            except zlib.error as error:
                raise WarcError(f"broken member: {error}") from error
            framing.feed(plain)
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if not inflate.eof and not data and not plain and not (data := read(CHUNK)):
                raise WarcError("archive ends inside a member")
        yield framing.close()
        data = data or read(CHUNK)


def revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) of every page; pages need page_id, url and html.

    Only payloads that occur more than once go into the join's other side: one row a payload, made by an aggregation that
    combines before the shuffle.  A payload of a third of all pages is a skewed key of the join, which the adaptive plan splits.
    """
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.unhex(F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= revisit_bytes
    last = keyed.where(large).select(digest.alias("digest"), "page_id").groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL").select("digest", "last")
    joined = keyed.withColumn("digest", F.when(large, digest)).join(last, "digest", "left")
    refers_to = F.when(F.col("page_id") != F.col("last"), F.col("last"))
    return joined.select("page_id", "url", F.col("html").cast("binary").alias("payload"), refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 28) -> DataFrame:
    """Writes a record for every page (page_id, url, html) to archives in the shared folder; gives (archive, records, bytes).

    The rows are the manifest: written once, they name the archives of the tasks that finished, and only those are read.
    """
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records = None, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            done.append((out.uri, records, out.size))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is not None and out.size >= archive_bytes:
                    close()
                    out = None
                if out is None:
                    out, records = Output(attempt_file(f"{folder}/data", "part", ".warc.gz")), 0
                out.write(member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)))
                records += 1
        if out is not None:
            close()
        if done:
            archive, counts, sizes = zip(*done, strict=True)
            yield pa.record_batch([pa.array(archive), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    ship(spark)
    revisits(pages, revisit_bytes).mapInArrow(write, "archive string, records bigint, bytes bigint").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of ``archives`` (archive), in the columns of RECORDS; ``problem`` is null for a sound record.

    A record's digest and length are those of the full payload: computed from it for responses, as stated for revisits.
    A broken archive gives what is readable and then one row with only ``archive`` and ``problem``.
    """

    def rows(uri: str) -> Iterator[dict]:
        system, path = store(uri)
        with system.open_input_stream(path, compression=None) as stream:
            try:
                for r in read_archive(stream.read):
                    kind = r.headers.get("warc-type")
                    revisit = kind == "revisit"
                    stated = r.headers.get("x-payload-length", "")
                    yield {
                        "page_id": _page(r.headers.get("warc-record-id")), "record_type": kind, "url": r.headers.get("warc-target-uri"),
                        "payload_bytes": int(stated) if revisit and stated.isdigit() else r.payload_bytes,
                        "payload_digest": r.headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(r.payload_sha1),
                        "refers_to": _page(r.headers.get("warc-refers-to")) if revisit else None, "archive": uri, "problem": r.problem,
                    }
            except WarcError as error:
                yield {"archive": uri, "problem": str(error)}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        names = [c.split()[0] for c in RECORDS.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held: list[dict] = []
                for row in rows(uri):
                    held.append(row)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    ship(archives.sparkSession)
    return dealt(archives.select("archive"), "archive").mapInArrow(read, RECORDS)
