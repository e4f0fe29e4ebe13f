"""WARC archives with revisit records for equal payloads.

Headers (id, digest, size) alone are shuffled by payload digest; the largest id of a digest becomes the
response, the others revisit it. Their decisions are joined back by (id, digest), a unique key, and the
archives are written with fresh headers: Spark's text writer takes one record a row, and its line separator
is the two line ends that close a record, so commits, retries and remote stores are Spark's. Records are dealt
to as many files as hold ``FILE_BYTES`` of payload each on average.

``read`` inflates archives piece by piece, however many gzip members they have (one a file, one a record, or any),
and parses records by Content-Length, so a task holds a file as it is stored and one record. ``resolve`` joins
revisit records to their responses.

Defined cases: records of other types, and responses without a digest or with one in base 32, are read as well; an
archive that breaks off, or a payload that doesn't match its digest, is an error; null html is an empty payload; payloads under ``LEAST`` bytes are responses each; rows
repeated with one id and payload are responses each if that id is the largest; rows with a null id are never
referred to and keep a null id; a null url has no target header, and control characters and blanks in one are
escaped; an empty table gives an empty result; further columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import shared_dir, written

LEAST = 1000
#: Bytes of payload a file on average; bytes inflated at once.
FILE_BYTES, PIECE = 1 << 25, 1 << 16
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target string, payload_bytes long, payload_digest string, payload binary"


def record_id(page: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("|", page.cast("string"), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))


def uri(url: Column) -> Column:
    return F.regexp_replace(F.replace(url, F.lit(" "), F.lit("%20")), r"[\x00-\x20\x7F]", "%00")


def headers(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, bytes and digest."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"))


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, response, response_url) of the pages that revisit another."""
    large = heads.where(F.col("bytes") >= least).select("page_id", "url", "digest")
    responses = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = large.select("page_id", "digest").join(responses, "digest").where("page_id < top.page_id")
    return found.select("page_id", "digest", F.col("top.page_id").alias("response"), F.col("top.url").alias("response_url")).distinct()


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One column ``value``: a WARC record a page, without the line ends that close it."""
    heads = headers(pages)
    key = ["page_id", "digest"]
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(partitions, -(-(heads.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES))
    rows = heads.repartition(files, *key).join(revisits(heads, least), key, "left")
    again = F.col("response").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    held = F.when(again, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        header("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", uri(F.col("url"))),
        header("WARC-Page-ID", F.col("page_id")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(again, record_id(F.col("response"), F.col("digest")))),
        header("WARC-Refers-To-Target-URI", F.when(again, uri(F.col("response_url")))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, http, held).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST, compression: str = "gzip") -> None:
    """Archives of ``pages`` below ``path``."""
    records(pages, least).write.option("lineSep", END).option("compression", compression).text(path)


def inflated(archive: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces: those of all its gzip members, or its own if it has none."""
    view = memoryview(archive)
    if archive[:2] != b"\x1f\x8b":
        yield from (bytes(view[at : at + PIECE]) for at in range(0, len(view), PIECE))
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(view), PIECE):
        rest = bytes(view[at : at + PIECE])
        while rest:
            if member.eof:
                member = zlib.decompressobj(31)
            made = member.decompress(rest, 16 * PIECE)
            rest = member.unused_data if member.eof else member.unconsumed_tail
            if made:
                yield made
    if not member.eof:
        raise ValueError("the archive breaks off inside a gzip member")


class _Reader:
    """Takes whole headers and blocks from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive breaks off inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def through(self, mark: bytes) -> bytes | None:
        """What comes up to ``mark``, which goes; None at the end of the archive."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive breaks off inside a header")
                return None
        out = self.take(at + len(mark))
        return out[:at]


def parse(archive: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers by lower-case name, block) of each record."""
    reader = _Reader(inflated(archive))
    while (head := reader.through(b"\r\n\r\n")) is not None:
        if not head:  # line ends between records
            continue
        first, *lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        named = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines)}
        block = reader.take(int(named[b"content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't closed by two line ends")
        yield named, block


def _row(named: dict[bytes, bytes], block: bytes) -> tuple:
    """A row of RECORD."""
    text = lambda name: named[name].decode("utf-8", "replace") if name in named else None
    kind, size, digest, payload = text(b"warc-type"), None, None, None
    if kind == "response":
        http = named.get(b"content-type", b"").startswith(b"application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        size, sha1 = len(payload), hashlib.sha1(payload)
        digest = sha1.hexdigest()
        stated = (text(b"warc-payload-digest") or "").removeprefix("sha1:")
        if stated and stated.lower() not in (digest, base64.b32encode(sha1.digest()).decode().lower()):
            raise ValueError(f"payload of {text(b'warc-record-id')} doesn't match its digest")
    page = text(b"warc-page-id")
    return (int(page) if page is not None else None, kind, text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri"), size, digest, payload)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the archives below ``path``; digests are those of the bytes read. Without ``payloads`` these are null."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found, held = [], 0
                for record in parse(content.as_py()):
                    row = _row(*record)
                    found.append(row if payloads else (*row[:-1], None))
                    held += 1000 + (row[5] or 0) * payloads
                    if held > 4_000_000:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """Records without payloads, revisits with size, digest and page of the response they refer to."""
    responses = found.where("record_type = 'response'").select("page_id", "record_type", "record_id", "payload_bytes", "payload_digest")
    again = found.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to")
    targets = responses.groupBy(F.col("record_id").alias("refers_to")).agg(*[F.first(c).alias(c) for c in ("payload_bytes", "payload_digest")], F.first("page_id").alias("response"))
    joined = again.join(targets, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("response").alias("refers_to"))
    whole = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(joined)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back and resolved."""
    path = shared_dir(pages.sparkSession)
    write(pages, path, least)
    return resolve(written(read(pages.sparkSession, path, payloads=False).drop("payload")))
