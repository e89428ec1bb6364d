"""Operator 3: WARC archives in Zstandard, written and read back.

An archive file is a leading skippable frame that holds the dictionary, then
for each record one frame that holds that record alone.  Spark's text writer
ends each row with a line feed; every frame is therefore followed by the header
of a one-byte skippable frame, whose one byte is that line feed.  So archives
are written by Spark's own committer into any store it can write to, and each
file is a valid concatenation of Zstandard frames.

The reader takes whole files (``binaryFile``), loads the dictionary, decodes one
frame at a time, and checks the WARC version line, the named fields, both
lengths, the digest and that nothing follows the record in its frame.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with
the smallest page id is the response and the others are revisits that refer to
it; smaller payloads are responses.

Defined cases: a null payload is empty; a page with a null id, or that repeats
an id, gets a record of its own (a null id never is the smallest; equal ids of
equal payloads are ordered by nothing and all rows of the smallest id are
responses); a null url is an empty target; an empty table gives no archives and
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import Workspace

# Fixed values of the Zstandard and WARC formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"

#: Payloads below so many bytes are never revisits.
LEAST_REVISIT = 100
#: Digests that are broadcast, at most (about 20 MB).
MOST_SENT = 200_000
#: Pages that the dictionary is trained on, at most, and bytes taken of each.
DICTIONARY_PAGES = 500
DICTIONARY_SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 32_768
#: Payload bytes that an archive file is meant to hold.
ARCHIVE_BYTES = 32 << 20
#: Payload bytes that a step of the writer holds as Python objects.
STEP_BYTES = 8 << 20
#: Frame that takes up the writer's line feed.
_PAD = struct.pack("<II", 0x184D2A50, 1)


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    """The record of one frame, its header lines and length checked."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("a record's header does not end")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC version: {first[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a named field: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError(f"not a length: {headers['content-length']!r}")
    n = int(headers["content-length"])
    block, rest = data[end + 4 : end + 4 + n], data[end + 4 + n :]
    if len(block) != n or rest != b"\r\n\r\n":
        raise WarcError(f"a block of {n} bytes was announced, {len(data) - end - 8} are there")
    return Record(headers, block)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and its blocks' sizes."""
    head = data[at : at + 18]
    try:
        end = at + zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"a frame's header at byte {at} cannot be read: {e}") from e
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError("an archive ends inside a frame")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(block & 1), (block >> 1) & 3, block >> 3
        if kind == 3:
            raise WarcError(f"a block at byte {end} has no known type")
        end += 3 + (1 if kind == 1 else size)  # a block of one repeated byte holds it once
    end += 4 if checksum else 0
    if end > len(data):
        raise WarcError("an archive ends inside a frame")
    return end


def frames(data: bytes) -> Iterator[bytes]:
    """The records' decoded frames of an archive, one at a time."""
    at, dictionary, leading = 0, None, True
    view = memoryview(data)
    decoder = None
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("an archive ends inside a frame's header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise WarcError("an archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and leading:
                raw = bytes(view[at + 8 : at + 8 + size])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
            elif magic == DICTIONARY_MAGIC:
                raise WarcError("a dictionary frame that does not lead")
            at += 8 + size
            leading = False
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame starts at byte {at}")
        leading = False
        if decoder is None:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        end = frame_end(data, at)
        one = decoder.decompressobj()
        try:
            out = one.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame at byte {at} cannot be read: {e}") from e
        if not one.eof or one.unused_data:
            raise WarcError(f"the frame at byte {at} does not end at byte {end}")
        at = end
        yield out


_DIGEST = re.compile(r"[0-9a-f]{64}")


def record_id(page: int | None, digest: str, again: int = 0) -> str:
    """Record name of a page's response (``again`` 0) or of its later revisits."""
    ident = hashlib.sha256(f"{page}|{digest}|{again}".encode()).hexdigest()
    return f"<urn:uuid:{ident[:8]}-{ident[8:12]}-{ident[12:16]}-{ident[16:20]}-{ident[20:32]}>"


def _read_page(record: Record) -> tuple:
    """(page id, payload bytes, digest, type, refers to) of a record, checked."""
    h = record.headers
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    page = int(h["x-page-id"]) if "x-page-id" in h else None
    if not _DIGEST.fullmatch(digest):
        raise WarcError(f"not a digest: {digest!r}")
    if h["warc-type"] not in ("response", "revisit"):
        raise WarcError(f"not a type this reader knows: {h['warc-type']!r}")
    head, blank, payload = record.block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/1.1 "):
        raise WarcError("a record without an HTTP header")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if length != int(h.get("x-payload-length", -1)):
        raise WarcError(f"a payload of {length} bytes in the HTTP header, {h.get('x-payload-length')} in the record's")
    if h["warc-type"] == "revisit":
        if payload:
            raise WarcError("a revisit with a payload")
        refers = h.get("x-refers-to-page-id")
        if not refers or h.get("warc-refers-to") != record_id(int(refers), digest):
            raise WarcError("a revisit that does not name its response's record")
        return page, length, digest, "revisit", int(refers)
    if length != len(payload):
        raise WarcError(f"a payload of {length} bytes was announced, {len(payload)} are there")
    if hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("a payload does not have its digest")
    return page, len(payload), digest, "response", None


def train_dictionary(pages: DataFrame, html: str) -> bytes:
    """Dictionary from the beginnings of at most ``DICTIONARY_PAGES`` pages."""
    some = pages.select(F.substring(F.col(html), 1, DICTIONARY_SAMPLE_BYTES).alias("h")).filter(F.length("h") > 0).limit(DICTIONARY_PAGES)
    samples = [r.h.encode("utf-8", "surrogatepass")[:DICTIONARY_SAMPLE_BYTES] for r in some.collect()]
    if sum(map(len, samples)) < 64_000 or len(samples) < 16:
        return b"".join(samples)[:DICTIONARY_BYTES]  # a raw content dictionary
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def decide(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): a response has its payload, a revisit refers_to.

    The digests that occur more than once are found first, from digests alone,
    with partial minima before the shuffle.  If there are at most ``MOST_SENT``
    of them they are broadcast, so that payloads are not shuffled for the join;
    beyond that Spark joins by shuffle and splits a digest that many pages share.
    """
    work = Workspace(pages.sparkSession, "warc-digests")
    one = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    one = one.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    pages_of = one.filter(F.col("size") >= LEAST_REVISIT).groupBy(F.col("digest").alias("d"), "page_id").agg(F.count("*").alias("twins"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "twins")))
    again = pages_of.groupBy("d").agg(first.alias("f"), F.sum("twins").alias("n")).filter("n > 1").select("d", F.col("f.page_id").alias("least"), F.col("f.twins").alias("twins"))
    again = work.save(again, "again")
    few = again.limit(MOST_SENT + 1).count() <= MOST_SENT
    small = one.join(F.broadcast(again) if few else again, one.digest == again.d, "left")
    small = small.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")))
    if not again.filter("twins > 1").isEmpty():
        # The smallest id itself is repeated: one of its rows is the response, as
        # many as are left are revisits of it.
        twin = (F.col("twins") > 1) & F.col("page_id").eqNullSafe(F.col("least"))
        rows = small.filter(twin).groupBy("digest", "page_id").agg(F.min("url").alias("url"), F.first("payload").alias("payload"), F.first("size").alias("size"), F.count("*").alias("twins"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("twins"))).alias("k")).withColumn("refers_to", F.when(F.col("k") > 1, F.col("page_id")))
        kept = ["page_id", "url", "payload", "size", "digest", "refers_to"]
        small = small.filter(~F.coalesce(twin, F.lit(False))).select(kept).unionByName(rows.select(kept))
    return small.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows whose payloads have at most ``STEP_BYTES``, or one row."""
    sizes = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("payload"))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + STEP_BYTES, "right")))
        yield lo, hi
        lo = hi


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every page to archives under ``path``."""
    dictionary = train_dictionary(pages, html)
    total = pages.agg(F.sum(F.octet_length(F.col(html)))).first()[0] or 0
    files = max(1, -(-total // archive_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True) if shared else zstandard.ZstdCompressor(level=level, write_checksum=True)
        begun = False
        for batch in batches:
            for lo, hi in _steps(batch):
                out = []
                if not begun:
                    begun = True
                    if dictionary:
                        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + _PAD)
                for page, target, payload, size, digest, refers in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns), strict=True):
                    target = (target or "").replace("\r", "%0D").replace("\n", "%0A")
                    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, digest, int(refers is not None))), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
                    if page is not None:
                        head.append(("X-Page-ID", str(page)))
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    if refers is None:
                        head.append(("Content-Type", "application/http; msgtype=response"))
                        record = build(head, http + payload)
                    else:
                        head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page-ID", str(refers))]
                        record = build(head, http)
                    out.append(coder.compress(record) + _PAD)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = decide(pages, key, url, html).repartition(files, "digest", "page_id")
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, key_type: T.DataType | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                data = batch.column(0)[i].as_buffer().to_pybytes()
                rows = [_read_page(parse(f)) for f in frames(data)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back."""
    spark = pages.sparkSession
    path = Workspace(spark, "warc").path("archives")
    write(pages, path, key, url, html)
    return read(spark, path)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     m AS (SELECT payload_digest, min(page_id) AS least FROM d GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.payload_bytes < {LEAST_REVISIT} OR d.page_id = m.least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.payload_bytes < {LEAST_REVISIT} OR d.page_id = m.least THEN NULL ELSE m.least END AS refers_to
FROM d JOIN m USING (payload_digest)
"""
