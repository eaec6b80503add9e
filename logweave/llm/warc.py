"""Web archives compressed with a dictionary of their own (operator 11).

A page becomes a WARC 1.1 record: ``response`` with its payload, or
``revisit`` without, where a page with a smaller id has an equal payload of at
least ``REVISIT_BYTES``. An archive is a file::

    skippable frame 0x184D2A5D   the Zstandard dictionary of this archive
    a Zstandard frame for each record, compressed by that dictionary
    skippable frame 0x184D2A50   one byte, the line end of Spark's text writer

The dictionary is built from the records of its archive: records spread evenly
over it, of ``SAMPLE`` times the dictionary's size in all (a parameter of the
compression only: every record is written whole, and reads back whatever the
dictionary). Where there are too few records to train one, the beginnings of
the records are the dictionary, as raw content.

Which page is the response is found on rows without payloads (digest, id,
number of equal rows). The payloads are shuffled once, after equal rows have
been put together in each task: by digest and id, so that a group of copies
spreads. A task fills archive after archive of ``ARCHIVE_BYTES``, holding one at
a time; Spark's writer writes them, a file each, so a lost executor's files are
written again and any file system that Spark reaches will do.

Edge cases: a null html is empty; a null page_id comes after all others, a
null url after others of its id; of equal rows with copies one is the response
and the others revisit it; rows of one id and payload but other urls are ordered
by url; a null id, which a revisit may refer to, reads back as null; control
characters of a url are percent-encoded; a page larger than an archive has
an archive of its own; an empty table writes no archive; other columns aren't
written.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, scratch, small_batches, text_of

#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 100
#: Bytes of records in an archive.
ARCHIVE_BYTES = 32 << 20
#: Largest dictionary; SAMPLE bytes of records are read for each byte of it.
DICTIONARY_BYTES, SAMPLE = 112640, 100
LEVEL = 3
#: Equal rows that one task writes out.
COPIES = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME, END_FRAME, SKIPPABLE = 0x184D2A5D, 0x184D2A50, 0x184D2A5
FRAME = struct.Struct("<II")
END = b"\r\n\r\n"
STEP = 1 << 16


def record_id(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    """The record's name, made of what tells it apart from all others."""
    page = F.coalesce(F.concat(F.lit("="), F.url_encode(page.cast("string"))), F.lit("-"))
    url = F.substring(F.md5(F.coalesce(F.concat(F.lit("="), url), F.lit("-"))), 1, 16)
    return F.concat_ws(":", F.lit("urn:x-page"), page, digest, url, copy.cast("string"))


def page_of(name: str | None) -> str | None:
    """The page id in a record's name."""
    page = name.split(":")[2] if name else "-"
    return unquote_plus(page[1:]) if page[0] == "=" else None


def record(name: str, url: str | None, digest: str, size: int, refers_to: str | None, payload: str | None, date: str = DATE) -> bytes:
    """A WARC record: a revisit if it refers to another, else a response."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    body = b"" if refers_to else (payload or "").encode()
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return b"".join(("\r\n".join(head).encode(), END, http, body, END))


def headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode().split("\r\n")
    return first, {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """``(headers, bytes of the payload, payload)`` of a record, lengths and
    the digest of a payload verified."""
    head, rest = data.split(END, 1)
    version, named = headers(head)
    length = int(named["content-length"])
    if not version.startswith("WARC/") or rest[length:] != END:
        raise ValueError("no whole WARC record")
    http, payload = rest[:length].split(END, 1)
    size = int(headers(http)[1]["content-length"])
    digest = named["warc-payload-digest"].removeprefix("sha256:")
    if named["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"wrong payload of {named['warc-record-id']}")
    return named, size, payload


def dictionary(records: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """The dictionary for these records."""
    total = sum(map(len, records))
    size = min(most, max(1024, total // SAMPLE))
    every = max(1, -(-total // (SAMPLE * size)))
    sample = records[::every]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short records
        return b"".join(x[:1 + size // len(sample)] for x in sample)[:size]


def pack(records: list[bytes], level: int = LEVEL) -> bytes:
    """An archive, but for the last byte, which the writer adds."""
    content = dictionary(records)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
    return b"".join((FRAME.pack(DICTIONARY_FRAME, len(content)), content, *map(press.compress, records), FRAME.pack(END_FRAME, 1)))


def unpack(data: memoryview | bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, record)`` of the records of an archive."""
    data, at, press = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = FRAME.unpack_from(data, at)
        if magic >> 4 == SKIPPABLE:
            if at + FRAME.size + size > len(data):
                raise ValueError(f"the frame at {at} is cut off")
            if magic == DICTIONARY_FRAME and at == 0:
                press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[FRAME.size:FRAME.size + size])))
            at += FRAME.size + size
            continue
        begin, frame, parts = at, press.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError(f"the frame at {begin} is cut off")
            parts.append(frame.decompress(data[at:at + STEP]))
            at += STEP
        at = min(at, len(data)) - len(frame.unused_data)
        yield begin, at - begin, b"".join(parts)


def records_of(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``(name, url, digest, size, refers_to, payload)`` of every record."""
    keyed = pages.select(F.struct(F.col(page).isNull(), F.col(page).alias("page"), F.col(url).isNull(), F.col(url).alias("url")).alias("id"),
                         text_of(html).alias("payload"))
    keyed = keyed.select("id", "payload", F.octet_length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("digest"))
    # one row for each kind of equal rows, without the payload if that is long
    short = F.when(F.col("size") < least, F.col("payload")).alias("payload")
    rows = cut_lineage(keyed.select("id", "digest", "size", short).groupBy("id", "digest", "size", "payload").agg(F.count(F.lit(1)).alias("n")))
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("all"))
    groups = cut_lineage(groups.where("all > 1").select("digest", "first"))
    # the copies of all groups: a join of two written tables, so that a large group is split
    copies = cut_lineage(rows.where(F.col("size") >= least).join(groups, "digest")
                         .select("id", "digest", "size", "first", (F.col("id") == F.col("first")).cast("int").alias("begin"), "n").where("n > begin"))

    def name(of: Column, copy: Column) -> Column:
        return record_id(of["page"], of["url"], F.col("digest"), copy)

    none = F.lit(None).cast("string")
    refers = name(F.col("first"), F.lit(0))
    slim = copies.select("id", "digest", "size", refers.alias("refers_to"), none.alias("payload"), "begin", "n").unionAll(
        rows.where(F.col("size") < least).select("id", "digest", "size", none, "payload", F.lit(0), "n"))
    slim = (slim.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}")))).repartition("id", "digest", "part")
            .withColumn("copy", F.explode(F.sequence(F.greatest(F.col("begin"), F.col("part") * COPIES),
                                                     F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1))))
    # long payloads that no other page had before: one for each kind of equal rows, then without the copies
    whole = keyed.where(F.col("size") >= least).groupBy("id", "digest", "size").agg(F.any_value("payload").alias("payload"))
    whole = whole.join(copies.where("begin = 0").select("id", "digest"), ["id", "digest"], "left_anti")
    out = whole.select("id", "digest", "size", none.alias("refers_to"), "payload", F.lit(0).alias("copy")).unionAll(
        slim.select("id", "digest", "size", "refers_to", "payload", "copy"))
    return out.select(name(F.col("id"), F.col("copy")).alias("name"), F.col("id.url").alias("url"), "digest", "size", "refers_to", "payload")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> None:
    """Write the archives of ``pages`` below ``path``."""
    small_batches(pages)
    names = ["name", "url", "digest", "size", "refers_to", "payload"]

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["archive"])

        held: list[bytes] = []
        size = 0
        for batch in batches:
            for values in zip(*(batch.column(n).to_pylist() for n in names)):
                held.append(record(*values))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    found = records_of(pages, **columns).mapInArrow(archives, "archive binary")
    # the text writer writes a string's bytes as they are, and a line end, which is the content of the last frame
    found.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``(file, offset, length, name, page_id, url, record_type,
    payload_bytes, payload_digest, refers_to)`` of every record of the archives
    below ``path``, ids as text; with ``payload`` (null of a revisit) if asked
    for. A record can be fetched alone by its offset and length and the
    dictionary at the file's beginning. A task reads a whole archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")
    schema = ("file string, offset bigint, length bigint, name string, page_id string, url string, record_type string, payload_bytes bigint, "
              "payload_digest string, refers_to string" + ", payload binary" * payloads)
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                found: list[tuple] = []
                held = 0
                for offset, length, data in unpack(content.as_buffer()):
                    named, size, payload = parse(data)
                    name, refers = (named[k][1:-1] if k in named else None for k in ("warc-record-id", "warc-refers-to"))
                    row = (file, offset, length, name, page_of(name), named.get("warc-target-uri"), named["warc-type"], size,
                           named["warc-payload-digest"].removeprefix("sha256:"), page_of(refers) if refers else None)
                    found.append((*row, payload if named["warc-type"] == "response" else None) if payloads else row)
                    held += len(payload) if payloads else 0
                    if len(found) >= 1024 or held >= 4 << 20:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    return files.mapInArrow(scan, schema)


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives (below the shared folder, if ``path`` is None); what
    is read back from them."""
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
