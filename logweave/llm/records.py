"""Token ids as length-delimited binary records (operator 7).

A file is a sequence of frames, one for each document, in ascending order of
``doc_id`` within and across files::

    u64  length of the payload            (little-endian, as all numbers)
    u32  masked CRC-32 of these 8 bytes
    payload: u8 bytes of an id (2 or 4), u8 kind of doc_id (0 none, 1 number,
             2 text), i64 doc_id or the bytes of its text, that text, the ids
    u32  masked CRC-32 of the payload
    u8   10

A masked checksum is the CRC rotated right by 15 bits plus a constant, so the
CRC of data that holds checksums stays meaningful. A separate table, the
index, has the file, offset and length of every record, so that a reader can
fetch records in any order.

The documents are dealt out by ranges of (doc_id, hash of the text), sorted,
encoded and framed in one pass; Spark's own writer writes the frames, so any
file system that Spark reaches will do and a lost executor's files are written
again. No file, record list or vocabulary passes the driver.

The tokenizer drops white space and never joins characters across it, so the
encoding of a text is that of its words (split at ASCII white space) one after
the other; a task encodes a distinct piece of a word once.

Edge cases: a null or empty text has the end id only; ids that aren't whole
numbers are written as text and ordered so; null ids come first;
rows with equal ids stand in order of their text's hash, equal rows are each
written; an empty table gives no records; other columns aren't written.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logweave.llm.common import cut_lineage, scratch, small_batches, text_of

END_ID = 2
FILES_A_TASK = 1 << 20
#: Bytes of text that go to a file.
FILE_BYTES = 32 << 20
#: Distinct words, and pieces of words, whose ids a Python worker remembers.
REMEMBERED = 1 << 19
HEAD, META, TAIL = struct.Struct("<QI"), struct.Struct("<BBq"), struct.Struct("<IB")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | str | None, ids: bytes, width: int) -> bytes:
    if isinstance(doc_id, str):
        name = doc_id.encode()
        payload = META.pack(width, 2, len(name)) + name + ids
    else:
        payload = META.pack(width, doc_id is not None, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, TAIL.pack(masked_crc(payload), 10)))


def unframe(data: memoryview | bytes, offset: int = 0) -> tuple[int | str | None, np.ndarray, int]:
    """``(doc_id, ids, offset of the next record)`` of the record at
    ``offset``; raises if a checksum is wrong."""
    length, crc = HEAD.unpack_from(data, offset)
    if masked_crc(bytes(data[offset:offset + 8])) != crc:
        raise ValueError(f"wrong checksum of the length at {offset}")
    begin = offset + HEAD.size
    payload = bytes(data[begin:begin + length])
    crc, end = TAIL.unpack_from(data, begin + length)
    if len(payload) != length or masked_crc(payload) != crc or end != 10:
        raise ValueError(f"wrong checksum of the record at {offset}")
    width, kind, doc_id = META.unpack_from(payload)
    at = META.size
    if kind == 2:
        at += doc_id
        doc_id = payload[META.size:at].decode()
    ids = np.frombuffer(payload[at:], dtype=f"<u{width}").astype("<u4")
    return doc_id if kind else None, ids, begin + length + TAIL.size


#: The steps before the BPE model of the word tokenizer, as its file states them.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed",
         "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: What they come to for words of printable ASCII and the accented Latin-1 letters: lower case, cut by the same pattern.
OTHER = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable bytes
    of Latin-1 stand for themselves, the others for letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class Remembered(dict):
    """What ``make`` returned for the keys asked for so far; forgets all of it
    when it holds ``REMEMBERED`` of them (the frequent ones soon return)."""

    def __init__(self, make: Callable[[Any], bytes]):
        self.make = make

    def __missing__(self, key: Any) -> bytes:
        value = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts as bytes, by a tokenizer file of the tokenizers library
    that drops white space.

    The library's BPE model takes a quarter of the time of a call to its whole
    tokenizer. So if the file's steps before the model are ``STEPS``, words of
    common letters (that spell no special token) are cut here and their pieces
    given to the model; other words go through the whole tokenizer."""

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.end = self.pack([end_id])
        stated = json.loads(self.tokenizer.to_str())
        special = "|".join(re.escape(t["content"]) for t in stated["added_tokens"]) or "(?!)"
        self.other = re.compile(f"{OTHER.pattern}|{special}" if all(stated[k] == v for k, v in STEPS.items()) else "(?s:.)")
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.pieces = Remembered(self.of_piece)
        self.words = Remembered(self.of_word)

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def of_piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(piece)])

    def of_word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.other.search(text):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        found = PIECE.findall(text.lower())
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """The ids of a text and the end id. (Bytes split at ASCII white space.)"""
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split())) + self.end


@functools.lru_cache(maxsize=2)
def encoder_of(vocabulary: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(vocabulary, end_id)


def key_type(docs: DataFrame, key: str) -> str:
    """How ids are written: whole numbers as such, others as text."""
    return "bigint" if isinstance(docs.schema[key].dataType, T.IntegralType) else "string"


def write_records(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                  end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Write the files below ``path``."""
    small_batches(docs)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    rows = docs.select(F.col(key).cast(key_type(docs, key)).alias("doc_id"), F.xxhash64(text).alias("tie"), text_of(text).alias("text"))
    order = [F.col("doc_id"), F.col("tie")]
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, end_id)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            frames = [frame(d, encoder.encode(t), encoder.width) for d, t in zip(batch.column("doc_id").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = rows.mapInArrow(encode, "frame binary")
    # the text writer writes a string's bytes as they are; the frame's last byte is its line end
    frames.select(F.expr("substring(frame, 1, octet_length(frame) - 1)").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def read_index(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """``(file_no, file, offset, length, before, doc_id, n_tokens, ids_crc32)``
    of every record of the files below ``path``, all checksums verified;
    ``before`` counts the ids before it in its file, ``file_no`` orders the
    files: a task's number and which of its files it is. ``key`` is the type of
    the ids. A task reads a whole file, whose size ``file_bytes`` bounds."""
    task, which = (F.coalesce(F.regexp_extract("path", p, 1).try_cast("bigint"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)[^/]*$"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        (task * FILES_A_TASK + which).alias("file_no"), F.col("path").alias("file"), "content")
    schema = f"file_no bigint, file string, offset bigint, length bigint, before bigint, doc_id {key}, n_tokens bigint, ids_crc32 bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = memoryview(batch.column("content")[row].as_buffer())
                offset = before = 0
                found: list[tuple] = []
                while offset < len(data):
                    doc_id, ids, end = unframe(data, offset)
                    found.append((offset, end - offset, before, doc_id, len(ids), zlib.crc32(ids.tobytes())))
                    offset, before = end, before + len(ids)
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[row].as_py()] * len(found), t) for c, t in (("file_no", pa.int64()), ("file", pa.string()))]
                    + [pa.array(c, pa.string() if i == 3 and key == "string" else pa.int64()) for i, c in enumerate(columns)],
                    names=["file_no", "file", "offset", "length", "before", "doc_id", "n_tokens", "ids_crc32"])

    return files.mapInArrow(scan, schema)


def read_records(spark: SparkSession, path: str, index: DataFrame, seed: int | None = None) -> DataFrame:
    """``(doc_id, ids)`` of the records that ``index`` (rows of
    :func:`read_index`) names, in a random order by ``seed`` if given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")
    wanted = index.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # of one file of bounded size

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist()):
                got = [unframe(memoryview(content.as_buffer()), o) for o in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], id_type),
                                                  pa.array([g[1].astype(np.int64) for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    key = index.schema["doc_id"].dataType
    id_type = to_arrow_type(key)
    out = files.join(wanted, "file").select("content", "offsets").mapInArrow(fetch, f"doc_id {key.simpleString()}, ids array<bigint>")
    return out if seed is None else out.orderBy(F.xxhash64(F.lit(seed), "doc_id", "ids"))


def write_and_index(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Write the files (below the shared folder, if ``path`` is None) and the
    index beside them; the index read back, with ``start``, the ids of all
    records before (running sums over the table of files)."""
    spark = docs.sparkSession
    path = path or scratch(spark, "records")
    write_records(docs, f"{path}/records", vocabulary, **options)
    read_index(spark, f"{path}/records", key_type(docs, options.get("key", "doc_id"))).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    sums = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(sums.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return index.join(base, "file_no").withColumn("start", F.col("base") + F.col("before")).drop("base")
