"""Web archives: records, dictionaries, revisits, and the way back."""

import glob
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from logweave.llm import warc
from logweave.llm.queries import op11_warc_archives

RNG = random.Random(5)
LONG = ["".join(f"<p class='para'>Some words, number {RNG.randrange(10 ** 6)}, of a page.</p>\r\n\r\n" for _ in range(30)) for _ in range(40)]


def by_hand(rows):
    """``(page, bytes, digest, type, refers to)`` of rows (page, url, html)."""
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page is None, page if page is not None else 0, url is None, url or ""))
    out = []
    for payload, ids in groups.items():
        first = None
        for no_page, page, _, _ in sorted(ids):
            page = None if no_page else page
            digest = hashlib.sha256(payload).hexdigest()
            if len(payload) >= 100 and first is not None:
                out.append((page, len(payload), digest, "revisit", first[0]))
            else:
                out.append((page, len(payload), digest, "response", None))
                first = first or (page,)
    return sorted(out, key=repr)


def read_back(df):
    cols = [F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint")]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


ROWS = [(i, f"http://h{i % 5}.example/{i}?a=b c\n", x) for i, x in enumerate(LONG)]
ROWS += [(100 + i, "http://copy.example/", LONG[7]) for i in range(25)] + [(3, "http://copy.example/", LONG[7])]
ROWS += [(200 + i, "u", None if i % 2 else "") for i in range(6)] + [(300, None, "short"), (301, "u", "short"), (301, "u", "short")]
ROWS += [(None, "u", LONG[1]), (None, None, LONG[1]), (None, None, "only here " * 20), (None, "v", "only here " * 20)]
ROWS += [(400, "u", "same row " * 30)] * 5 + [(401, "u", "ä" * 50), (402, "u", "ä" * 50), (403, "u", "a" * 99), (404, "u", "a" * 99)]
ROWS += [(500, "u", "very long \r\n\r\n" * 200000), (501, "u", "\x00\x01 <!-- \r\n\r\nWARC/1.1 -->" * 9), (502, "ü", "😀" * 30)]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, size int").repartition(3)
    path = str(tmp_path / "w")
    got = warc.archived(df, path, archive_bytes=20000)
    assert read_back(got) == by_hand(ROWS)
    assert got.select("name").distinct().count() == len(ROWS)
    # every revisit refers to a response that is there, of the same payload
    both = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted((r.payload for r in both if r.payload_bytes >= 100 and r.record_type == "response")) == sorted(
        {(h or "").encode() for *_, h in ROWS if len((h or "").encode()) >= 100})
    responses = {(r.page_id, r.payload_digest) for r in both if r.record_type == "response"}
    assert all((r.refers_to, r.payload_digest) in responses and r.payload is None for r in both if r.record_type == "revisit")
    files = glob.glob(path + "/part-*")
    assert len(files) > 5
    for file in files:
        data = open(file, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY_BYTES and data[-9:] == struct.pack("<II", 0x184D2A50, 1) + b"\n"


def test_record_fetched_alone(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    row = warc.archived(df, path).where("page_id = '17'").first()
    data = open(row.file.removeprefix("file:"), "rb").read()
    known = zstandard.ZstdCompressionDict(data[8:8 + struct.unpack_from("<II", data)[1]])
    one = zstandard.ZstdDecompressor(dict_data=known).decompress(data[row.offset:row.offset + row.length])
    assert warc.parse(one)[2].decode() == LONG[17]
    assert b"WARC-Target-URI: http://h2.example/17?a=b%20c%0A\r\n" in one


def test_dictionary_helps_and_is_trained():
    records = [warc.record(f"urn:x-page:={i}:d:u:0", "u", hashlib.sha256(x.encode()).hexdigest(), len(x.encode()), None, x)
               for i, x in enumerate(LONG * 3)]
    content = warc.dictionary(records)
    assert content[:4] == b"\x37\xa4\x30\xec"  # a trained one
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(x)) for x in records)
    assert len(warc.pack(records)) < 0.9 * plain


@pytest.mark.parametrize("records", [[b"WARC/1.1 x"], [b"WARC/1.1 " + b"long" * 10 ** 6], [b"WARC/1.1 a"] * 3, [bytes([i]) * 9 for i in range(65, 90)]])
def test_few_records(records):
    assert [x for *_, x in warc.unpack(warc.pack(records) + b"\n")] == records


def test_damage_is_noticed():
    records = [warc.record(f"urn:x-page:={i}:d:u:0", "u", hashlib.sha256(x.encode()).hexdigest(), len(x.encode()), None, x) for i, x in enumerate(LONG)]
    data = warc.pack(records) + b"\n"
    for at in (len(data) - 100, 2 * len(data) // 3):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        with pytest.raises((zstandard.ZstdError, ValueError)):
            list(warc.unpack(bytes(bad)))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.unpack(data[:-40]))
    with pytest.raises(ValueError, match="wrong payload"):
        warc.parse(records[0].replace(b"Some words", b"Same words", 1))


def test_text_ids_and_empty(spark, tmp_path):
    df = spark.createDataFrame([("a:b c/%", "u", LONG[0]), ("ä", "u", LONG[0]), ("", "u", LONG[1]), (None, "u", LONG[1])],
                               "id string, link string, body string")
    out = warc.archived(df, str(tmp_path / "w"), page="id", url="link", html="body").select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [("a:b c/%", "response", None), ("ä", "revisit", "a:b c/%"),
                                                                  ("", "response", None), (None, "revisit", "")]))
    assert warc.archived(df.limit(0), str(tmp_path / "e"), page="id", url="link", html="body").collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert read_back(op11_warc_archives(spark, sf)) == by_hand(rows)
