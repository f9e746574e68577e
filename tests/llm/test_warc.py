import hashlib
import struct

import zstandard

from inkstone.llm import warc

SCHEMA = "page_id bigint, url string, html string, sha256 string, n int, `a.b` string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1, "x") for i, u, h in rows], SCHEMA)


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        data, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        revisit = len(data) >= 1000 and len({*groups[h or ""]}) > 1 and i != max(ids)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


BIG, LONG = "é" * 500, "<p>" + "x" * 400_000
ROWS = [(1, "http://a", BIG), (5, None, BIG), (3, "http://a b\r\nX: y", BIG), (2, "u", "é" * 499), (4, "u", "é" * 499), (6, "u", None),
        (7, "u", ""), (8, "u", LONG), (9, "u", LONG), (9, "u", LONG), (None, "u", BIG), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 90), (11, "u", "z" * 1000)]


def test_records_read_back(spark):
    path = warc.write(pages(spark, ROWS))
    out = warc.read(spark, path)
    assert got(out) == expected(ROWS)
    payloads = {(r.page_id, bytes(r.payload).decode()) for r in out.filter("record_type = 'response'").collect()}
    assert payloads == {(i, h or "") for (i, _, h) in ROWS for e in expected(ROWS) if e[0] == i and e[3] == "response"}
    assert out.filter("page_id = 5").first().url is None
    assert out.filter("page_id = 3").first().url == "http://a%20b%0D%0AX:%20y"


def test_hot_payload(spark):
    rows = [(i, "u", "h" * 1200) for i in range(2500)] + [(i, "u", f"{i}" * 400) for i in range(2500, 3000)]
    assert got(warc.read(spark, warc.write(pages(spark, rows)))) == expected(rows)


def test_empty_table(spark):
    assert warc.read(spark, warc.write(pages(spark, []))).count() == 0


def test_one_record_and_bundle_layout(spark, monkeypatch):
    from inkstone.llm.common import store
    path = warc.write(pages(spark, ROWS + [(i, "u", f"page {i} " * 3000) for i in range(100, 130)]))
    index = spark.read.schema(warc.INDEX).parquet(f"{path}/index")
    one = index.filter("page_id = 117")
    assert [bytes(r.payload).decode() for r in warc.read(spark, path, one.select("record_id")).collect()] == ["page 117 " * 3000]
    disk, folder = store(path)
    frames_seen = 0
    for name in {r.file for r in index.collect()}:
        data = disk.open_input_file(f"{folder}/data/{name}").read()
        n, descriptor, magic = struct.unpack("<IBI", data[-9:])
        assert magic == 0x8F92EAB1 and descriptor == 0
        at = len(data) - 9 - 8 * n - 8
        assert struct.unpack("<II", data[at:at + 8]) == (0x184D2A5E, 8 * n + 9)
        entries, pos, whole = struct.unpack(f"<{2 * n}I", data[at + 8:-9]), 0, b""
        for c, d in zip(entries[::2], entries[1::2]):  # every frame stands alone
            plain = zstandard.ZstdDecompressor().decompress(data[pos:pos + c])
            assert len(plain) == d and plain.startswith(b"WARC/1.1\r\n")
            whole, pos = whole + plain, pos + c
        assert pos == at
        frames_seen += n
        # a plain stream reader passes over the seek table
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        assert reader.read(len(whole) + 1) == whole
    assert frames_seen > 3
