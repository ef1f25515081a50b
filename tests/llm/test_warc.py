import base64
import gzip
import hashlib
import io
import zlib

import pyarrow.fs
import pytest
from pyspark.errors import PythonException

from shelfwise.llm import warc

PAGES = [(5, "http://a/x y", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, None, "<p>one</p>"), (2, "http://c", None), (4, "http://d", ""), (7, "u\r\nWARC-Type: evil", "\r\n\r\nWARC/1.1\r\n\r\n"),
         (None, "n", "<p>one</p>"), (None, "n", "alone"), (None, "n", "pair"), (None, "n", "pair"), (8, "l", "é中" * 300_000), (11, "same", "twice"), (11, "same", "twice"), (12, "same", "twice")]


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages, least_bytes=0):
    rows = []
    for page, _, html in pages:
        data = (html or "").encode()
        equal = [p for p, _, h in pages if (h or "").encode() == data and p is not None] if len(data) >= least_bytes else []
        first = min(equal, default=page)
        rows.append((page, len(data), sha(data), *(("response", None) if page == first else ("revisit", first))))
    return sorted(rows, key=repr)


def frame(spark, pages=PAGES):
    return spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, least int, key string")


def collected(records):
    return sorted(((int(r.page_id) if r.page_id is not None else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in records), key=repr)


def test_round_trip(spark):
    for least_bytes in (0, 5):
        manifest = warc.archive(frame(spark), least_bytes=least_bytes)
        read = warc.read(manifest, keep_payload=True).filter("record_type <> 'warcinfo'")
        records = read.collect()
        assert collected(records) == expected(PAGES, least_bytes) and all(r.digest_ok for r in records)
        assert sum(r.records for r in manifest.collect()) == len(PAGES)
        stored = {r.page_id: bytes(r.payload) for r in records if r.record_type == "response" and r.page_id}
        assert stored["8"] == PAGES[10][2].encode() and stored["7"] == PAGES[5][2].encode()
        assert all(r.payload is None for r in records if r.record_type == "revisit")
        assert warc.unresolved(read).count() == 0
        assert warc.unresolved(read.filter("page_id <> '3' OR page_id IS NULL")).count() == (3 if least_bytes <= 10 else 0)


def test_empty_table_writes_nothing(spark):
    manifest = warc.archive(frame(spark).limit(0))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


def test_archives_roll_over_and_hold_one_member_a_record(spark):
    manifest = warc.archive(frame(spark).coalesce(1), archive_bytes=600).collect()
    assert len(manifest) > 3
    for row in manifest:
        store, path = pyarrow.fs.FileSystem.from_uri(row.path)
        data = store.open_input_stream(path, compression=None).read()
        assert len(data) == row.bytes
        plain, members = gzip.decompress(data), 0
        while data:
            z = zlib.decompressobj(31)
            one = z.decompress(data)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and one in plain
            data, members = z.unused_data, members + 1
        assert members == row.records + 1  # and the archive's own


class Trickle(io.BytesIO):
    def read(self, size=-1):
        return super().read(min(size, 3))


def archive(*members):
    return b"".join(members)


def test_reader_by_small_pieces():
    data = archive(warc.member("warcinfo", [], b"x"), warc.page_member("1", "u", b"\r\n\r\n" * 50_000, None), warc.page_member("a b", None, b"p", "1"))
    info, one, two = warc.read_stream(Trickle(data), keep_payload=True)
    assert (info.kind, info.block_bytes) == ("warcinfo", 1)
    assert (one.payload, one.payload_bytes, one.payload_digest, one.digest_ok) == (b"\r\n\r\n" * 50_000, 200_000, sha(b"\r\n\r\n" * 50_000), True)
    assert (two.kind, two.payload_bytes, two.payload_digest, two.payload) == ("revisit", 1, sha(b"p"), None)


def packed(text):
    return gzip.compress(text)


def test_damage_is_found():
    good = warc.page_member("1", "u", b"payload", None)
    changed = packed(gzip.decompress(good).replace(b"payload", b"paXload"))
    assert [r.digest_ok for r in warc.read_stream(io.BytesIO(good + changed + good))] == [True, False, True]
    plain = gzip.decompress(good)
    size = len(plain.split(b"\r\n\r\n", 1)[1]) - 4
    length = f"Content-Length: {size}".encode()
    for bad in (good[:-9], good[:20], good + b"junk", packed(plain[:-1]), packed(plain + b"x"), packed(b"HTTP/1.1 200 OK\r\n\r\n"), packed(b"WARC/1.1\r\n"),
                packed(plain.replace(length, b"Content-Length: 9999")), packed(plain.replace(length, b"Content-Length: -1")), packed(plain.replace(length, b"Content-Length: 3"))):
        with pytest.raises(ValueError):
            list(warc.read_stream(io.BytesIO(bad)))


def test_damaged_archive_stops_the_read_with_its_path(spark, tmp_path):
    path = tmp_path / "broken.warc.gz"
    path.write_bytes(warc.page_member("1", "u", b"payload", None)[:-4])
    with pytest.raises(PythonException, match="broken.warc.gz"):
        warc.read(spark.createDataFrame([(str(path),)], "path string")).collect()
