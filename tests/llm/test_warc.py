"""Web archives: round trips, damage, retries and odd rows."""

import hashlib
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from uptake.llm import warc

CLASHES = ("body", "digest", "first", "last", "name", "records", "bytes", "archive", "error", "a b.c")
PAGE = "<html>" + "text & more " * 20 + "é𝔘</html>"


def pages(spark, rows):
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    return made.withColumns({c: F.lit("x") for c in CLASHES})


def stored(spark, folder, rows, **options):
    done = warc.write_archives(pages(spark, rows), f"file://{folder}", **options)
    return done, warc.read_archives(spark, f"file://{folder}")


def number(uri):
    part = uri.split(":")[2] if uri else ""
    return int(part) if part else None


ROWS = [
    (5, "http://a.org/1", PAGE), (3, "http://a.org/2", PAGE), (9, None, PAGE), (None, "http://a.org/3", PAGE), (3, "http://a.org/4", PAGE),
    (1, "http://b.org/ x\r\nWARC-Type: y", "short"), (2, "http://b.org/", "short"), (6, "", None), (7, "u", ""), (8, "u", "x" * 99), (10, "u", "x" * 99),
    (11, "u", "y" * 100), (12, "u", "y" * 100), (-4, "u", "é" * 50), (13, "u", "é" * 50), (14, "u", "\r\n\r\nHTTP/1.1 200\r\n\r\n" * 9),
    (15, "u", "long " * 600_000)]


def test_round_trip(spark, tmp_path):
    done, records = stored(spark, tmp_path, ROWS)
    found = records.where("type <> 'warcinfo'").collect()
    assert len(found) == len(ROWS) and sum(r.records for r in done.collect()) == len(ROWS)
    html = {(p, h or "") for p, _, h in ROWS}
    first = {}
    for p, _, h in ROWS:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    for r in found:
        page, digest = number(r.record_id), r.payload_digest.split(":")[1]
        text = next(h for p, h in html if p == page and hashlib.sha256(h.encode()).hexdigest() == digest)
        expected = first.get(text) if page is not None and first.get(text, page) < page else None
        assert (r.type, number(r.refers_to)) == (("revisit", expected) if expected is not None else ("response", None))
        assert r.payload_bytes == len(text.encode()) and r.error is None
        assert (r.payload is None) if expected is not None else (bytes(r.payload) == text.encode())
    assert {number(r.record_id) for r in found if r.type == "revisit"} == {5, 9, 12, 13}
    assert {r.target_uri for r in found if number(r.record_id) == 1} == {"http://b.org/%20x%0D%0AWARC-Type:%20y"}
    assert [r.target_uri for r in found if number(r.record_id) == 9] == [None]


def test_empty_table(spark, tmp_path):
    done, records = stored(spark, tmp_path / "none", [])
    assert done.count() == 0 and records.count() == 0


def test_frames_dictionaries_and_sizes(spark, tmp_path):
    """Several archives of bounded size, each with its dictionary in front and one frame per record."""
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<html><p>{i}</p>" + "<div class='menu'>entry</div>" * 30 + f"{i * i}</html>") for i in range(900)]
    done, records = stored(spark, tmp_path, rows, archive_bytes=200_000)
    assert records.where("type = 'response'").count() == 900 and done.count() >= 4
    total = 0
    for row in done.collect():
        data = (tmp_path / row.name).read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME and len(data) == row.bytes
        trained = zstandard.ZstdDecompressor().decompressobj().decompress(data[8:8 + size])
        assert trained[:4] == struct.pack("<I", warc.DICTIONARY_MAGIC)
        reader, rest, frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)), data[8 + size:], 0
        while rest:
            one = reader.decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n") and one.eof
            rest, frames = one.unused_data, frames + 1
        assert frames == row.records + 1
        total += len(data)
    assert total < 0.2 * sum(len(r[2]) for r in rows)
    assert sorted(os.listdir(tmp_path)) == sorted(["_begun", *(r.name for r in done.collect())])


def archive(path, *records, trained=None, plain=False):
    packer = zstandard.ZstdCompressor(dict_data=trained)
    head = b"" if trained is None else warc.skippable(trained.as_bytes() if plain else zstandard.ZstdCompressor().compress(trained.as_bytes()))
    path.write_bytes(head + b"".join(packer.compress(r) for r in records))


GOOD = [("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Date", "2024-01-01T00:00:00Z")]


@pytest.mark.parametrize("plain", [False, True])
def test_foreign_archives(spark, tmp_path, plain):
    """Dictionaries stored as they are or compressed, other skippable frames, other types of record."""
    trained = zstandard.train_dictionary(4096, [warc.record(GOOD, f"some block {i} of text ".encode() * 9) for i in range(300)])
    archive(tmp_path / "a.warc.zst", warc.record(GOOD, b"one"), warc.record(GOOD, b""), trained=trained, plain=plain)
    packed = (tmp_path / "a.warc.zst").read_bytes()
    (tmp_path / "a.warc.zst").write_bytes(packed + struct.pack("<II", 0x184D2A51, 3) + b"abc")
    archive(tmp_path / "b.warc.zst", warc.record([*GOOD, ("Content-Type", "text/plain"), ("WARC-Payload-Digest", "sha1:ABC")], b"two"))
    (tmp_path / "c.warc.zst").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((bytes(r.payload), r.payload_bytes, r.type) for r in found) == [(b"", 0, "resource"), (b"one", 3, "resource"), (b"two", 3, "resource")]


BROKEN = {
    "version": b"WARC/0.9" + warc.record(GOOD, b"x")[8:], "headers": warc.record(GOOD[:2], b"x"), "no header": warc.record([*GOOD, ("a\r\nbad", "")], b"x"),
    "type": warc.record([("WARC-Type", "odd"), *GOOD[1:]], b"x"), "too long": warc.record(GOOD, b"x") + b"more", "cut": warc.record(GOOD, b"xyz")[:-5],
    "end": warc.record(GOOD, b"x")[:-4] + b"....", "no end": b"WARC/1.1\r\nWARC-Type: resource",
    "length": warc.record(GOOD, b"x").replace(b"Content-Length: 1", b"Content-Length: -1"),
    "block": warc.record([*GOOD, ("WARC-Block-Digest", "sha256:00")], b"x"), "payload": warc.record([*GOOD, ("WARC-Payload-Digest", "sha256:00")], b"x"),
    "http": warc.record([("WARC-Type", "response"), *GOOD[1:], ("Content-Type", "application/http")], b"HTTP/1.1 200\r\nContent-Length: 9\r\n\r\nx"),
    "http end": warc.record([("WARC-Type", "response"), *GOOD[1:], ("Content-Type", "application/http")], b"HTTP/1.1 200\r\n")}


@pytest.mark.parametrize("fault", BROKEN)
def test_damaged_records(spark, tmp_path, fault):
    with pytest.raises(warc.ArchiveError):
        warc.payload(*warc.parsed(BROKEN[fault]))


def test_damage_ends_the_query_or_is_reported(spark, tmp_path):
    good = warc.record(GOOD, b"fine")
    archive(tmp_path / "a.warc.zst", good, *BROKEN.values(), good)
    with pytest.raises(Exception, match="ArchiveError"):
        warc.read_archives(spark, str(tmp_path)).collect()
    found = warc.read_archives(spark, str(tmp_path), strict=False).collect()
    assert len(found) == 2 + len(BROKEN) and sum(r.error is None for r in found) == 2
    # A cut archive gives the records before the cut and a row for the rest.
    data = (tmp_path / "a.warc.zst").read_bytes()
    for cut, junk in ((len(data) - 3, b""), (len(data), b"junk"), (len(data), b"ju")):
        (tmp_path / "a.warc.zst").write_bytes(data[:cut] + junk)
        found = warc.read_archives(spark, str(tmp_path), strict=False).collect()
        assert found[0].error is None and found[-1].error is not None and len(found) >= 2 + len(BROKEN)


def test_what_a_lost_task_left_is_not_read(spark, tmp_path):
    (tmp_path / "_begun").mkdir()
    archive(tmp_path / "_begun" / "left.warc.zst", warc.record(GOOD, b"half"))
    done, records = stored(spark, tmp_path, ROWS[:5])
    assert records.where("type <> 'warcinfo'").count() == 5
    # Placing again, as a second attempt of a lost task does, changes nothing; an archive that is nowhere is an error.
    again = done.mapInArrow(warc._placed(f"file://{tmp_path}/_begun", f"file://{tmp_path}"), done.schema)
    assert again.count() == done.count() and records.count() == 5 + done.count()
    with pytest.raises(Exception, match="is lost"):
        missing = done.select(F.lit("gone").alias("name"), "records", "bytes")
        missing.mapInArrow(warc._placed(f"file://{tmp_path}/_begun", f"file://{tmp_path}"), done.schema).collect()
