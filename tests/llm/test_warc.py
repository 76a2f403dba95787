"""Archives: round trip, revisits, ties, nulls, damaged files, archives of other writers."""

import hashlib
import uuid

import pytest
import zstandard

from siftwell.llm import common, warc

LONG = "<p>" + "many words of a page " * 90 + "</p>"
PAGES = [
    (1, "http://a/1", LONG, 0, "r"),
    (7, "http://a/7", LONG, 0, "r"),
    (3, None, LONG, 0, "r"),
    (7, "http://a/7 again\r\nX: y", LONG, 0, "r"),
    (None, "http://a/null", LONG, 0, "r"),
    (4, "http://a/4", None, 0, "r"),
    (5, "http://a/5", "", 0, "r"),
    (6, "http://a/6", "short", 0, "r"),
    (8, "http://a/8", "short", 0, "r"),
    (9, "http://a/é", "é\r\n\r\n" + "漢\n" * 400_000, 0, "r"),
    ((1 << 63) - 1, "http://a/max", "x" * 999, 0, "r"),
    (-2, "http://a/min", "x" * 999, 0, "r"),
    (11, "http://a/11", "y" * 1000, 0, "r"),
    (12, "http://a/12", "y" * 1000, 0, "r"),
] + [(100 + i, f"http://b/{i}", f"<html><head><title>{i}</title></head><body>" + f"row {i} " * 60 + "</body></html>", 0, "r") for i in range(60)]
SCHEMA = "page_id long, url string, html string, row_key int, payload string"


def folder(spark):
    return f"{common.scratch_dir(spark)}/warc-{uuid.uuid4().hex}"


def written(spark, rows=PAGES, **how):
    path = folder(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, **how)
    return path


def expected(rows):
    """page_id, size, digest, type and refers_to by a plain walk; of equal ids the last row keeps a payload."""
    kept = {}
    for place, (page, _, html, *_) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= 1000:
            kept[body] = max(kept.get(body, (-(1 << 63), -1)), (-(1 << 63) if page is None else page, place))
    out = []
    for place, (page, _, html, *_) in enumerate(rows):
        body = (html or "").encode()
        other = body in kept and kept[body][1] != place
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other else "response", rows[kept[body][1]][0] if other else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"archive_bytes": 1, "with_dictionary": False}, {"archive_bytes": 3000}])
def test_round_trip(spark, how):
    path = written(spark, **how)
    records = common.scratch(warc.read_archives(spark, path), "records")
    found = warc.resolved(records)
    assert found.where("error IS NOT NULL").count() == 0
    pages = found.where("record_type <> 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, pages.collect()), key=repr) == expected(PAGES)
    bodies = {(r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
    assert bodies == {(p, (h or "").encode()) for p, _, h, *_ in PAGES if (h or "") != LONG and (h or "") != "y" * 1000} | {(7, LONG.encode()), (12, b"y" * 1000)}
    uris = {r.target_uri for r in records.collect()}
    assert "http://a/7%20again%0D%0AX:%20y" in uris and "http://a/é" in uris
    if how:
        assert records.select("archive").distinct().count() > 4


def test_dictionary_leads_each_archive(spark):
    path = written(spark)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    assert files and all(f[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for f in files)
    size = int.from_bytes(files[0][4:8], "little")
    assert zstandard.ZstdDecompressor().decompress(files[0][8 : 8 + size])[:4] == bytes.fromhex("37a430ec")


def test_empty_table(spark):
    path = folder(spark)
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).where("page_id = 0"), path)
    assert warc.read_archives(spark, path).count() == 0


def read_bytes(spark, tmp_path, data):
    (tmp_path / "one.warc.zst").write_bytes(data)
    return warc.read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()


def test_archives_of_other_writers(spark, tmp_path):
    """A plain dictionary, streamed frames without sizes, folded headers, hexadecimal digests, other record types."""
    samples = [f"WARC/1.0 some header {i} of a record that is like others {i % 7}".encode() * 4 for i in range(300)]
    raw = zstandard.train_dictionary(2048, samples).as_bytes()
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False)
    one = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://x/\r\n y\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode() + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + coder.compress(one) + warc.EMPTY_FRAME + coder.compress(one.replace(b"resource", b"metadata"))
    got = read_bytes(spark, tmp_path, data)
    assert [(r.record_type, r.target_uri, bytes(r.payload), r.error) for r in got] == [("resource", "http://x/ y", b"abc", None), ("metadata", "http://x/ y", b"abc", None)]


def test_damaged_records_keep_a_row(spark, tmp_path):
    good = warc.page_record("<g>", "2020-01-01T00:00:00Z", 1, "http://x/", b"hello", None)
    coder = zstandard.ZstdCompressor(write_checksum=True)
    bad = [
        good.replace(b"WARC/1.1", b"WARC/7.1"),
        good.replace(b"WARC-Date", b"WARC-Dame"),
        good.replace(b"Content-Length: ", b"Content-Length: x", 1),
        good[:-5] + b"\r\n\r\n",
        good[:-4] + b"abcd",
        good.replace(b"hello", b"jello"),
        b"no headers",
        good + good,
        good.replace(b"WARC-Date:", b"WARC-Date"),
    ]
    flipped = bytearray(coder.compress(good))
    flipped[-6] ^= 0x55
    data = b"".join(map(coder.compress, [good, *bad])) + bytes(flipped) + coder.compress(good) + coder.compress(good)[:-3]
    got = read_bytes(spark, tmp_path, data)
    errors = [r.error for r in got]
    assert len(got) == len(bad) + 4 and errors[0] is None and errors[-2] is None
    assert all(errors[1:-2]) and errors[-1] == "frame is cut off"
    assert [bytes(r.payload) for r in got if r.error is None] == [b"hello"] * 2
    assert read_bytes(spark, tmp_path, b"plain text")[0].error == "no frame begins here"


def test_revisits_are_checked(spark):
    gone = warc.parse(warc.page_record("<r>", "2020-01-01T00:00:00Z", 2, None, b"abc", "<gone>"))
    other = warc.parse(warc.page_record("<s>", "2020-01-01T00:00:00Z", 3, None, b"abc", "<t>"))
    there = warc.parse(warc.page_record("<t>", "2020-01-01T00:00:00Z", 4, None, b"abd", None))
    records = common.scratch(spark.createDataFrame([r | {"archive": "a", "offset": 0, "frame_bytes": 1} for r in (gone, other, there)], warc.RECORDS), "records")
    assert {r.record_id: r.error for r in warc.resolved(records).collect()} == {"<r>": "no response has the id referred to", "<s>": "revisit differs from its response", "<t>": None}
