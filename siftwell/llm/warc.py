"""Operator 12: WARC archives in Zstandard, one frame per record, with a dictionary in the leading skippable frame.

Writing: records are built and compressed where their rows are; a task puts them together to archives of bounded size,
each with its own copy of the dictionary in front. An archive is one value of a text table, of which Spark writes every
row to a file of its own, so that any store that Spark writes to can hold them, and only committed tasks leave files.
Spark ends a row by a separator; here this is an empty skippable frame, which readers of Zstandard pass over.

Reading: Spark hands each archive to a task. The dictionary comes from the leading skippable frame (plain or itself
compressed), all other skippable frames are passed over, and each data frame must hold one whole record, whose version
line, headers, lengths and digests are checked. A record that fails keeps its row, with the reason in error; so does
what is left of an archive that is cut off.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, lean, look_up, read, scratch, scratch_dir, settled

# Fixed values of the formats.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50  # the last four bits are free
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes at which an archive is closed; a longer record makes a longer archive.
ARCHIVE_BYTES = 16 << 20
#: Payloads of so many bytes or more are stored once.
REVISIT_BYTES = 1000
#: The dictionary's size, and the sample that it is trained on: pages with the least hash, their first bytes.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES = 64 << 10, 1024, 4096
#: A frame that says it holds more is taken for damaged.
MOST_BYTES = 1 << 31
BATCH_BYTES = 8 << 20
LEVEL = 3

RECORDS = (
    "archive string, offset long, frame_bytes long, record_type string, record_id string, refers_to_id string, target_uri string, "
    "date string, page_id long, block_bytes long, payload_bytes long, payload_digest string, payload binary, error string"
)


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(field: str | None) -> str | None:
    """The sha1 of a digest field, base 32 or hexadecimal, as lower-case hexadecimal; None for any other algorithm."""
    name, _, value = (field or "").partition(":")
    if name.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return ""


def clean_uri(uri: str) -> str:
    """White space and control signs would end a header; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *headers, ("WARC-Block-Digest", base32_sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(record_id: str, date: str, page_id: int | None, uri: str | None, payload: bytes, response_id: str | None) -> bytes:
    """A page's record: response, or revisit of the response with the id given, which keeps the HTTP header alone."""
    headers = [] if uri is None else [("WARC-Target-URI", clean_uri(uri))]
    headers += [] if page_id is None else [("Page-ID", str(page_id))]
    headers += [("WARC-Payload-Digest", base32_sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if response_id is None:
        return record("response", record_id, date, headers, block + payload)
    return record("revisit", record_id, date, [("WARC-Refers-To", response_id), ("WARC-Profile", IDENTICAL), *headers], block)


def page_record_id(name: str, row_key: int) -> str:
    """A record's id follows from the archives' name and the row's place, so a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{row_key}')}>"


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or nothing where the samples are too few or too short for one."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def trained(pages: DataFrame) -> bytes:
    """A dictionary from SAMPLE_PAGES rows of (row_key, payload), trained in a task; the driver gets its bytes alone.

    Only about twice as many rows, chosen by their hash where they are, reach the task that sorts them.
    """
    n = pages.count()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x for b in batches for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(samples)], pa.binary())], ["dictionary"])

    sample = pages.select(F.xxhash64("row_key").alias("h"), "row_key", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))
    sample = sample.where(F.pmod("h", F.lit(max(n, 1))) < 2 * SAMPLE_PAGES)
    one = sample.orderBy("h", "row_key").limit(SAMPLE_PAGES).coalesce(1).mapInArrow(lean(fit), "dictionary binary")
    return bytes(next((r[0] for r in one.collect() if r[0]), b""))


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """row_key and response_key of each row whose payload, of least bytes or more, another row keeps.

    Of equal payloads the row with the largest page_id keeps it (null is smallest; of equal ids the last row). Digests
    are summed up before they are shuffled; payloads stay where they are.
    """
    slim = scratch(pages.where(F.octet_length("payload") >= least).select("row_key", "page_id", F.sha2("payload", 256).alias("digest")), "digests")
    keeps = slim.groupBy("digest").agg(F.max(F.struct("page_id", "row_key")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("kept.row_key").alias("response_key"))
    return look_up(slim, keeps, "digest").where("response_key <> row_key").select("row_key", "response_key")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, least: int = REVISIT_BYTES, with_dictionary: bool = True) -> None:
    """Write a record for every row of pages (page_id, url, html) into archives under path, a folder of its own.

    A null html is an empty payload, a null url or page_id a record without that header. Rows that repeat an id or a
    whole row have a record each; an empty table gives no archive. Other columns play no part.
    """
    arrow_limits(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = settled(pages).select(F.monotonically_increasing_id().alias("row_key"), F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    dictionary = trained(rows) if with_dictionary else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, path).hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        front = dictionary_frame(dictionary) if dictionary else b""
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            about = record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, first)}>", date, [("Content-Type", "application/warc-fields")], b"software: siftwell\r\nformat: WARC File Format 1.1\r\n")
            out = pa.RecordBatch.from_arrays([pa.array([b"".join([front, coder.compress(about), *held])], pa.binary())], ["archive"])
            held, size = [], 0
            return out

        for batch in batches:
            columns = (batch.column(c) for c in ("row_key", "page_id", "url", "payload", "response_key"))
            for key, page, uri, body, kept in zip(*columns, strict=True):
                own, kept = page_record_id(name, key.as_py()), kept.as_py()
                if not held:
                    first = own
                held.append(coder.compress(page_record(own, date, page.as_py(), uri.as_py(), body.as_py(), None if kept is None else page_record_id(name, kept))))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    archives = rows.join(revisits(rows, least), "row_key", "left").mapInArrow(lean(build), "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME.decode()).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at a place ends, from the sizes of its blocks; ValueError if data ends before."""
    try:
        end = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ValueError("frame header is damaged") from e
    checksum, last = data[at + 4] & 4, False
    while not last:
        if end + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        last = bool(head & 1)
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    end += 4 if checksum else 0
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def frames(data: memoryview) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """Each data frame's place, length, content, and what is wrong with it (then without content)."""
    coder, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & ~15 == SKIPPABLE_MAGIC and at + 8 <= len(data):
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                yield at, len(data) - at, None, "skippable frame is cut off"
                return
            if magic == DICTIONARY_MAGIC and at == 0:
                try:
                    raw = bytes(data[at + 8 : end])
                    if int.from_bytes(raw[:4], "little") == FRAME_MAGIC:
                        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=MOST_BYTES)
                    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except (zstandard.ZstdError, MemoryError) as e:
                    yield at, end - at, None, f"dictionary is damaged: {e}"
            at = end
            continue
        if magic != FRAME_MAGIC:
            yield at, len(data) - at, None, "no frame begins here"
            return
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield at, len(data) - at, None, str(e)
            return
        size = zstandard.frame_content_size(data[at : at + 18])
        try:
            if size > MOST_BYTES:
                raise ValueError("frame is too large")
            content = coder.decompress(data[at:end]) if size > 0 else coder.decompressobj().decompress(data[at:end])
            yield at, end - at, content, None
        except (ValueError, zstandard.ZstdError) as e:
            yield at, end - at, None, f"frame can't be decoded: {e}"
        at = end


def parse(content: bytes) -> dict:
    """The fields of RECORDS that one record gives; error names the first thing wrong with it."""
    out: dict = {"block_bytes": None, "error": None}
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return out | {"error": "headers have no end"}
    lines = re.sub(rb"\r\n[ \t]+", b" ", content[:end]).split(b"\r\n")
    if lines[0] not in VERSIONS:
        return out | {"error": "not a WARC version that is known"}
    headers: dict[str, str] = {}
    for line in lines[1:]:
        field, colon, value = line.partition(b":")
        if not colon or not field.strip():
            return out | {"error": "a header line has no name"}
        headers.setdefault(field.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    kind, page = headers.get("warc-type"), headers.get("page-id", "")
    out |= {"record_type": kind, "record_id": headers.get("warc-record-id"), "refers_to_id": headers.get("warc-refers-to")}
    out |= {"target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) and -(1 << 63) <= int(page) < 1 << 63 else None}
    missing = [m for m in MANDATORY if m not in headers]
    if missing:
        return out | {"error": f"{missing[0]} is missing"}
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        return out | {"error": "content-length is no number"}
    length = int(headers["content-length"])
    block = content[end + 4 : end + 4 + length]
    out["block_bytes"] = len(block)
    if len(content) != end + 8 + length:
        return out | {"error": "content-length differs from the frame's"}
    if content[-4:] != b"\r\n\r\n":
        return out | {"error": "record has no end"}
    digest = hex_digest(headers.get("warc-block-digest"))
    if digest is not None and digest != hashlib.sha1(block).hexdigest():
        return out | {"error": "block digest differs"}
    claimed = hex_digest(headers.get("warc-payload-digest"))
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block)
        return out | {"payload_digest": claimed, "payload_bytes": int(found[1]) if found else None}
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            return out | {"error": "HTTP header has no end"}
        block = block[cut + 4 :]
    out |= {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha1(block).hexdigest()}
    return out | ({"error": "payload digest differs"} if claimed is not None and claimed != out["payload_digest"] else {})


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row (RECORDS) per record of the archives under path, with or without the payloads themselves.

    A revisit has the digest and the length that it states, and no payload; resolved() looks it up. error is null for a
    record in order. A task holds one archive and one record.
    """
    arrow_limits(spark)
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORDS.split(", "))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for at, length, raw, error in frames(memoryview(content.as_buffer())):
                    row = {"error": error} if raw is None else parse(raw)
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row | {"archive": name.as_py(), "offset": at, "frame_bytes": length})
                    size += 500 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(decode), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records and, for revisits, refers_to: page_id of the response with the id they name; error if there is none with
    the same digest and length. records is a written table. All that goes on is ids, lengths and digests."""
    responses = records.where("record_type = 'response' AND error IS NULL").select(F.col("record_id").alias("refers_to_id"), F.struct(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size")).alias("response"))
    found = look_up(records, responses, "refers_to_id")
    revisit = F.col("record_type") == "revisit"
    same = F.col("payload_digest").eqNullSafe(F.col("response.digest")) & F.col("payload_bytes").eqNullSafe(F.col("response.size"))
    wrong = F.when(revisit & F.col("response").isNull(), "no response has the id referred to").when(revisit & ~same, "revisit differs from its response")
    return found.withColumn("error", F.coalesce("error", wrong)).withColumn("refers_to", F.when(revisit, F.col("response.id"))).drop("response")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back; a record that isn't in order stops the query."""
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), path)
    records = resolved(scratch(read_archives(spark, path, payloads=False).drop("payload"), "records"))
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "offset", "error")).cast("string")).otherwise(F.col("record_type"))
    pages = records.withColumn("record_type", sound).where("record_type IN ('response', 'revisit')")
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to FROM g
"""
