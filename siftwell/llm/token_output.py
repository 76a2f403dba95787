"""Operator 2: token ids as Simple-8b segments in global document order, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, lean, read, scratch, slices, texts, worker_cache
from .pretokens import PieceIds, boundaries
from .simple8b import read_segment, write_segment

SEGMENTS = "part int, segment int, start_in_part long, n_docs long, n_ids long, payload binary"
DOCS = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"
END_ID = 0
#: A segment closes once it has so many ids; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 20

#: Bytes of text pre-tokenised at a time: the more, the fewer look-ups of repeated pre-tokens.
STEP_BYTES = 4 << 20

_coders: dict[str, PieceIds] = worker_cache("token coders")


#: Pre-tokens that the library encodes as the words of one text.
JOINED = 1024
#: Pre-tokens that a worker keeps with their ids.
KEPT = 500_000


def library_coder(path: str, most: int = 300_000) -> PieceIds:
    """The tokenizers library's encoder for pre-tokens; special tokens' strings in a text are ordinary text.

    A call costs more than a word, so the library gets many pre-tokens at once, as a text that is cut into words already,
    and doesn't look for their limits again. As ids never cross the limits, the bytes of each id tell where a pre-token ends.
    A worker keeps one coder, that of the last path and bound.
    """
    key = f"{path} {most}"
    if key not in _coders:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        sizes = np.zeros(t.get_vocab_size(), np.int64)
        for token, k in t.get_vocab().items():
            sizes[k] = len(token)  # a character of a byte-level token stands for a byte

        def encode(pieces: list[bytes]) -> list[bytes]:
            words = [p.decode() for p in pieces]
            groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
            coded = t.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in coded])
            after = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(p) for p in pieces])) + 1
            raw, ends = ids.tobytes(), (4 * after).tolist()
            return [raw[a:b] for a, b in zip([0, *ends], ends)]

        _coders.clear()
        _coders[key] = PieceIds(encode, most)
    return _coders[key]


def encode_batch(coder: PieceIds, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, all ids, and the number of ids of each row."""
    for lo, hi, off, data in slices(column, STEP_BYTES):
        begins, first = boundaries(data, off)
        ids, lengths = coder(data, begins)
        total = np.concatenate([[0], np.cumsum(lengths)])
        yield lo, hi, ids, np.diff(total[first])


def encode_segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of all documents in ascending doc_id order, written to the shared folder.

    Null text is an empty text, whose only id is end_id. Rows with null doc_id come first; rows that repeat a doc_id
    are all kept, next to each other, in the order of their text's hash and text, so that equal rows are interchangeable
    and any other tie has one order. The range partitioning splits by the hash as well, so that one repeated doc_id
    doesn't fill a partition with different texts. An empty table gives no segment; other columns play no part. A long
    text makes a long segment, which one task holds.
    """
    arrow_limits(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = library_coder(tokenizer, KEPT), TaskContext.get().partitionId()
        segment, start = 0, 0
        named, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start, named, lengths, held, size
            payload = write_segment(named, np.concatenate(lengths), np.concatenate(held))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start]), pa.array([len(named)]), pa.array([size]), pa.array([payload], pa.binary())], ["part", "segment", "start_in_part", "n_docs", "n_ids", "payload"])
            segment, start = segment + 1, start + size
            named, lengths, held, size = [], [], [], 0
            return row

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, ids, counts in encode_batch(coder, batch.column("text")):
                full = np.full(len(ids) + hi - lo, end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), counts)] = ids
                ends = np.cumsum(counts + 1)
                row = 0
                while row < hi - lo:  # up to the row that fills the segment
                    before = ends[row - 1] if row else 0
                    to = min(int(np.searchsorted(ends, before + segment_ids - size)) + 1, hi - lo)
                    named += doc_ids[lo + row : lo + to]
                    lengths.append(counts[row:to] + 1)
                    held.append(full[before : ends[to - 1]])
                    size += int(ends[to - 1] - before)
                    row = to
                    if size >= segment_ids:
                        yield close()
        if named:
            yield close()

    ordered = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return scratch(ordered.mapInArrow(lean(encode, "token coders"), SEGMENTS), "segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """One row per document of the segments: its place among all ids, number of ids and their crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                named, lengths, ids = read_segment(row["payload"])
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(named)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array(named, pa.int64()), pa.array(ends - lengths + row["start_in_part"]), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    # a row for each partition of the writer: their number is set by the cluster, not by the corpus
    from pyspark.sql import Window

    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    place = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("base"))
    rows = segments.select("part", "start_in_part", "payload").mapInArrow(lean(decode), DOCS)
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_segments(encode_segments(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
