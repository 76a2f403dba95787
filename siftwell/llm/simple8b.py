"""Simple-8b coding of ids: 64-bit words of a 4-bit selector and up to 60 values, and the segment format around it.

A word's selector says how many values of how many bits it packs. A value of more than 60 bits is an escape: its word
holds a place in a list of exceptions. Values are coded in blocks that start at a word of their own; a segment has the
offset of each block's first word, so all blocks decode at once, or any one alone.

Segment: magic, version, block size, documents, ids, blocks, words, exceptions (header); per document its id and
number of ids; per block its first word; exceptions; words. All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np


#: How many values a word packs, and of how many bits, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15

MAGIC = b"S8BS"
HEADER = struct.Struct("<4sHHIQIII")


def widths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        out += step * big
        rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0)


def pack(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (one more at the end), exceptions."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    width = widths(values).astype(np.int8)
    low = int(np.partition(width, n // 20)[n // 20])  # few runs are of smaller values than a twentieth is
    most = int(COUNTS[np.flatnonzero(low <= BITS)[0]]) if low <= 60 else 1
    begin = np.arange(0, n, block)
    end = np.minimum(begin + block, n)
    at, open_ = begin.copy(), np.arange(len(begin))
    found = []  # (block, position, selector), a word of each open block at a time
    # each block's widths, then zeros: what is beyond the end fits any word
    rows = np.zeros((len(begin), block + most), np.int8)
    full = n // block
    rows[:full, :block] = width[: full * block].reshape(full, block)
    if full < len(begin):
        rows[full, : n - full * block] = width[full * block :]
    rows, shift, look = rows.ravel(), np.arange(len(begin)) * most, np.arange(most)
    use = np.flatnonzero(COUNTS <= most)
    bits, last = BITS[use].astype(np.int8), COUNTS[use] - 1
    step = np.append(COUNTS[use], 1)
    use = np.append(use, ESCAPE)
    while len(open_):
        here = at[open_]
        run = np.maximum.accumulate(rows[(here + shift[open_])[:, None] + look], axis=1)
        fits = np.ones((len(here), len(use)), bool)  # the escape always does
        np.less_equal(run[:, last], bits, out=fits[:, :-1])
        pick = np.argmax(fits, axis=1)
        found.append((open_, here, use[pick]))
        at[open_] = here = here + step[pick]
        open_ = open_[here < end[open_]]
    which, where, chosen = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(where, kind="stable")
    which, where, chosen = which[order], where[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        here = np.flatnonzero(chosen == s)
        limit = end[which[here]]
        for k in range(COUNTS[s]):
            i = where[here] + k
            v = np.where(i < limit, values[np.minimum(i, n - 1)], np.uint64(0))
            words[here] |= v << np.uint64(k * BITS[s])
    wide = np.flatnonzero(chosen == ESCAPE)
    words[wide] |= np.arange(len(wide), dtype=np.uint64)
    starts = np.searchsorted(which, np.arange(len(begin) + 1))
    return words, starts, values[where[wide]]


def unpack(words: np.ndarray, starts: np.ndarray, exceptions: np.ndarray, block: int, n: int) -> np.ndarray:
    """The values, all blocks at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(selector == ESCAPE, 1, COUNTS[np.minimum(selector, len(COUNTS) - 1)])
    before = np.cumsum(count) - count
    which = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    where = before - before[starts[which]] + which * block
    limit = np.minimum((which + 1) * block, n)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[where[here]] = exceptions[payload[here].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            i = where[here] + k
            inside = i < limit[here]
            out[i[inside]] = (payload[here][inside] >> np.uint64(k * BITS[s])) & mask
    return out


def write_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = 1024) -> bytes:
    """One segment of whole documents. A null document id is kept as such."""
    words, starts, exceptions = pack(ids, block)
    head = HEADER.pack(MAGIC, 1, block, len(doc_ids), len(ids), len(starts) - 1, len(words), len(exceptions))
    given = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, named.tobytes(), given.tobytes(), lengths.astype("<u8").tobytes(), starts.astype("<u4").tobytes(), exceptions.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, and all ids."""
    magic, version, block, docs, n, blocks, nwords, nexc = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of this format")
    at = HEADER.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    named, given, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    starts, exceptions, words = take("<u4", blocks + 1), take("<u8", nexc), take("<u8", nwords)
    ids = unpack(words, starts.astype(np.int64), exceptions, block, n)
    return [int(d) if g else None for d, g in zip(named, given, strict=True)], lengths.astype(np.int64), ids


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, by its offset."""
    _, _, block, docs, n, blocks, nwords, nexc = HEADER.unpack_from(data)
    at = HEADER.size + 17 * docs
    starts = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    exceptions = np.frombuffer(data, "<u8", nexc, at)
    at += 8 * nexc
    words = np.frombuffer(data, "<u8", nwords, at)[starts[k] : starts[k + 1]]
    return unpack(words, np.array([0, len(words)]), exceptions, block, min(block, n - k * block))


