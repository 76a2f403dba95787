"""Vectorised pre-tokenisation for byte-level BPE, and a cache from pre-token to ids.

The public byte-level pattern splits a text into contractions, runs of letters, numbers or other signs (each with
one leading space) and white space. A run ends where the class of the character changes, so all boundaries of a
batch follow from a few comparisons of neighbouring classes instead of a regular expression match per token.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from .common import ragged

OTHER, LETTER, NUMBER, SPACE = range(4)

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def class_table() -> np.ndarray:
    """Class of each code point; letters and numbers are the Unicode categories L* and N*."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    at = np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            table[at[m.start() : m.end()]] = kind
    table[WHITE_SPACE] = SPACE
    return table


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where pre-tokens start, and for each text (by offsets) the number of its first pre-token.

    data holds the texts' UTF-8 bytes one after another. Both results have one more entry at the end.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[pos]
    points = lead.astype(np.int32)
    for least, below, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((lead >= least) & (lead < below))
        if len(at):
            value = points[at] & mask
            for k in range(1, more + 1):
                value = (value << 6) | (data[pos[at] + k] & 0x3F)
            points[at] = value
    kind = class_table()[points]
    n = len(kind)
    first = np.zeros(n + 1, bool)  # first character of a text
    first[np.searchsorted(pos, offsets)] = True
    first[0] = True
    space, blank = kind == SPACE, points == 32
    start = first[:-1].copy()
    start[1:] |= (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~space[1:])
    # the last of several white space characters before a word is a token of its own, or leads the word
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    last &= ~first[1:]
    start |= last
    # contractions
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    if len(quote):
        quote = quote[~first[quote + 1]]
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        quote, long = quote[hit], (long & ~short)[hit]
        start[quote + 1] = False
        after = quote + 2 + long
        after = after[after < n]
        after = after[kind[after] == LETTER]
        start[after] = True
    tokens = np.flatnonzero(start)
    begins = np.append(pos[tokens], len(data)).astype(np.int64)
    return begins, np.searchsorted(begins, offsets).astype(np.int64)


class PieceIds:
    """Ids of pre-tokens by a library's encoder; what was seen is kept, up to a bound of entries: once half of them are
    new, those not seen since are dropped.

    encode takes pre-tokens (bytes) and gives the ids of each as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most, self.known, self.before = encode, most, {}, {}

    def __call__(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pre-tokens one after another, and the number of ids of each."""
        count = len(begins) - 1
        if count <= 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = raw.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > self.most // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        missing = [p for p in pieces if p not in known]
        known.update((p, before[p]) for p in missing if p in before)
        new = [p for p in missing if p not in known]
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        found = [known[p] for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        return ragged(flat, (np.cumsum(sizes) - sizes)[which], lengths), lengths
