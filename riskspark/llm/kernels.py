"""Array functions over the UTF-8 bytes of a batch of texts; they run inside Arrow tasks.

Substrings are compared by 64-bit polynomial hashes (mod 2**64, random odd base,
random byte values) finished by a mixing step.  Modulo a power of two, long strings of a
certain order (Thue-Morse) agree whatever the base, so spans above ``LONG`` bytes are hashed by
blocks far too short for that, and the blocks' mixed hashes are mixed again with their
places and added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text, and texts, that are worked on at once; one longer text is taken whole.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 4096
#: The same where a byte takes dozens of bytes of arrays and nothing is shared between texts: a worker's memory follows it.
PART_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
#: Two bases, for hashes that are independent of each other.
BASES = (0x9E6C63D0876A3F6B, 0xC2B2AE3D27D4EB4F)
SHINGLE_BASE = U64(0xD1342543DE82EF95)
#: Spans above so many bytes are hashed by blocks of half as many.
LONG = 256

#: ASCII white space, that is space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    got = _powers.get(which)
    if got is None or got[0].size < n:
        made = []
        for b in (BASES[which], pow(BASES[which], -1, 2**64)):
            steps = np.full(max(n, CHUNK_BYTES + 1), b, U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        got = (made[0], made[1])
        if n <= 8 * CHUNK_BYTES:  # tables for one very long text are not kept
            _powers[which] = got
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all 64 bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Spans:
    """Hashes of any byte spans of ``data``."""

    def __init__(self, data: np.ndarray, which: int = 0):
        pw, self.inverse = powers(data.size + 1, which)
        self.sums = np.zeros(data.size + 1, U64)
        np.cumsum(BYTE_VALUES[data] * pw[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + size.astype(U64))
        long = np.flatnonzero(size > LONG)
        if long.size:
            out[long] = self._by_blocks(starts[long], ends[long])
        return out

    def _by_blocks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        count = -((starts - ends) // (LONG // 2))
        first = np.cumsum(count) - count
        nth = np.arange(int(count.sum())) - np.repeat(first, count)
        lo = np.repeat(starts, count) + nth * (LONG // 2)
        hi = np.minimum(lo + LONG // 2, np.repeat(ends, count))
        block = mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(U64))
        return mix(np.add.reduceat(mix(block ^ mix(nth.astype(U64) + U64(1))), first) + (ends - starts).astype(U64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each text starts (n + 1 offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.zeros(0, np.uint8) if buffer is None else np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of about ``limit`` bytes; a longer text makes a run of its own."""
    lo, n = 0, offsets.size - 1
    while lo < n:
        hi = max(lo + 1, min(lo + CHUNK_TEXTS, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words are runs without ASCII white space within a text."""
    n = data.size
    solid = ~SPACES[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid
    before[offsets] = False
    starts = np.flatnonzero(solid & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    after[offsets] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each \\n-split line, but for an empty last line of a text."""
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < data.size]
    ends = np.append(starts[1:], data.size)[: starts.size]
    ends = ends - (data[ends - 1] == 10)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(values: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` values within one text, and the position of its first value."""
    m = values.size - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = values[:m].copy()
    for j in range(1, k):
        h = h * SHINGLE_BASE + values[j : j + m]
    at = np.flatnonzero(texts[:m] == texts[k - 1 :])
    return mix(h[at] + U64(k)), at


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (n + 1 entries)."""
    out = np.zeros(data.size + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = values.size
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
