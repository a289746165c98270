"""Vectorised text helpers for Arrow batches, shared by the operators.

Everything works on the UTF-8 bytes of whole texts. Spark sends batches of
about ``BATCH_BYTES`` (``small_batches``), and these are cut into chunks of
about ``CHUNK_BYTES`` of text, so a worker's memory is bounded by these sizes
and by its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
CHUNK_BYTES = 512 << 10
SEGMENT_BYTES = 1 << 20

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the bytes outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = False
    return table


#: Bytes of words that white space separates: [^\x20\x09-\x0D].
SPACED = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of letter-and-digit words: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def small_batches(spark: SparkSession) -> None:
    """Let the session send Python workers at most ``BATCH_BYTES`` at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column`` each
    (one row at least)."""
    for batch in batches:
        sizes = byte_lengths(batch.column(batch.schema.get_field_index(column)))
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def byte_lengths(array: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_pylist()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the n + 1 offsets into them."""
    array = array.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n at least, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


class Words:
    """Words of many texts: ``start`` and ``end`` (byte positions), ``hash``
    (64 bits) and ``first``, the n + 1 positions in these arrays where each
    text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        lower = LOWER[data]
        is_word = word_bytes[lower]
        parts = []
        at = 0
        while at < len(data):  # segments end where a word does, so tables stay small for very long texts
            end = min(at + SEGMENT_BYTES, len(data))
            while end < len(data) and is_word[end - 1] and is_word[end] and not edge[end]:
                gap = np.flatnonzero(~is_word[end:end + SEGMENT_BYTES] | edge[end:min(end + SEGMENT_BYTES, len(data))])
                end = end + int(gap[0]) if len(gap) else min(end + SEGMENT_BYTES, len(data))
            parts.append(_segment(lower[at:end], is_word[at:end], edge[at:end + 1], at))
            at = end
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def _segment(lower: np.ndarray, is_word: np.ndarray, edge: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    n = len(lower)
    before = np.concatenate(([False], is_word[:-1]))
    after = np.concatenate((is_word[1:], [False]))
    start = np.flatnonzero(is_word & (~before | edge[:n]))
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[lower] * _power_table(_BASE, n)[:n], out=total[1:])
    return start + at, end + at, mix((total[end] - total[start]) * _power_table(_INVERSE, n)[start])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(hashes) - k + 1 of
    them; runs over a text's end are the caller's to leave out)."""
    n = max(len(hashes) - k + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = (total ^ hashes[i:i + n]) * np.uint64(0x100000001B3 + 2 * i)
        total ^= total >> np.uint64(29)
    return mix(total)


def extra(columns: list[str], *taken: str) -> list[str]:
    """Input columns that don't clash with an operator's own names."""
    own = {x.lower() for x in taken}
    return [c for c in columns if c.lower() not in own]
