"""Whole columns of text as bytes inside a task: bounded slices, word places, fingerprints of byte strings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n + n // 8, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``limit`` bytes of text (or one row): rows, bytes, offsets of the rows in the bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts if pa.types.is_binary(texts.type) else pc.fill_null(texts, "").cast(pa.binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Prints:
    """Fingerprints of any substrings of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up = powers(_BASE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers(_BASE_INVERSE, n + 1)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(((self.sums[end] - self.sums[start]) * self.up[start]) ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(40)))

    def fixed(self, k: int) -> np.ndarray:
        """Of the ``k`` bytes at every place."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ``space`` bytes, and the row of each; none crosses a row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    apart = space[data]
    before = np.concatenate([[True], apart[:-1]])
    after = np.concatenate([apart[1:], [True]])
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(~apart & before)
    ends = np.flatnonzero(~apart & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
