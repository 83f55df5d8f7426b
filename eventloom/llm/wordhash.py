"""Hashes of words and word windows of many texts at once, with numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_PLAIN = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += np.uint64(32)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INV)):
            steps = np.full(n, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Words of several texts: ``hashes``, byte ``starts`` and ``ends`` in ``data``, and ``first`` word of each text (one more at the end)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes + 1)))
        if not len(raw):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        inside = _IS_WORD[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_at)
        up, down = _power_tables(len(raw))
        value = (_LOWER if lower else _PLAIN)[raw]
        value *= up[: len(raw)]
        value[~inside] = 0
        if len(self.starts):
            total = np.add.reduceat(value, self.starts)
            self.hashes = mix(total * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; those that run past a text's end are not valid."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return window_hashes(self.hashes, size)

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``begin`` to ``end``, exclusive, for each pair of word numbers."""
        up, down = _power_tables(len(self.hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up[: len(self.hashes)], dtype=np.uint64)))
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def valid(self, size: int) -> np.ndarray:
        """For each entry of ``windows(size)``, whether it lies within one text."""
        n = max(0, len(self.hashes) - size + 1)
        left = np.repeat(self.first[1:], self.counts())[:n] - np.arange(n)
        return left >= size


_SEQ = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``size`` values, by doubling."""
    n = len(hashes) - size + 1
    out, have, block, span = None, 0, hashes, 1
    while size:
        if size & span:
            part = block[have : have + n]
            out = part if out is None else mix(out * _SEQ + part)
            have += span
            size -= span
        if size:
            block = mix(block[: len(block) - span] * _SEQ + block[span:] + np.uint64(span))
            span *= 2
    return out


def small_batches(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of ``batch`` with about ``most`` text bytes each, and their texts as bytes (null: empty)."""
    column = batch.column(text).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin), [x or b"" for x in column.slice(begin, i - begin).to_pylist()]
            begin, total = i, 0
        total += n
    if begin < len(column):
        yield batch.slice(begin), [x or b"" for x in column.slice(begin).to_pylist()]
