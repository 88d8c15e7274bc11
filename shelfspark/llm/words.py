"""Words of many texts as arrays: boundaries, 64-bit hashes and affixes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def places(at: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a word; no place, however far, has that of another."""
    near = at < len(_PLACE)
    if near.all():
        return _PLACE[at]
    far = mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.where(near, _PLACE[np.where(near, at, 0)], far)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of consecutive texts that lie in one buffer."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        n = len(buf)
        self.buf, self.n_docs = buf, len(offsets) - 1
        non = ~SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start, last = non.copy(), non.copy()
        start[1:] &= ~non[:-1] | edge[1:n]
        last[:-1] &= ~non[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        at = np.arange(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * places(at - np.maximum.accumulate(np.where(start, at, 0)) if n else at), out=self.sums[1:])
        #: First and last word of each text, as positions in the arrays.
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def hashes(self) -> np.ndarray:
        return mix(self.sums[self.end] - self.sums[self.start] + (self.end - self.start).astype(np.uint64))

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of each word's first k bytes, or of the whole word if it is shorter."""
        return mix(self.sums[np.minimum(self.start + k, self.end)] - self.sums[self.start] + np.uint64(1000 + k))

    def suffixes(self, k: int) -> np.ndarray:
        out = np.full(len(self.start), 77 + k, np.uint64)
        for j in range(k):
            at = self.end - 1 - j
            out = out * _M1 + np.where(at >= self.start, _BYTE[self.buf[np.maximum(at, 0)]], np.uint64(3))
        return mix(out)


def chunks(column: pa.Array, lower: str | None = None, most: int = 128 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `most` bytes, a longer text alone: first row, last row, bytes, offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset:  # a slice's kernels may keep its old offsets
        column = column.take(pa.array(np.arange(len(column))))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = {"ascii": pc.ascii_lower, "utf8": pc.utf8_lower}[lower](column)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs and where each text's runs begin; a text of fewer words is one run, an empty one none."""
    h = w.hashes()
    n = np.diff(w.first)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(w.first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    size = np.repeat(np.minimum(n, k), runs)
    out = size.astype(np.uint64)
    for j in range(k):
        here = np.minimum(at + j, max(len(h) - 1, 0))
        out = np.where(j < size, mix(out * _M1 + h[here] + np.uint64(j)) if len(h) else out, out)
    return out, begin
